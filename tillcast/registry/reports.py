"""Registered queries: accuracy and history reports, forecast summaries, digests.

A-16..A-20, A-23..A-27, A-29..A-32, W-13, T-05, F-19.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import functions as F

from ..operators import reports as R
from ..operators import series as S
from ..plans import forecast as FC
from ..plans.features import Calendars
from ..sources import calendars as C
from ..sources import derived as V
from ..sources import tables as T
from ..util import round_doubles
from . import query

_P = T.with_ctes(*T.PRED_CTES).rstrip() + """,
sc AS (SELECT p.*, m.business_id FROM predictions p JOIN models m USING (model_id)
       WHERE p.actual_quantity IS NOT NULL),
asofd AS (SELECT business_id, MAX(prediction_date) AS as_of FROM sc GROUP BY business_id),
sc30 AS (SELECT sc.* FROM sc JOIN asofd USING (business_id) WHERE prediction_date >= as_of - INTERVAL 30 DAY)
"""


def _scored(spark, sf_dir, since=None):
    daily = T.daily_series(spark, sf_dir)   # one scan of the line items, shared below
    return R.scored(T.predictions(spark, sf_dir, daily), T.models(spark, sf_dir, daily), since)


@query("A16_forecast_accuracy", _P + """
SELECT business_id, CAST(SUM(predicted_quantity) AS BIGINT) AS total_predicted,
  CAST(SUM(actual_quantity) AS BIGINT) AS total_actual,
  ROUND(AVG(abs(predicted_quantity - actual_quantity)), 6) AS mae,
  ROUND(COALESCE(AVG(CASE WHEN actual_quantity > 0
        THEN abs((actual_quantity - predicted_quantity) / actual_quantity) * 100 END), 0), 6) AS mape,
  ROUND(GREATEST(0, 100 - COALESCE(AVG(CASE WHEN actual_quantity > 0
        THEN abs((actual_quantity - predicted_quantity) / actual_quantity) * 100 END), 0)), 6) AS accuracy,
  COUNT(*) AS data_points, COUNT(DISTINCT prediction_date) AS days_tracked
FROM sc30 GROUP BY business_id""")
def forecast_accuracy(spark, sf_dir):
    return round_doubles(R.accuracy(_scored(spark, sf_dir, 30)))


@query("A17_daily_comparison", _P + """
SELECT business_id, prediction_date, CAST(SUM(predicted_quantity) AS BIGINT) AS predicted,
       CAST(SUM(actual_quantity) AS BIGINT) AS actual
FROM sc30 GROUP BY ALL ORDER BY business_id, prediction_date""")
def daily_comparison(spark, sf_dir):
    return R.daily_comparison(_scored(spark, sf_dir, 30))


_PERIOD_ROWS = []
for _name, _cur, _prev in (
        ("week", "as_of - CAST(isodow(as_of) - 1 AS INTEGER)", "as_of - CAST(isodow(as_of) - 1 AS INTEGER) - 7"),
        ("month", "CAST(date_trunc('month', as_of) AS DATE)",
         "CAST(date_trunc('month', as_of) - INTERVAL 1 MONTH AS DATE)"),
        ("quarter", "CAST(date_trunc('quarter', as_of) AS DATE)",
         "CAST(date_trunc('quarter', as_of) - INTERVAL 3 MONTH AS DATE)"),
        ("year", "CAST(date_trunc('year', as_of) AS DATE)",
         "CAST(date_trunc('year', as_of) - INTERVAL 12 MONTH AS DATE)")):
    _PERIOD_ROWS.append(f"""
  SELECT sc.business_id, '{_name}' AS period,
    CAST(COALESCE(SUM(CASE WHEN prediction_date >= {_cur} THEN predicted_quantity ELSE 0 END), 0) AS BIGINT) AS cp,
    CAST(COALESCE(SUM(CASE WHEN prediction_date >= {_cur} THEN actual_quantity ELSE 0 END), 0) AS BIGINT) AS ca,
    COUNT(CASE WHEN prediction_date >= {_cur} THEN 1 END) AS cn,
    CAST(COALESCE(SUM(CASE WHEN prediction_date >= {_prev} AND prediction_date < {_cur}
                  THEN predicted_quantity ELSE 0 END), 0) AS BIGINT) AS pp,
    CAST(COALESCE(SUM(CASE WHEN prediction_date >= {_prev} AND prediction_date < {_cur}
                  THEN actual_quantity ELSE 0 END), 0) AS BIGINT) AS pa,
    COUNT(CASE WHEN prediction_date >= {_prev} AND prediction_date < {_cur} THEN 1 END) AS pn
  FROM sc JOIN asofd USING (business_id) GROUP BY sc.business_id""")


@query("A18_period_comparison", _P + ", per AS (" + "\n  UNION ALL".join(_PERIOD_ROWS) + """
)
SELECT business_id, period, cp AS current_predicted, ca AS current_actual, cn AS current_rows,
  pp AS previous_predicted, pa AS previous_actual, pn AS previous_rows,
  ROUND(CASE WHEN pa > 0 THEN (ca - pa) / pa * 100 ELSE 0.0 END, 6) AS change_percent
FROM per""")
def period_comparison(spark, sf_dir):
    return round_doubles(R.period_comparison(_scored(spark, sf_dir)))


@query("A19_top_items", _P + """
SELECT * FROM (
  SELECT business_id, item_name, CAST(SUM(predicted_quantity) AS BIGINT) AS predicted,
         CAST(SUM(actual_quantity) AS BIGINT) AS actual,
         CAST(row_number() OVER (PARTITION BY business_id ORDER BY SUM(actual_quantity) DESC, item_name)
              AS INTEGER) AS rank
  FROM sc GROUP BY business_id, item_name) WHERE rank <= 10""")
def top_items(spark, sf_dir):
    return R.top_items(_scored(spark, sf_dir))


@query("A20_weekday_profile", _P + """,
g AS (SELECT business_id, CAST(isodow(prediction_date) - 1 AS INTEGER) AS dow, SUM(predicted_quantity) AS p,
             SUM(actual_quantity) AS a, COUNT(*) AS n FROM sc GROUP BY ALL),
d AS (SELECT b.business_id, CAST(x.dow AS INTEGER) AS dow FROM (SELECT DISTINCT business_id FROM sc) b,
      range(0, 7) x(dow))
SELECT d.business_id, d.dow,
  ['Monday', 'Tuesday', 'Wednesday', 'Thursday', 'Friday', 'Saturday', 'Sunday'][d.dow + 1] AS day,
  ROUND(COALESCE(g.p, 0) / GREATEST(COALESCE(g.n, 0), 1), 6) AS avg_predicted,
  ROUND(COALESCE(g.a, 0) / GREATEST(COALESCE(g.n, 0), 1), 6) AS avg_actual
FROM d LEFT JOIN g USING (business_id, dow)""")
def weekday_profile(spark, sf_dir):
    return round_doubles(R.weekday_profile(_scored(spark, sf_dir)))


@query("A23_source_row_counts", T.with_ctes(T.SALES_SQL, *C.ALL_CALENDARS_SQL, V.DERIVED_SQL) + """
SELECT 'weather' AS source, COUNT(*) AS rows FROM d_weather
UNION ALL SELECT 'holidays', COUNT(*) FROM d_holidays
UNION ALL SELECT 'sports', COUNT(*) FROM d_games
UNION ALL SELECT 'paydays', COUNT(*) FROM paydays
UNION ALL SELECT 'school', COUNT(*) FROM school""")
def source_row_counts(spark, sf_dir):
    cal = Calendars.for_data(T.sales(spark, sf_dir))
    return R.source_row_counts({"weather": V.daily_weather(spark, sf_dir), "holidays": V.monthly_holidays(spark, sf_dir),
                                "sports": V.daily_games(spark, sf_dir), "paydays": cal.paydays, "school": cal.school})


_FC = T.with_ctes(T.SALES_SQL, T.daily_sales_sql()).rstrip() + """,
mx AS (SELECT business_id, MAX(date) AS last_date FROM daily GROUP BY business_id),
avgd AS (SELECT business_id, item_name, AVG(quantity) AS a FROM daily GROUP BY ALL),
fc AS (
  SELECT g.business_id, g.prediction_date, g.item_name, GREATEST(CAST(round_even(a.a, 0) AS INTEGER), 0)
         AS predicted_quantity
  FROM (SELECT i.business_id, i.item_name,
               CAST(unnest(generate_series(mx.last_date + 1, mx.last_date + 8, INTERVAL 1 DAY)) AS DATE)
               AS prediction_date
        FROM (SELECT DISTINCT business_id, item_name FROM daily) i JOIN mx USING (business_id)) g
  JOIN avgd a USING (business_id, item_name)
)"""


def _forecast(spark, sf_dir):
    return FC.naive_forecast(T.daily_series(spark, sf_dir), 7)


@query("A24_key_factors", T.with_ctes(T.SALES_SQL, *C.ALL_CALENDARS_SQL, V.DERIVED_SQL) + """,
n AS (SELECT 'weather' AS source, COUNT(*) AS rows FROM d_weather UNION ALL SELECT 'holidays', COUNT(*) FROM d_holidays
      UNION ALL SELECT 'sports', COUNT(*) FROM d_games UNION ALL SELECT 'paydays', COUNT(*) FROM paydays
      UNION ALL SELECT 'school', COUNT(*) FROM school)
SELECT string_agg(source, ', ' ORDER BY rows DESC, source) AS key_factors FROM n""")
def key_factors(spark, sf_dir):
    return R.key_factors(source_row_counts(spark, sf_dir), "source", "rows")


@query("A24_A26_forecast_summary", _FC + """,
st AS (SELECT business_id, COUNT(*) AS rows, CAST(SUM(predicted_quantity) AS BIGINT) AS total,
              AVG(predicted_quantity) AS avg_per_record FROM fc GROUP BY business_id),
hi AS (SELECT * FROM (SELECT business_id, prediction_date AS peak_date, item_name AS peak_item,
         predicted_quantity AS peak_quantity, row_number() OVER (PARTITION BY business_id
         ORDER BY predicted_quantity DESC, prediction_date, item_name) AS r FROM fc) WHERE r = 1),
lo AS (SELECT * FROM (SELECT business_id, prediction_date AS low_date, item_name AS low_item,
         predicted_quantity AS low_quantity, row_number() OVER (PARTITION BY business_id
         ORDER BY predicted_quantity, prediction_date DESC, item_name DESC) AS r FROM fc) WHERE r = 1),
ab AS (SELECT fc.business_id, COUNT(*) FILTER (WHERE predicted_quantity > avg_per_record) AS days_above_average
       FROM fc JOIN st USING (business_id) GROUP BY fc.business_id)
SELECT st.business_id, rows, total, ROUND(avg_per_record, 6) AS avg_per_record, peak_date, peak_item,
       peak_quantity, low_date, low_item, low_quantity, days_above_average
FROM st JOIN hi USING (business_id) JOIN lo USING (business_id) JOIN ab USING (business_id)""")
def forecast_summary(spark, sf_dir):
    return round_doubles(R.forecast_summary(_forecast(spark, sf_dir)))


@query("A25_daily_totals", _FC + """,
t AS (SELECT business_id, prediction_date, CAST(SUM(predicted_quantity) AS BIGINT) AS total FROM fc
      WHERE prediction_date < (SELECT MIN(prediction_date) FROM fc f2 WHERE f2.business_id = fc.business_id)
                              + INTERVAL 14 DAY
      GROUP BY ALL),
b AS (SELECT business_id, arg_min(prediction_date, (-total, prediction_date)) AS best,
             arg_min(prediction_date, (total, prediction_date)) AS worst FROM t GROUP BY business_id)
SELECT t.business_id, t.prediction_date, t.total, t.prediction_date = b.best AS busiest,
       t.prediction_date = b.worst AS slowest
FROM t JOIN b USING (business_id)""")
def daily_totals(spark, sf_dir):
    return R.daily_totals(_forecast(spark, sf_dir))


@query("A27_series_points", T.with_ctes(T.SALES_SQL, T.daily_sales_sql()) + """
SELECT business_id, item_name,
       CAST(row_number() OVER (PARTITION BY business_id, item_name ORDER BY date) AS INTEGER) AS pos,
       date, quantity FROM daily""")
def series_points(spark, sf_dir):
    return R.series_points(S.daily_item_sales(T.sales(spark, sf_dir)))


@query("A29_value_counts", T.with_ctes(T.SALES_SQL) + """
SELECT * FROM (SELECT business_id, type, COUNT(*) AS count,
  CAST(row_number() OVER (PARTITION BY business_id ORDER BY COUNT(*) DESC, type) AS INTEGER) AS rank
  FROM sales GROUP BY business_id, type) WHERE rank <= 10""")
def value_counts(spark, sf_dir):
    return R.value_counts(T.sales(spark, sf_dir), "type")


@query("A30_pivot_last_days", T.with_ctes(T.SALES_SQL, T.daily_sales_sql()) + """,
mx AS (SELECT business_id, MAX(date) AS last_date FROM daily GROUP BY business_id),
r AS (SELECT d.*, 6 - date_diff('day', d.date, mx.last_date) AS k FROM daily d JOIN mx USING (business_id)
      WHERE d.date > mx.last_date - INTERVAL 7 DAY)
SELECT business_id, item_name, """ + ", ".join(
    f"COALESCE(SUM(CASE WHEN k = {i} THEN quantity END), 0.0) AS d{i}" for i in range(7)) + """
FROM r GROUP BY business_id, item_name""")
def pivot_last_days(spark, sf_dir):
    return R.pivot_last_days(S.daily_item_sales(T.sales(spark, sf_dir)))


_YEARS_FC = C.YEARS_SQL.replace("FROM sales", "FROM (SELECT date FROM sales UNION ALL SELECT date + 8 FROM sales)")


@query("A31_day_digest", _FC + ","
       + ",".join(c.strip() for c in (_YEARS_FC, C.YEAR_DAYS_SQL, C.HOLIDAYS_SQL, C.GAMES_SQL, C.SCHOOL_SQL)) + """,
days AS (SELECT business_id, prediction_date AS date, CAST(SUM(predicted_quantity) AS BIGINT) AS predicted_total
         FROM fc GROUP BY ALL),
sch AS (SELECT name, CAST(unnest(generate_series(start_date, end_date, INTERVAL 1 DAY)) AS DATE) AS date
        FROM school)
SELECT d.business_id, d.date,
  COALESCE((SELECT string_agg(name, ', ' ORDER BY name) FROM holidays h WHERE h.date = d.date), '') AS holidays,
  COALESCE((SELECT string_agg(name, ', ' ORDER BY name) FROM games g WHERE g.date = d.date), '') AS games,
  COALESCE((SELECT string_agg(name, ', ' ORDER BY name) FROM sch s WHERE s.date = d.date), '') AS school,
  d.predicted_total
FROM days d""")
def day_digest(spark, sf_dir):
    fc = _forecast(spark, sf_dir)
    sales = T.sales(spark, sf_dir)
    lo, hi = C.span_of(sales)
    years = C.years_between(spark, lo.year - 1, (hi + dt.timedelta(days=8)).year + 1)
    totals = fc.groupBy("business_id", F.col("prediction_date").alias("date")).agg(
        F.sum("predicted_quantity").alias("predicted_total"))
    days = totals.select("business_id", "date")
    return R.day_digest(days, C.holiday_calendar(years), C.games_calendar(years), C.school_calendar(years), totals)


@query("A32_distinct_orders", T.with_ctes(T.SALES_SQL) + """
SELECT business_id, COUNT(DISTINCT order_id) AS orders FROM sales GROUP BY business_id""")
def distinct_orders(spark, sf_dir):
    return R.distinct_orders(T.sales(spark, sf_dir))


@query("W13_last_messages", """
SELECT conv_id, turn, role, text, CAST(11 - rn AS INTEGER) AS _pos FROM (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS rn FROM conversations)
WHERE rn <= 10""")
def last_messages(spark, sf_dir):
    return R.last_messages(T.read_table(spark, sf_dir, "conversations"))


@query("T05_first_items", T.with_ctes(T.SALES_SQL) + """
SELECT * FROM (SELECT business_id, item_name,
  CAST(row_number() OVER (PARTITION BY business_id ORDER BY item_name) AS INTEGER) AS rank
  FROM (SELECT DISTINCT business_id, item_name FROM sales WHERE item_name IS NOT NULL)) WHERE rank <= 20""")
def first_items(spark, sf_dir):
    items = S.distinct_items(T.sales(spark, sf_dir))
    return R.top_k(items, ["business_id"], [F.col("item_name")], 20)


@query("T05_upcoming_holidays", T.with_ctes(T.SALES_SQL, C.YEARS_SQL, C.HOLIDAYS_SQL) + """,
mx AS (SELECT business_id, MAX(date) AS as_of FROM sales GROUP BY business_id)
SELECT * FROM (SELECT mx.business_id, h.date, h.name,
  CAST(row_number() OVER (PARTITION BY mx.business_id ORDER BY h.date, h.name) AS INTEGER) AS rank
  FROM mx JOIN holidays h ON h.date >= mx.as_of AND h.date <= mx.as_of + INTERVAL 30 DAY) WHERE rank <= 5""")
def upcoming_holidays(spark, sf_dir):
    sales = T.sales(spark, sf_dir)
    lo, hi = C.span_of(sales)
    hol = C.holiday_calendar(C.years_between(spark, lo.year - 1, hi.year + 1))
    mx = sales.groupBy("business_id").agg(F.max("date").alias("as_of"))
    # each as_of date sees the holidays of the next 31 days: expand as_of to its
    # window days (bounded) and equi-join with the calendar
    win = mx.select("business_id", F.explode(F.sequence("as_of", F.date_add("as_of", 30))).alias("date"))
    up = win.join(F.broadcast(hol.select("date", "name")), "date")
    return R.top_k(up, ["business_id"], [F.col("date"), F.col("name")], 5).select(
        "business_id", "date", "name", "rank")


@query("F19_factors_in_range", _FC + ","
       + ",".join(c.strip() for c in (_YEARS_FC, C.YEAR_DAYS_SQL, C.HOLIDAYS_SQL, C.GAMES_SQL, C.PAYDAYS_SQL)) + """,
sdays AS (SELECT DISTINCT prediction_date AS date FROM fc),
""" + C.WEATHER_SQL.strip() + """,
win AS (SELECT business_id, MIN(prediction_date) AS s, MAX(prediction_date) AS e FROM fc GROUP BY business_id)
SELECT w.business_id, 'holiday' AS kind, h.date, h.name FROM win w JOIN holidays h ON h.date BETWEEN w.s AND w.e
UNION ALL SELECT w.business_id, 'sports', g.date, g.name FROM win w JOIN games g ON g.date BETWEEN w.s AND w.e
UNION ALL SELECT w.business_id, 'payday', p.date, 'Payday' FROM win w
  JOIN (SELECT DISTINCT date FROM paydays) p ON p.date BETWEEN w.s AND w.e
UNION ALL SELECT business_id, 'weather', date, name FROM (
  SELECT w.business_id, x.date, CAST(x.weather_code AS VARCHAR) AS name,
         row_number() OVER (PARTITION BY w.business_id ORDER BY x.date) AS r
  FROM win w JOIN weather x ON x.date BETWEEN w.s AND w.e) WHERE r <= 5""")
def factors_in_range(spark, sf_dir):
    fc = _forecast(spark, sf_dir)
    sales = T.sales(spark, sf_dir)
    lo, hi = C.span_of(sales)
    years = C.years_between(spark, lo.year - 1, (hi + dt.timedelta(days=8)).year + 1)
    fdays = fc.select(F.col("prediction_date").alias("date")).distinct()
    weather = C.weather_calendar(fdays)
    win = fc.groupBy("business_id").agg(F.min("prediction_date").alias("s"), F.max("prediction_date").alias("e"))
    wdays = win.select("business_id", F.explode(F.sequence("s", "e")).alias("date"))

    def in_window(df, kind, name):
        return df.join(wdays, "date").select("business_id", F.lit(kind).alias("kind"), "date",
                                                          name.alias("name"))

    parts = [in_window(C.holiday_calendar(years), "holiday", F.col("name")),
             in_window(C.games_calendar(years), "sports", F.col("name")),
             in_window(C.payday_calendar(years).select("date").distinct(), "payday", F.lit("Payday")),
             R.top_k(in_window(weather, "weather", F.col("weather_code").cast("string")), ["business_id"],
                     [F.col("date")], 5).drop("rank")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
