"""Registered queries: calendars, date/time functions, calendar joins, features.

S-22..S-24, F-01..F-12, J-01..J-12, J-25, W-09, M-01.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import blocks as B
from ..functions import dates as D
from ..functions import scalars as X
from ..operators import calendar_joins as J
from ..plans import features as FE
from ..sources import calendars as C
from ..sources import derived as V
from ..sources import tables as T
from ..util import round_doubles
from . import query

_CAL = T.with_ctes(T.SALES_SQL, T.daily_sales_sql(), *C.ALL_CALENDARS_SQL)


def _cal(spark, sf_dir):
    """(daily series, calendars): the series is materialised once and both the
    span (for the calendars) and the join input read it."""
    daily = T.daily_series(spark, sf_dir)
    return daily, FE.Calendars.for_data(daily)


def _daily(daily):
    return daily.select("business_id", "date", "item_name")


# ------------------------------------------------------------ calendars

@query("S22_T06_payday_calendar", _CAL + "SELECT date, type FROM paydays")
def payday_calendar(spark, sf_dir):
    return _cal(spark, sf_dir)[1].paydays


@query("S23_ebt_calendar", _CAL + "SELECT date, type FROM ebt")
def ebt_calendar(spark, sf_dir):
    lo, hi = C.span_of(T.sales(spark, sf_dir))
    return C.ebt_calendar(C.years_between(spark, lo.year - 1, hi.year + 1))


@query("S24_school_calendar", _CAL + "SELECT start_date, end_date, name, type FROM school")
def school_calendar(spark, sf_dir):
    return _cal(spark, sf_dir)[1].school


# ------------------------------------------------------------ date / time functions

@query("F01_F02_date_parts", _CAL + """
SELECT DISTINCT date, CAST(isodow(date) - 1 AS INTEGER) AS day_of_week,
       CAST(day(date) AS INTEGER) AS day_of_month, CAST(month(date) AS INTEGER) AS month,
       CAST(weekofyear(date) AS INTEGER) AS week_of_year,
       CAST(isodow(date) IN (6, 7) AS INTEGER) AS is_weekend
FROM sales""")
def date_parts(spark, sf_dir):
    d = T.sales(spark, sf_dir).select("date").distinct()
    return d.select("date", *[v.alias(k) for k, v in D.date_parts("date").items()])


@query("F03_cyclical_encoding", _CAL + """
SELECT DISTINCT date,
  ROUND(sin(2 * pi() * (isodow(date) - 1) / 7), 6) + 0.0 AS day_of_week_sin,
  ROUND(cos(2 * pi() * (isodow(date) - 1) / 7), 6) + 0.0 AS day_of_week_cos,
  ROUND(sin(2 * pi() * month(date) / 12), 6) + 0.0 AS month_sin,
  ROUND(cos(2 * pi() * month(date) / 12), 6) + 0.0 AS month_cos
FROM sales""")
def cyclical(spark, sf_dir):
    d = T.sales(spark, sf_dir).select("date").distinct()
    return round_doubles(d.select("date", *[v.alias(k) for k, v in D.cyclical("date").items()]))


@query("F04_day_name", _CAL + "SELECT DISTINCT date, dayname(date) AS day_name FROM sales")
def day_name(spark, sf_dir):
    d = T.sales(spark, sf_dir).select("date").distinct()
    return d.select("date", D.day_name("date").alias("day_name"))


_MINUTES = "(CAST(split_part(time, ':', 1) AS INTEGER) * 60 + CAST(split_part(time, ':', 2) AS INTEGER))"
_BLOCK_CASE = f"""CASE WHEN {_MINUTES} >= 360 AND {_MINUTES} < 660 THEN 'morning'
       WHEN {_MINUTES} >= 660 AND {_MINUTES} < 960 THEN 'afternoon'
       WHEN {_MINUTES} >= 960 AND {_MINUTES} < 1200 THEN 'evening'
       WHEN {_MINUTES} >= 1200 AND {_MINUTES} < 1439 THEN 'night' ELSE 'other' END"""


@query("F06_time_block", T.with_ctes(T.TIMED_SALES_SQL) + f"""
SELECT order_id, time, {_BLOCK_CASE} AS time_block FROM timed_sales""")
def time_block(spark, sf_dir):
    ts = T.timed_sales(spark, sf_dir)
    return ts.select("order_id", "time", B.time_block("time").alias("time_block"))


@query("F08_time_block_code", T.with_ctes(T.TIMED_SALES_SQL) + f"""
SELECT order_id, CAST(CASE {_BLOCK_CASE} WHEN 'morning' THEN 0 WHEN 'afternoon' THEN 1
  WHEN 'evening' THEN 2 WHEN 'night' THEN 3 ELSE 4 END AS INTEGER) AS time_block_encoded
FROM timed_sales""")
def time_block_code(spark, sf_dir):
    ts = T.timed_sales(spark, sf_dir)
    return ts.select("order_id", B.time_block_code(B.time_block("time")).alias("time_block_encoded"))


@query("F09_parse_hour", T.with_ctes(T.TIMED_SALES_SQL) + """
SELECT order_id, CAST(hour(strptime(time, '%H:%M')) AS INTEGER) AS hour FROM timed_sales""")
def parse_hour(spark, sf_dir):
    ts = T.timed_sales(spark, sf_dir)
    return ts.select("order_id", D.parse_hour("time").alias("hour"))


@query("F10_weather_type", T.with_ctes(V.DERIVED_SQL) + """
SELECT date, CASE WHEN COALESCE(precipitation, 0) > 10 THEN 'rain'
  WHEN COALESCE(temp_max, 70) > 95 OR COALESCE(temp_min, 50) < 20 THEN 'extreme_temp'
  ELSE 'normal' END AS weather_type
FROM d_weather""")
def weather_type(spark, sf_dir):
    w = V.daily_weather(spark, sf_dir)
    return w.select("date", X.weather_type("precipitation", "temp_max", "temp_min").alias("weather_type"))


_WMO_CASE = "CASE weather_code " + " ".join(
    f"WHEN {k} THEN '{v}'" for k, v in X.WEATHER_CODES.items()) + " ELSE 'Unknown' END"


@query("F11_weather_description", T.with_ctes(V.DERIVED_SQL) + f"""
SELECT date, weather_code, {_WMO_CASE} AS description FROM d_weather""")
def weather_description(spark, sf_dir):
    w = V.daily_weather(spark, sf_dir)
    return w.select("date", "weather_code", X.weather_description("weather_code").alias("description"))


# ------------------------------------------------------------ calendar joins

_WJ = """,
wj AS (
  SELECT d.business_id, d.date, d.item_name,
         w.temp_max, w.temp_min, w.precipitation, CAST(w.weather_code AS DOUBLE) AS weather_code,
         CASE WHEN w.temp_max IS NULL THEN 1 ELSE 0 END AS weather_missing
  FROM daily d LEFT JOIN weather w ON d.date = w.date
)"""


@query("J01_weather_join", _CAL.rstrip() + _WJ + "\nSELECT * FROM wj")
def weather_join(spark, sf_dir):
    daily, cal = _cal(spark, sf_dir)
    return J.weather_join(_daily(daily), cal.weather)


_FILL = _WJ + """,
mo AS (SELECT business_id, month(date) AS m, AVG(temp_max) AS a1, AVG(temp_min) AS a2,
              AVG(precipitation) AS a3, AVG(weather_code) AS a4 FROM wj GROUP BY ALL),
s1 AS (
  SELECT wj.business_id, wj.date, wj.item_name, wj.weather_missing,
         COALESCE(wj.temp_max, mo.a1) AS temp_max, COALESCE(wj.temp_min, mo.a2) AS temp_min,
         COALESCE(wj.precipitation, mo.a3) AS precipitation, COALESCE(wj.weather_code, mo.a4) AS weather_code
  FROM wj LEFT JOIN mo ON wj.business_id = mo.business_id AND month(wj.date) = mo.m
),
md AS (SELECT business_id, MEDIAN(temp_max) AS q1, MEDIAN(temp_min) AS q2,
              MEDIAN(precipitation) AS q3, MEDIAN(weather_code) AS q4 FROM s1 GROUP BY business_id),
filled AS (
  SELECT s1.business_id, s1.date, s1.item_name, s1.weather_missing,
         COALESCE(s1.temp_max, md.q1, 70.0) AS temp_max, COALESCE(s1.temp_min, md.q2, 50.0) AS temp_min,
         COALESCE(s1.precipitation, md.q3, 0.0) AS precipitation,
         COALESCE(s1.weather_code, md.q4, 0.0) AS weather_code
  FROM s1 LEFT JOIN md ON s1.business_id = md.business_id
)"""


@query("W09_weather_fill", _CAL.rstrip() + _FILL + """
SELECT business_id, date, item_name, weather_missing, ROUND(temp_max, 6) AS temp_max,
       ROUND(temp_min, 6) AS temp_min, ROUND(precipitation, 6) AS precipitation,
       ROUND(weather_code, 6) AS weather_code FROM filled""")
def weather_fill(spark, sf_dir):
    daily = T.daily_series(spark, sf_dir).select("business_id", "date", "item_name")
    cal = FE.Calendars.for_data(daily)
    return round_doubles(J.fill_weather(J.weather_join(daily, cal.weather)))


def _flag_sql(cal_table: str, name: str, extra: str = "") -> str:
    return _CAL + f"""
SELECT d.business_id, d.date, d.item_name,
  CAST(EXISTS (SELECT 1 FROM {cal_table} c WHERE c.date = d.date{extra}) AS INTEGER) AS {name}
FROM daily d"""


@query("J02_holiday_flag", _flag_sql("holidays", "is_holiday"))
def holiday_flag(spark, sf_dir):
    daily, cal = _cal(spark, sf_dir)
    return J.date_flag(_daily(daily), cal.holidays, "is_holiday")


@query("J03_holiday_name", _CAL + """
SELECT d.business_id, d.date, d.item_name, h.name IS NOT NULL AS is_holiday, h.name AS holiday_name
FROM daily d LEFT JOIN (SELECT date, arg_max(name, seq) AS name FROM holidays GROUP BY date) h
  ON d.date = h.date""")
def holiday_name(spark, sf_dir):
    daily, cal = _cal(spark, sf_dir)
    return J.date_flag_named(_daily(daily), cal.holidays, "is_holiday", "holiday_name")


@query("J04_sports_flag", _flag_sql("games", "has_sports"))
def sports_flag(spark, sf_dir):
    daily, cal = _cal(spark, sf_dir)
    return J.date_flag(_daily(daily), cal.games, "has_sports")


@query("J05_sports_event", _CAL + """
SELECT d.business_id, d.date, d.item_name, g.name IS NOT NULL AS has_sports, g.name AS sports_event
FROM daily d LEFT JOIN (SELECT date, max(name) AS name FROM games GROUP BY date) g ON d.date = g.date""")
def sports_event(spark, sf_dir):
    daily, cal = _cal(spark, sf_dir)
    return J.date_flag_named(_daily(daily), cal.games, "has_sports", "sports_event", order_col=None)


@query("J06_payday_flag", _CAL + """
SELECT d.business_id, d.date, d.item_name,
  CAST(EXISTS (SELECT 1 FROM paydays c WHERE c.date = d.date) AS INTEGER) AS is_payday,
  EXISTS (SELECT 1 FROM paydays c WHERE c.date = d.date) AS is_payday_bool
FROM daily d""")
def payday_flag(spark, sf_dir):
    daily, cal = _cal(spark, sf_dir)
    df = J.date_flag(_daily(daily), cal.paydays, "is_payday")
    return df.withColumn("is_payday_bool", F.col("is_payday") == 1)


def _asof_sql(cal_table: str, name: str, cap: int, forward: bool) -> str:
    if forward:
        near = f"(SELECT MIN(c.date) FROM {cal_table} c WHERE c.date >= d.date)"
        dist = f"date_diff('day', d.date, {near})"
    else:
        near = f"(SELECT MAX(c.date) FROM {cal_table} c WHERE c.date <= d.date)"
        dist = f"date_diff('day', {near}, d.date)"
    return _CAL + f"""
SELECT d.business_id, d.date, d.item_name,
  CAST(LEAST(GREATEST(COALESCE({dist}, {cap}), 0), {cap}) AS INTEGER) AS {name}
FROM daily d"""


@query("J07_F12_days_to_holiday", _asof_sql("holidays", "days_to_holiday", 30, True))
def days_to_holiday(spark, sf_dir):
    daily, cal = _cal(spark, sf_dir)
    return J.days_to_next(_daily(daily), cal.holidays, "days_to_holiday", 30)


@query("J08_days_from_holiday", _asof_sql("holidays", "days_from_holiday", 30, False))
def days_from_holiday(spark, sf_dir):
    daily, cal = _cal(spark, sf_dir)
    return J.days_since_last(_daily(daily), cal.holidays, "days_from_holiday", 30)


@query("J09_days_to_payday", _asof_sql("paydays", "days_to_payday", 15, True))
def days_to_payday(spark, sf_dir):
    daily, cal = _cal(spark, sf_dir)
    return J.days_to_next(_daily(daily), cal.paydays, "days_to_payday", 15)


@query("J10_school_break", _CAL + """
SELECT d.business_id, d.date, d.item_name,
  CAST(EXISTS (SELECT 1 FROM school s WHERE s.type = 'break'
               AND d.date BETWEEN s.start_date AND s.end_date) AS INTEGER) AS is_school_break
FROM daily d""")
def school_break(spark, sf_dir):
    daily, cal = _cal(spark, sf_dir)
    return J.school_break_flag(_daily(daily), cal.school)


@query("J11_in_session", _CAL + """
SELECT DISTINCT d.date,
  NOT EXISTS (SELECT 1 FROM school s WHERE s.type = 'break' AND year(s.start_date) = year(d.date)
              AND d.date BETWEEN s.start_date AND s.end_date) AS in_session
FROM sales d""")
def in_session(spark, sf_dir):
    daily, cal = _cal(spark, sf_dir)
    return J.in_session(daily.select("date").distinct(), cal.school)


@query("J12_interval_overlap", _CAL + """,
months AS (SELECT DISTINCT CAST(date_trunc('month', date) AS DATE) AS window_start FROM sales)
SELECT m.window_start, CAST(last_day(m.window_start) AS DATE) AS window_end,
       s.start_date, s.end_date, s.name, s.type
FROM months m JOIN school s
  ON s.start_date <= last_day(m.window_start) AND s.end_date >= m.window_start""")
def interval_overlap(spark, sf_dir):
    daily, cal = _cal(spark, sf_dir)
    return J.overlapping(cal.school, J.month_windows(daily))


@query("J25_events_for_window", _CAL + """,
win AS (SELECT CAST(date_trunc('month', max(date)) AS DATE) AS window_start,
               CAST(date_trunc('month', max(date)) + INTERVAL 1 MONTH AS DATE) AS window_end FROM sales),
wd AS (SELECT window_start, CAST(unnest(generate_series(window_start, window_end, INTERVAL 1 DAY)) AS DATE) AS date
       FROM win)
SELECT wd.window_start, 'holiday' AS kind, h.date AS start_date, h.date AS end_date, h.name, h.type
  FROM holidays h JOIN wd ON h.date = wd.date
UNION ALL
SELECT wd.window_start, 'sports', g.date, g.date, g.name, 'game' FROM games g JOIN wd ON g.date = wd.date
UNION ALL
SELECT wd.window_start, 'payday', p.date, p.date, 'Payday', 'payday'
  FROM (SELECT DISTINCT date FROM paydays) p JOIN wd ON p.date = wd.date
UNION ALL
SELECT win.window_start, 'school', s.start_date, s.end_date, s.name, s.type
  FROM school s JOIN win ON s.start_date <= win.window_end AND s.end_date >= win.window_start
UNION ALL
SELECT wd.window_start, 'weather', w.date, w.date, CAST(w.weather_code AS VARCHAR), 'weather'
  FROM weather w JOIN wd ON w.date = wd.date WHERE w.date < wd.window_start + INTERVAL 14 DAY""")
def events_for_window(spark, sf_dir):
    daily, cal = _cal(spark, sf_dir)
    win = daily.agg(F.trunc(F.max("date"), "month").alias("window_start")).select(
        "window_start", F.add_months("window_start", 1).alias("window_end"))
    return J.events_for_window(win, cal.holidays, cal.games, cal.paydays, cal.school, cal.weather)


# ------------------------------------------------------------ full feature frame

_DAY_FEATS = """,
hol AS (SELECT DISTINCT date FROM holidays),
pay AS (SELECT DISTINCT date FROM paydays),
feat AS (
  SELECT f.*,
    CAST(isodow(f.date) - 1 AS INTEGER) AS day_of_week, CAST(day(f.date) AS INTEGER) AS day_of_month,
    CAST(month(f.date) AS INTEGER) AS month, CAST(weekofyear(f.date) AS INTEGER) AS week_of_year,
    CAST(isodow(f.date) IN (6, 7) AS INTEGER) AS is_weekend,
    sin(2 * pi() * (isodow(f.date) - 1) / 7) AS day_of_week_sin,
    cos(2 * pi() * (isodow(f.date) - 1) / 7) AS day_of_week_cos,
    sin(2 * pi() * month(f.date) / 12) AS month_sin, cos(2 * pi() * month(f.date) / 12) AS month_cos,
    CAST(EXISTS (SELECT 1 FROM hol c WHERE c.date = f.date) AS INTEGER) AS is_holiday,
    CAST(LEAST(COALESCE(date_diff('day', f.date, (SELECT MIN(c.date) FROM hol c WHERE c.date >= f.date)), 30), 30)
         AS INTEGER) AS days_to_holiday,
    CAST(LEAST(COALESCE(date_diff('day', (SELECT MAX(c.date) FROM hol c WHERE c.date <= f.date), f.date), 30), 30)
         AS INTEGER) AS days_from_holiday,
    CAST(EXISTS (SELECT 1 FROM games c WHERE c.date = f.date) AS INTEGER) AS has_sports,
    CAST(EXISTS (SELECT 1 FROM pay c WHERE c.date = f.date) AS INTEGER) AS is_payday,
    CAST(LEAST(COALESCE(date_diff('day', f.date, (SELECT MIN(c.date) FROM pay c WHERE c.date >= f.date)), 15), 15)
         AS INTEGER) AS days_to_payday,
    CAST(EXISTS (SELECT 1 FROM school s WHERE s.type = 'break'
                 AND f.date BETWEEN s.start_date AND s.end_date) AS INTEGER) AS is_school_break,
    CAST(DENSE_RANK() OVER (PARTITION BY f.business_id ORDER BY f.item_name) - 1 AS INTEGER) AS item_encoded
  FROM filled f
)"""

FEATURES_SQL = _CAL.rstrip() + _FILL + _DAY_FEATS  # ... feat

_FEATURE_OUT = [c for c in FE.FEATURE_COLUMNS if not c.startswith(("lag_", "rolling_"))]


@query("M01_build_features", FEATURES_SQL + "\nSELECT business_id, date, item_name, "
       + ", ".join(f"ROUND({c}, 6) + 0.0 AS {c}" if c in (
           "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos", "temp_max", "temp_min",
           "precipitation", "weather_code") else c for c in _FEATURE_OUT) + " FROM feat")
def build_features(spark, sf_dir):
    # the daily series feeds the span, the day features, the fill statistics
    # and the item codes: materialise it once (reliable checkpoint)
    daily = _daily(T.daily_series(spark, sf_dir))
    feats = FE.build_features(daily, FE.Calendars.for_data(daily))
    return round_doubles(feats.select("business_id", "date", "item_name", *_FEATURE_OUT))


@query("F28_football_event_label", _CAL + """
SELECT DISTINCT s.date,
  (isodow(s.date) = 7 AND month(s.date) IN (9, 10, 11, 12, 1)) AS is_football_day,
  CASE WHEN EXISTS (SELECT 1 FROM holidays h WHERE h.date = s.date) THEN 'Holiday'
       WHEN isodow(s.date) = 7 AND month(s.date) IN (9, 10, 11, 12, 1) THEN 'Football' ELSE '' END AS event_type
FROM sales s""")
def football_event_label(spark, sf_dir):
    """F-28 on every sales date: football Sunday flag and the event label."""
    daily, cal = _cal(spark, sf_dir)
    days = J.date_flag(daily.select("date").distinct(), cal.holidays, "_hol", as_int=False)
    football = D.football_day("date")
    return days.select("date", football.alias("is_football_day"),
                       D.event_label("_hol", football).alias("event_type"))


@query("F23_display_name", T.with_ctes(T.TIMED_SALES_SQL) + """
SELECT DISTINCT item_name AS name,
  array_to_string(list_transform(string_split(replace(item_name, '_', ' '), ' '),
                                 lambda w: upper(substring(w, 1, 1)) || substring(w, 2)), ' ') AS display_name
FROM timed_sales""")
def display_name(spark, sf_dir):
    """F-23 applied to the item names of the timed sales (event types)."""
    names = T.timed_sales(spark, sf_dir).select(F.col("item_name").alias("name")).distinct()
    return names.select("name", X.display_name("name").alias("display_name"))
