"""Registered queries: anomaly context, group statistics, outliers, summary.

A-22, W-10, F-13..F-16, M-14.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import series as S
from ..plans.analysis import analyze
from ..plans.features import Calendars
from ..sources import calendars as C
from ..sources import tables as T
from ..session import cut_lineage
from ..util import round_doubles
from . import query


def _ctx_sql(source: str, time_block: str, exact_mean: bool = False) -> str:
    # exact_mean: amounts with 2 decimals -> the group mean from integer cents,
    # half-up at 6 decimals (what Spark's decimal avg returns), not a float sum
    gm = ("CAST((2 * SUM(CAST(round(quantity * 100) AS BIGINT)) OVER grp * 10000 + COUNT(*) OVER grp)"
          " // (2 * COUNT(*) OVER grp) AS DOUBLE) / 1000000" if exact_mean else "AVG(quantity) OVER grp")
    return f""",
ctx AS (
  SELECT d.business_id, d.date, d.item_name, d.quantity, dayname(d.date) AS day_of_week,
    {time_block} AS time_block,
    CASE WHEN COALESCE(w.precipitation, 0) > 10 THEN 'rain'
         WHEN COALESCE(w.temp_max, 70) > 95 OR COALESCE(w.temp_min, 50) < 20 THEN 'extreme_temp'
         ELSE 'normal' END AS weather_type,
    h.name IS NOT NULL AS is_holiday, h.name AS holiday_name,
    g.name IS NOT NULL AS has_sports, g.name AS sports_event,
    EXISTS (SELECT 1 FROM paydays p WHERE p.date = d.date) AS is_payday
  FROM {source} d LEFT JOIN weather w ON d.date = w.date
  LEFT JOIN (SELECT date, arg_max(name, seq) AS name FROM holidays GROUP BY date) h ON d.date = h.date
  LEFT JOIN (SELECT date, max(name) AS name FROM games GROUP BY date) g ON d.date = g.date
),
st AS (
  SELECT *, {gm} AS gm, STDDEV_SAMP(quantity) OVER grp AS gs, COUNT(*) OVER grp AS gn
  FROM ctx
  WINDOW grp AS (PARTITION BY business_id, item_name, day_of_week, time_block, weather_type, is_holiday, has_sports)
),
outl AS (
  SELECT business_id, date, item_name AS item, CAST(trunc(quantity) AS INTEGER) AS quantity,
    day_of_week AS group_day_of_week, time_block AS group_time_block, weather_type AS group_weather_type,
    is_holiday AS group_is_holiday, has_sports AS group_has_sports,
    ROUND(gm, 6) AS group_mean, ROUND(gs, 6) AS group_std,
    printf('%.0f - %.0f', round_even(GREATEST(0.0, gm - 2 * gs), 0), round_even(gm + 2 * gs, 0)) AS expected_range,
    round_even(abs(quantity - gm) / gs, 2) AS z_score, 'grouped_outlier' AS type,
    holiday_name AS context_holiday, sports_event AS context_sports, is_payday AS context_payday
  FROM st WHERE gn >= 4 AND gs <> 0 AND abs(quantity - gm) / gs > 2.5
)"""


_DAILY_CTX = T.with_ctes(T.SALES_SQL, T.daily_sales_sql(), *C.ALL_CALENDARS_SQL).rstrip() + _ctx_sql(
    "daily", "'all_day'")

_TIMED_CAL = (C.YEARS_SQL.replace("FROM sales", "FROM timed_sales"), C.YEAR_DAYS_SQL, C.PAYDAYS_SQL,
              C.HOLIDAYS_SQL, C.GAMES_SQL, C.SPAN_DAYS_SQL.replace("FROM sales", "FROM timed_sales"),
              C.WEATHER_SQL)
_MIN = "(CAST(split_part(time, ':', 1) AS INTEGER) * 60 + CAST(split_part(time, ':', 2) AS INTEGER))"
_TB = f"""CASE WHEN {_MIN} >= 360 AND {_MIN} < 660 THEN 'morning'
       WHEN {_MIN} >= 660 AND {_MIN} < 960 THEN 'afternoon'
       WHEN {_MIN} >= 960 AND {_MIN} < 1200 THEN 'evening'
       WHEN {_MIN} >= 1200 AND {_MIN} < 1439 THEN 'night' ELSE 'other' END"""
_TIMED_CTX = T.with_ctes(T.TIMED_SALES_SQL, *_TIMED_CAL).rstrip() + _ctx_sql("timed_sales", _TB, exact_mean=True)


def _daily_ctx(spark, sf_dir):
    daily = cut_lineage(S.daily_item_sales(T.sales(spark, sf_dir)))
    cal = Calendars.for_data(daily)
    return daily, cal, Q.add_context(daily, cal.days, cal.weather, cal.holidays, cal.games, cal.paydays)


@query("A22_group_stats", _DAILY_CTX + """
SELECT business_id, item_name, day_of_week, time_block, weather_type, is_holiday, has_sports,
       ROUND(AVG(quantity), 6) AS group_mean, ROUND(STDDEV_SAMP(quantity), 6) AS group_std,
       COUNT(*) AS group_rows
FROM ctx GROUP BY ALL""")
def group_stats(spark, sf_dir):
    return round_doubles(Q.group_stats(_daily_ctx(spark, sf_dir)[2]))


@query("W10_F07_F13_F14_grouped_outliers", _DAILY_CTX + "\nSELECT * FROM outl")
def grouped_outliers(spark, sf_dir):
    return round_doubles(Q.grouped_outliers(_daily_ctx(spark, sf_dir)[2]))


@query("W10_F06_grouped_outliers_timed", _TIMED_CTX + "\nSELECT * FROM outl")
def grouped_outliers_timed(spark, sf_dir):
    """Event values are 2-decimal amounts: read them as DECIMAL(18,2) so group
    means are exact (decimal avg) instead of depending on float summation order."""
    timed = T.timed_sales(spark, sf_dir).withColumn("quantity", F.col("quantity").cast("decimal(18,2)"))
    out = analyze(timed).outliers
    return round_doubles(out.withColumn("group_mean", F.col("group_mean").cast("double"))
                         .withColumn("group_std", F.col("group_std").cast("double")))


@query("M14_F15_F16_quality_summary", _DAILY_CTX + """,
obs AS (SELECT DISTINCT business_id, date FROM daily),
span AS (SELECT business_id, MIN(date) AS lo, MAX(date) AS hi FROM obs GROUP BY business_id),
cal AS (SELECT business_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span),
miss AS (SELECT c.business_id, COUNT(*) AS n FROM cal c
         WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.business_id = c.business_id AND o.date = c.date)
         GROUP BY c.business_id),
oc AS (SELECT business_id, COUNT(*) AS n FROM outl GROUP BY business_id),
tot AS (SELECT business_id, COUNT(*) AS n FROM daily GROUP BY business_id),
s AS (
  SELECT t.business_id, t.n AS total_rows, COALESCE(o.n, 0) AS outlier_count, COALESCE(m.n, 0) AS missing_date_count
  FROM tot t LEFT JOIN oc o USING (business_id) LEFT JOIN miss m USING (business_id)
)
SELECT business_id, total_rows, outlier_count + missing_date_count AS total_anomalies, outlier_count,
  missing_date_count,
  CASE WHEN total_rows = 0 THEN 'no_data'
       WHEN (outlier_count + missing_date_count) / total_rows < 0.01 THEN 'excellent'
       WHEN (outlier_count + missing_date_count) / total_rows < 0.03 THEN 'good'
       WHEN (outlier_count + missing_date_count) / total_rows < 0.05 THEN 'fair' ELSE 'poor' END AS data_quality,
  CASE WHEN missing_date_count > total_rows * 0.1 THEN 'Too many missing dates. Fill gaps before training.'
       WHEN outlier_count > total_rows * 0.05
         THEN 'High number of outliers. Review flagged data points before training.'
       WHEN outlier_count > 0
         THEN printf('Found %d outliers. Review them, but okay to proceed with training.', outlier_count)
       ELSE 'Data looks clean. Ready for training.' END AS recommendation
FROM s""")
def quality_summary(spark, sf_dir):
    daily = cut_lineage(S.daily_item_sales(T.sales(spark, sf_dir)))
    return analyze(daily, Calendars.for_data(daily)).summary
