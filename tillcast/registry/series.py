"""Registered queries: daily series, lags, spans, gaps (A-01..A-04, A-12, W-01..W-06, J-20, F-20)."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series as S
from ..sources import tables as T
from ..util import round_doubles
from . import query

_DAILY = T.with_ctes(T.SALES_SQL, T.daily_sales_sql())

LAG_CTES = """m AS (SELECT business_id, AVG(quantity) AS mean_q FROM daily GROUP BY business_id),
w AS (
  SELECT d.*,
    LAG(quantity, 1) OVER win AS l1,
    LAG(quantity, 7) OVER win AS l7,
    AVG(quantity) OVER (win ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS r7,
    AVG(quantity) OVER (win ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS r30,
    STDDEV_SAMP(quantity) OVER (win ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS s7
  FROM daily d
  WINDOW win AS (PARTITION BY business_id, item_name ORDER BY date)
),
lagged AS (
  SELECT w.business_id, w.date, w.item_name, ROUND(w.quantity, 6) AS quantity,
    ROUND(COALESCE(l1, r7, mean_q, 0), 6) AS lag_1,
    ROUND(COALESCE(l7, r7, mean_q, 0), 6) AS lag_7,
    ROUND(COALESCE(r7, mean_q, 0), 6) AS rolling_7_avg,
    ROUND(COALESCE(r30, r7, mean_q, 0), 6) AS rolling_30_avg,
    ROUND(COALESCE(s7, r7, mean_q, 0), 6) AS rolling_7_std
  FROM w LEFT JOIN m ON w.business_id = m.business_id
)"""
_LAG_SQL = _DAILY.rstrip() + ",\n" + LAG_CTES + "\nSELECT * FROM lagged"


@query("W01_W06_lag_features", _LAG_SQL)
def lag_features(spark, sf_dir):
    """Flagship: sales view -> daily item sales -> row lags + trailing stats.

    The series is materialised once: the window branch and the per-business
    mean branch both read it (no second scan of the line items)."""
    daily = T.daily_series(spark, sf_dir)
    return round_doubles(S.lag_features(daily))


@query("A01_daily_item_sales", _DAILY + "SELECT business_id, date, item_name, quantity FROM daily")
def daily_item_sales(spark, sf_dir):
    return S.daily_item_sales(T.sales(spark, sf_dir))


@query("A02_data_span", T.with_ctes(T.SALES_SQL) + """
SELECT business_id, MIN(date) AS min_date, MAX(date) AS max_date,
       CAST(year(MIN(date)) AS INTEGER) AS first_year
FROM sales GROUP BY business_id""")
def data_span(spark, sf_dir):
    return S.data_span(T.sales(spark, sf_dir))


@query("A03_distinct_items", T.with_ctes(T.SALES_SQL) + """
SELECT DISTINCT business_id, item_name FROM sales WHERE item_name IS NOT NULL""")
def distinct_items(spark, sf_dir):
    return S.distinct_items(T.sales(spark, sf_dir))


@query("A04_global_average", _DAILY + """
SELECT business_id, ROUND(AVG(quantity), 6) AS global_avg FROM daily GROUP BY business_id""")
def global_average(spark, sf_dir):
    return round_doubles(S.business_mean(S.daily_item_sales(T.sales(spark, sf_dir))))


@query("A12_avg_daily_quantity", _DAILY + """
SELECT business_id, item_name, ROUND(AVG(quantity), 6) AS avg_daily_qty
FROM daily GROUP BY business_id, item_name""")
def avg_daily_quantity(spark, sf_dir):
    return round_doubles(S.avg_daily_quantity(S.daily_item_sales(T.sales(spark, sf_dir))))


@query("J20_T07_missing_dates", T.with_ctes(T.SALES_SQL) + """,
obs AS (SELECT DISTINCT business_id, date FROM sales WHERE date IS NOT NULL),
span AS (SELECT business_id, MIN(date) AS lo, MAX(date) AS hi FROM obs GROUP BY business_id),
cal AS (SELECT business_id, CAST(unnest(generate_series(lo, hi, INTERVAL 1 DAY)) AS DATE) AS date FROM span)
SELECT c.business_id, c.date FROM cal c
WHERE NOT EXISTS (SELECT 1 FROM obs o WHERE o.business_id = c.business_id AND o.date = c.date)""")
def missing_dates(spark, sf_dir):
    return S.missing_dates(T.sales(spark, sf_dir))


@query("F20_history_cutoff", _DAILY + """,
mx AS (SELECT business_id, MAX(date) AS max_date FROM daily GROUP BY business_id)
SELECT d.business_id, d.date, d.item_name, d.quantity
FROM daily d JOIN mx ON d.business_id = mx.business_id
WHERE d.date >= mx.max_date - INTERVAL 60 DAY""")
def history_cutoff(spark, sf_dir):
    return S.history_cutoff(S.daily_item_sales(T.sales(spark, sf_dir)))


@query("F05_date_string", T.with_ctes(T.SALES_SQL) + """
SELECT DISTINCT strftime(date, '%Y-%m-%d') AS date_str FROM sales""")
def date_string(spark, sf_dir):
    from ..functions.dates import date_string as ds
    return T.sales(spark, sf_dir).select(ds("date").alias("date_str")).distinct()


# Kept for the flagship entry point.
def flagship(spark, sf_dir):
    return lag_features(spark, sf_dir)


__all__ = ["flagship", "F"]
