"""Forecast-side plan: grid, calendar lags from history, fallbacks, scoring.

J-13, J-24, W-07, W-08, M-09.

Calendar windows over the history (W-07: rows with d-7 <= h.date < d) are
computed without a theta join: every history row is expanded once to the (at
most 30) forecast dates that see it and aggregated per (business, item, date).
Work is history x 30, and a hot item never meets more than its own 60 days of
history.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scalars import round_prediction
from ..operators import series as S
from ..util import with_business

KEYS = ["business_id", "item_name"]


def forecast_grid(daily: DataFrame, days: int = 7, start=None, items: DataFrame | None = None,
                  offset: int = 1) -> DataFrame:
    """J-13: every item x every date from ``start`` to ``start + days``
    (inclusive, so days + 1 dates, Q18). ``start`` defaults to the business's
    last date + ``offset`` (1: the day after). Rows come from
    ``explode(sequence)`` per item: no cross join."""
    d, _ = with_business(daily)
    its = items if items is not None else d.select(*KEYS).distinct()
    if start is None:
        last = d.groupBy("business_id").agg(F.date_add(F.max("date"), offset).alias("_start"))
        its = its.join(last, "business_id")
    else:
        its = its.withColumn("_start", F.to_date(F.lit(start)))
    return its.select("business_id", F.explode(F.sequence("_start", F.date_add("_start", days))).alias(
        "prediction_date"), "item_name")


def naive_forecast(daily: DataFrame, days: int = 7) -> DataFrame:
    """Grid with each item's average daily quantity as the forecast (rounded, floored)."""
    grid = forecast_grid(daily, days)
    avg = S.avg_daily_quantity(daily)
    return grid.join(avg, KEYS).select(
        "business_id", "prediction_date", "item_name",
        round_prediction("avg_daily_qty").alias("predicted_quantity"))


def _calendar_lags(hist: DataFrame, grid: DataFrame) -> DataFrame:
    """W-07 / J-24 in one aggregate: per (item, d) of the grid's span, mean / std
    / count of the history of d-7..d-1, mean / count of d-30..d-1, and the
    quantities of d-1 and d-7. Every history row is expanded once, to the at
    most 30 forecast dates that can see it, and only to dates of the grid."""
    span = grid.groupBy("business_id").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    first, last = F.greatest(F.date_add("date", 1), F.col("_lo")), F.least(F.date_add("date", 30), F.col("_hi"))
    ex = (hist.join(span, "business_id").where(first <= last)
          .select(*KEYS, "quantity", F.col("date").alias("_from"), F.explode(F.sequence(first, last)).alias("date"))
          .withColumn("_ago", F.datediff("date", "_from")))
    week = F.when(F.col("_ago") <= 7, F.col("quantity"))
    return ex.groupBy(*KEYS, "date").agg(
        F.avg(week).alias("r7_mean"), F.stddev_samp(week).alias("r7_std"), F.count(week).alias("r7_n"),
        F.avg("quantity").alias("r30_mean"), F.count("quantity").alias("r30_n"),
        F.max(F.when(F.col("_ago") == 1, F.col("quantity"))).alias("_q1"),
        F.max(F.when(F.col("_ago") == 7, F.col("quantity"))).alias("_q7"))


def forecast_lags(grid: DataFrame, daily: DataFrame, fallback: DataFrame | None = None,
                  history_days: int = 60) -> DataFrame:
    """J-24 / W-07 / W-08: lag and rolling features for forecast rows.

    ``grid``: (business_id, date, item_name). History = last ``history_days``
    days of ``daily`` (F-20). ``fallback``: (business_id, item_name, fallback_qty)
    for items without history (J-23); else the business mean is used.
    """
    g, added = with_business(grid)
    hist = S.history_cutoff(daily, history_days).select(*KEYS, "date", "quantity")
    hist, _ = with_business(hist)
    stats = hist.groupBy(*KEYS).agg(
        F.avg("quantity").alias("h_mean"), F.stddev_samp("quantity").alias("h_std"),
        F.count("quantity").alias("h_n"), F.max_by("quantity", "date").alias("h_last"))
    j = g.join(stats, KEYS, "left").join(_calendar_lags(hist, g), [*KEYS, "date"], "left")
    gmean = S.business_mean(daily, name="_gmean")
    j = j.join(gmean, "business_id", "left")
    if fallback is not None:
        j = j.join(fallback.select(*KEYS, F.col("fallback_qty").alias("_fb")), KEYS, "left")
    else:
        j = j.withColumn("_fb", F.col("_gmean"))
    has_hist = F.coalesce(F.col("h_n"), F.lit(0)) > 0
    fb = F.coalesce(F.col("_fb"), F.col("_gmean"))

    def std_or(std, n, mean):
        return F.when(n > 1, std).otherwise(mean * 0.2)

    lag1 = F.coalesce(F.col("_q1"), F.col("h_last"))
    lag7 = F.coalesce(F.col("_q7"), lag1)
    r7m = F.when(F.coalesce(F.col("r7_n"), F.lit(0)) > 0, F.col("r7_mean")).otherwise(F.col("h_mean"))
    r7s = F.when(F.coalesce(F.col("r7_n"), F.lit(0)) > 0, std_or(F.col("r7_std"), F.col("r7_n"), F.col("r7_mean"))
                 ).otherwise(std_or(F.col("h_std"), F.col("h_n"), F.col("h_mean")))
    r30m = F.when(F.coalesce(F.col("r30_n"), F.lit(0)) > 0, F.col("r30_mean")).otherwise(F.col("h_mean"))
    g_ = F.col("_gmean")
    out = j.select(
        *g.columns,
        F.coalesce(F.when(has_hist, lag1).otherwise(fb), g_).alias("lag_1"),
        F.coalesce(F.when(has_hist, lag7).otherwise(fb), g_).alias("lag_7"),
        F.coalesce(F.when(has_hist, r7m).otherwise(fb), g_).alias("rolling_7_avg"),
        F.coalesce(F.when(has_hist, r30m).otherwise(fb), g_).alias("rolling_30_avg"),
        F.coalesce(F.when(has_hist, r7s).otherwise(fb * 0.2), g_).alias("rolling_7_std"),
    )
    return out.drop("business_id") if added else out
