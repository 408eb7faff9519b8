"""Daily (date, item) series and row-based lag features.

A-01..A-05, A-12, W-01..W-06, J-20, F-20.

Scale notes
-----------
* ``daily_item_sales`` is a plain ``groupBy().agg(sum)``: Spark runs a partial
  aggregate in every map task before the shuffle, so a hot item (a third of all
  line items) costs one partial row per task, not a third of the shuffle.
* Windows are partitioned by (business, item) and run on the *daily* series,
  whose groups are bounded by the number of calendar days in the data, never by
  line-item volume.
* Per-business scalars (mean, span, max date) are one row per business, joined
  back with a broadcast: the side is bounded by the number of businesses, a
  dimension, not by data volume.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..util import keys_present, with_business

BUSINESS = "business_id"
LAG_COLUMNS = ("lag_1", "lag_7", "rolling_7_avg", "rolling_30_avg", "rolling_7_std")


def daily_item_sales(sales: DataFrame, keys: Sequence[str] = ("item_name",),
                     value: str = "quantity", date_col: str = "date") -> DataFrame:
    """A-01: sum of ``value`` per (business, date, item).

    Rows with a NULL date or key are dropped first (pandas drops NULL group keys,
    Q22). A group whose values are all NULL sums to 0, as pandas does.
    """
    group = keys_present(sales, [BUSINESS]) + [date_col, *keys]
    cond = F.lit(True)
    for k in (date_col, *keys):
        cond = cond & F.col(k).isNotNull()
    return (sales.filter(cond).groupBy(*group)
            .agg(F.coalesce(F.sum(value), F.lit(0.0)).cast("double").alias(value)))


def business_mean(daily: DataFrame, value: str = "quantity", name: str = "global_avg") -> DataFrame:
    """A-04: mean daily-item quantity per business."""
    df, _ = with_business(daily)
    return df.groupBy(BUSINESS).agg(F.avg(value).alias(name))


def data_span(frame: DataFrame, date_col: str = "date") -> DataFrame:
    """A-02: first and last date and first year per business."""
    df, _ = with_business(frame)
    return (df.groupBy(BUSINESS)
            .agg(F.min(date_col).alias("min_date"), F.max(date_col).alias("max_date"))
            .withColumn("first_year", F.year("min_date")))


def distinct_items(frame: DataFrame, keys: Sequence[str] = ("item_name",)) -> DataFrame:
    """A-03: unique item names per business (NULL names dropped)."""
    df, _ = with_business(frame)
    cond = F.lit(True)
    for k in keys:
        cond = cond & F.col(k).isNotNull()
    return df.filter(cond).select(BUSINESS, *keys).distinct()


def avg_daily_quantity(daily: DataFrame, keys: Sequence[str] = ("item_name",),
                       value: str = "quantity") -> DataFrame:
    """A-12: per item, the mean of its daily sums over the days it sold."""
    df, _ = with_business(daily)
    return df.groupBy(BUSINESS, *keys).agg(F.avg(value).alias("avg_daily_qty"))


def lag_features(daily: DataFrame, keys: Sequence[str] = ("item_name",), value: str = "quantity",
                 date_col: str = "date") -> DataFrame:
    """W-01..W-06: row-based lags and trailing statistics per series.

    lag_1 / lag_7 are the previous 1st / 7th *row* of the item (not calendar
    days, Q3); rolling_7_avg, rolling_30_avg and rolling_7_std use the 7 / 30
    previous rows, current excluded, at least one row. Gaps are filled in the
    reference's column order (Q4), which works out to
    ``coalesce(x, rolling_7_avg_unfilled, business_mean, 0)`` for every column.
    """
    df, added = with_business(daily)
    part = [BUSINESS, *keys]
    w = Window.partitionBy(*part).orderBy(date_col)
    r7w, r30w = w.rowsBetween(-7, -1), w.rowsBetween(-30, -1)
    raw = df.select(
        "*",
        F.lag(value, 1).over(w).alias("_lag_1"),
        F.lag(value, 7).over(w).alias("_lag_7"),
        F.avg(value).over(r7w).alias("_r7"),
        F.avg(value).over(r30w).alias("_r30"),
        F.stddev_samp(value).over(r7w).alias("_s7"),
    )
    means = business_mean(df, value, "_mean")
    joined = raw.join(means, BUSINESS, "left")

    def fill(c: str):
        return F.coalesce(F.col(c), F.col("_r7"), F.col("_mean"), F.lit(0.0))

    out = joined.select(
        *df.columns,
        fill("_lag_1").alias("lag_1"),
        fill("_lag_7").alias("lag_7"),
        fill("_r7").alias("rolling_7_avg"),
        fill("_r30").alias("rolling_30_avg"),
        fill("_s7").alias("rolling_7_std"),
    )
    return out.drop(BUSINESS) if added else out


def missing_dates(frame: DataFrame, date_col: str = "date") -> DataFrame:
    """J-20: calendar days between a business's first and last date with no row.

    The calendar is generated per business with ``sequence`` (bounded by the
    number of days in the span) and anti-joined with the observed dates.
    """
    df, added = with_business(frame)
    observed = df.select(BUSINESS, F.col(date_col).alias("date")).where(F.col("date").isNotNull()).distinct()
    span = observed.groupBy(BUSINESS).agg(F.min("date").alias("lo"), F.max("date").alias("hi"))
    calendar = span.select(BUSINESS, F.explode(F.sequence("lo", "hi")).alias("date"))
    out = calendar.join(observed, [BUSINESS, "date"], "left_anti")
    return out.drop(BUSINESS) if added else out


def history_cutoff(daily: DataFrame, days: int = 60, date_col: str = "date") -> DataFrame:
    """F-20: keep the last ``days`` days before each business's newest date (Q24)."""
    df, added = with_business(daily)
    newest = df.groupBy(BUSINESS).agg(F.max(date_col).alias("_max_date"))
    out = (df.join(newest, BUSINESS)
           .where(F.col(date_col) >= F.date_sub("_max_date", days)).drop("_max_date"))
    return out.drop(BUSINESS) if added else out
