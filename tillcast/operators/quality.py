"""Data-quality operators: context columns, grouped outliers, summary.

A-22, W-10, F-13..F-16 (and J-20 via ``series.missing_dates``).

Group statistics are a ``groupBy`` (partial aggregation, so a group holding a
third of all rows is still one partial row per map task) joined back to the
rows on the group key; a skewed group key on that join is split by AQE's skew
join. No window spans a whole group.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import time_block_or_default
from ..functions.dates import day_name
from ..functions.scalars import expected_range, quality_grade, recommendation, weather_type, z_score
from ..operators import calendar_joins as J
from ..util import with_business

GROUP_COLUMNS = ("item_name", "day_of_week", "time_block", "weather_type", "is_holiday", "has_sports")


def context_day_table(days: DataFrame, weather: DataFrame | None, holidays: DataFrame | None,
                      games: DataFrame | None, paydays: DataFrame | None) -> DataFrame:
    """Per calendar day: weather type, holiday / sports flags and names, payday."""
    df = days.select("date")
    if weather is not None:
        df = J.weather_join(df, weather).select(
            "date", weather_type("precipitation", "temp_max", "temp_min").alias("weather_type"))
    else:
        df = df.withColumn("weather_type", F.lit("normal"))
    if holidays is not None:
        df = J.date_flag_named(df, holidays, "is_holiday", "holiday_name")
    else:
        df = df.select("*", F.lit(False).alias("is_holiday"), F.lit(None).cast("string").alias("holiday_name"))
    if games is not None:
        df = J.date_flag_named(df, games, "has_sports", "sports_event", order_col=None)
    else:
        df = df.select("*", F.lit(False).alias("has_sports"), F.lit(None).cast("string").alias("sports_event"))
    if paydays is not None:
        df = J.date_flag(df, paydays, "is_payday", as_int=False)
    else:
        df = df.withColumn("is_payday", F.lit(False))
    return df


def add_context(rows: DataFrame, days: DataFrame, weather=None, holidays=None, games=None, paydays=None,
                time_col: str = "time", blocks: dict | None = None) -> DataFrame:
    """M-14 step 1: day name, time block ('all_day' without a time column), and
    the per-day context (one broadcast join; the day table is bounded by the span)."""
    ctx = context_day_table(days, weather, holidays, games, paydays)
    df = rows.select("*", day_name("date").alias("day_of_week"),
                     time_block_or_default(rows.columns, time_col, blocks).alias("time_block"))
    return df.join(F.broadcast(ctx), "date", "left")


def group_stats(ctx: DataFrame, value: str = "quantity") -> DataFrame:
    """A-22: mean, sample std and row count per group (business + six keys)."""
    df, _ = with_business(ctx)
    return df.groupBy("business_id", *GROUP_COLUMNS).agg(
        F.avg(value).alias("group_mean"), F.stddev_samp(value).alias("group_std"),
        F.count(F.lit(1)).alias("group_rows"))


def grouped_outliers(ctx: DataFrame, z_threshold: float = 2.5, min_rows: int = 4,
                     value: str = "quantity", display: bool = False) -> DataFrame:
    """W-10: rows whose |x - mean| / std exceeds ``z_threshold`` within their
    group; groups under ``min_rows`` rows or with zero / NULL std are skipped (Q10).

    ``group_mean`` / ``group_std`` are full precision; ``display=True`` rounds
    them half-even to 1 decimal as the reference's report does (rounding is a
    presentation step: at exact ties it depends on float summation order)."""
    df, added = with_business(ctx)
    stats = group_stats(df, value)
    keys = ["business_id", *GROUP_COLUMNS]
    j = df.join(stats, keys)
    z = z_score(value, "group_mean", "group_std")
    flagged = j.where((F.col("group_rows") >= min_rows) & (z > z_threshold))
    out = flagged.select(
        "business_id", "date", F.col("item_name").alias("item"), F.col(value).cast("int").alias("quantity"),
        *[F.col(c).alias(f"group_{c}") for c in GROUP_COLUMNS[1:]],
        (F.bround("group_mean", 1) if display else F.col("group_mean")).alias("group_mean"),
        (F.bround("group_std", 1) if display else F.col("group_std")).alias("group_std"),
        expected_range("group_mean", "group_std").alias("expected_range"),
        F.bround(z, 2).alias("z_score"), F.lit("grouped_outlier").alias("type"),
        F.col("holiday_name").alias("context_holiday"), F.col("sports_event").alias("context_sports"),
        F.col("is_payday").alias("context_payday"))
    return out.drop("business_id") if added else out


def quality_summary(rows: DataFrame, outliers: DataFrame, missing: DataFrame) -> DataFrame:
    """M-14 summary: one row per business with counts, grade and advice."""
    r, _ = with_business(rows)
    o, _ = with_business(outliers)
    m, _ = with_business(missing)
    n = r.groupBy("business_id").agg(F.count(F.lit(1)).alias("total_rows"))
    oc = o.groupBy("business_id").agg(F.count(F.lit(1)).alias("outlier_count"))
    mc = m.groupBy("business_id").agg(F.count(F.lit(1)).alias("missing_date_count"))
    s = (n.join(oc, "business_id", "left").join(mc, "business_id", "left")
         .fillna(0, ["outlier_count", "missing_date_count"]))
    s = s.withColumn("total_anomalies", F.col("outlier_count") + F.col("missing_date_count"))
    return s.select("business_id", "total_rows", "total_anomalies", "outlier_count", "missing_date_count",
                    quality_grade("total_anomalies", "total_rows").alias("data_quality"),
                    recommendation("outlier_count", "missing_date_count", "total_rows").alias("recommendation"))
