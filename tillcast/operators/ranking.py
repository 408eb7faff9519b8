"""Positions in a sorted order, computed without a window over a whole group.

A range-partitioned sort lays the rows out in order, the rows of every
partition are counted, and running sums of those counts turn a row's place in
its partition into its place in its group. A group of any size is spread over
as many partitions as its rows need; the only window runs over one row per
(group, partition).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tillcast.session import cut_lineage


def with_position(df: DataFrame, group: Sequence[str], order: Sequence[Column | str], position: str = "pos",
                  size: str | None = None) -> DataFrame:
    """``df`` with the 0-based place of each row among the rows of its group (NULLs are one group each).

    ``order`` are column names or sort orders; rows that tie on all of them get
    different, arbitrary places. ``size`` names a further column for the number
    of rows in the group. Rows come from a written table, so the places do not
    change when they are read again.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = [F.col(g).asc_nulls_first() for g in group] + [F.col(o) if isinstance(o, str) else o for o in order]
    tie = F.monotonically_increasing_id()  # equal rows may lie in different partitions
    laid = (df.withColumn("__tie", tie).repartitionByRange(partitions, *keys, F.col("__tie"))
            .sortWithinPartitions(*keys, "__tie").drop("__tie")
            .withColumn("__part", F.spark_partition_id()).withColumn("__seq", F.monotonically_increasing_id()))
    laid = cut_lineage(laid, "positions")
    per = Window.partitionBy(*[f"__g{i}" for i in range(len(group))])
    parts = (laid.groupBy(*[F.col(g).alias(f"__g{i}") for i, g in enumerate(group)], F.col("__part").alias("__p"))
             .agg(F.min("__seq").alias("__first"), F.count("*").alias("__rows"))
             .withColumn("__before", F.coalesce(
                 F.sum("__rows").over(per.orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
             .withColumn("__size", F.sum("__rows").over(per)))
    on = F.col("__part") == F.col("__p")
    for i, g in enumerate(group):
        on = on & F.col(g).eqNullSafe(F.col(f"__g{i}"))
    out = laid.join(parts, on)
    added = {position: F.col("__before") + F.col("__seq") - F.col("__first")}
    if size:
        added[size] = F.col("__size")
    return out.withColumns(added).select(*df.columns, *added)


def dense_codes(df: DataFrame, group: Sequence[str], value: str, code: str) -> DataFrame:
    """One row per (group, value) with the value's 0-based place among the distinct values of its group."""
    return with_position(df.select(*group, value).distinct(), group, [value], code)
