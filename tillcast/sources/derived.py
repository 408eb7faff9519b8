"""Calendar sources derived from the given tables.

The reference fetches weather, holidays and games from web services. Here the
rows that such a service would send are aggregates of ``orders`` and ``events``,
one row per day or month that has any: real gaps, ties and skew, and work that
grows with the tables. Each view is given once as a DataFrame and once as SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .calendars import WEATHER_CODE_CYCLE
from .tables import read_table


def daily_weather(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order date: (date, temp_max, temp_min, precipitation, weather_code);
    days without a finished order have no temp_max, days without orders no row."""
    o = read_table(spark, sf_dir, "orders").where(F.col("o_orderdate").isNotNull())
    status = lambda s: F.count(F.when(F.col("o_orderstatus") == s, 1))
    codes = F.array(*[F.lit(c) for c in WEATHER_CODE_CYCLE])
    return (o.groupBy(F.to_date("o_orderdate").alias("date"))
            .agg(F.count("*").alias("n"), status("F").alias("f"), status("O").alias("o"), status("P").alias("p"), F.max("o_orderkey").alias("k"))
            .select("date", F.when(F.col("f") > 0, 40.0 + 5 * F.col("n")).alias("temp_max"), (60.0 - 7 * F.col("o")).alias("temp_min"),
                    (6.5 * F.col("p")).alias("precipitation"),
                    F.element_at(codes, (F.col("k") % len(WEATHER_CODE_CYCLE) + 1).cast("int")).cast("int").alias("weather_code")))


def monthly_holidays(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The day of each month's dearest order: (date, name, type, seq)."""
    o = read_table(spark, sf_dir, "orders").where(F.col("o_orderdate").isNotNull() & F.col("o_totalprice").isNotNull())
    best = F.struct("o_totalprice", "o_orderkey")
    return (o.groupBy(F.trunc("o_orderdate", "month").alias("month"))
            .agg(F.max_by(F.to_date("o_orderdate"), best).alias("date"), F.max_by("o_orderkey", best).alias("k"))
            .select("date", F.concat(F.lit("Order "), F.col("k").cast("string")).alias("name"), F.lit("Public").alias("type"), F.lit(0).alias("seq")))


def daily_games(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each day's last event: (date, name, home_team, away_team, venue)."""
    ev = read_table(spark, sf_dir, "events").where(F.col("ts").isNotNull())
    return (ev.groupBy(F.to_date("ts").alias("date")).agg(F.max("event_id").alias("e"))
            .select("date", F.concat(F.lit("Event "), F.col("e").cast("string")).alias("name"),
                    F.lit(None).cast("string").alias("home_team"), F.lit(None).cast("string").alias("away_team"), F.lit("Unknown").alias("venue")))


DERIVED_SQL = """
d_weather AS (
  SELECT CAST(o_orderdate AS DATE) AS date,
         CAST(CASE WHEN COUNT(*) FILTER (WHERE o_orderstatus = 'F') > 0 THEN 40 + 5 * COUNT(*) END AS DOUBLE) AS temp_max,
         CAST(60 - 7 * COUNT(*) FILTER (WHERE o_orderstatus = 'O') AS DOUBLE) AS temp_min,
         CAST(6.5 * COUNT(*) FILTER (WHERE o_orderstatus = 'P') AS DOUBLE) AS precipitation,
         CAST([0, 1, 2, 3, 45, 61, 71, 95][CAST(MAX(o_orderkey) % 8 AS INTEGER) + 1] AS INTEGER) AS weather_code
  FROM orders WHERE o_orderdate IS NOT NULL GROUP BY CAST(o_orderdate AS DATE)),
d_holidays AS (
  SELECT CAST(arg_max(o_orderdate, (o_totalprice, o_orderkey)) AS DATE) AS date,
         'Order ' || CAST(arg_max(o_orderkey, (o_totalprice, o_orderkey)) AS VARCHAR) AS name, 'Public' AS type
  FROM orders WHERE o_orderdate IS NOT NULL AND o_totalprice IS NOT NULL GROUP BY date_trunc('month', o_orderdate)),
d_games AS (
  SELECT CAST(ts AS DATE) AS date, 'Event ' || CAST(MAX(event_id) AS VARCHAR) AS name, 'Unknown' AS venue
  FROM events WHERE ts IS NOT NULL GROUP BY CAST(ts AS DATE))"""
