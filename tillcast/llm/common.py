"""Session-side helpers of the subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.session import ship_package

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """A-Z to a-z, other letters unchanged."""
    return F.translate(c, UPPER, UPPER.lower())


def prepare(spark: SparkSession) -> None:
    """Called by every operator before it starts work.

    The Python workers get this package, and Spark deletes a query's shuffle
    files when the query ends: every stage of the operators ends in a written
    table, which is what later stages read.
    """
    ship_package(spark)
    spark.conf.set("spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")
