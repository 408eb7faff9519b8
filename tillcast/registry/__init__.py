"""Registered queries: one Spark callable and (where SQL can express it) one
oracle SQL text per operator of the inventory, keyed by the inventory ID.

Every query reads the driver tables under ``sf_dir`` (or what Spark derives
from them) in full; results are compared with DuckDB running the SQL text on
the same parquet files.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QueryFn = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, QueryFn] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn`` under ``name``; ``sql`` is its DuckDB oracle (None = rows-only check)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"duplicate query {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE[name] = sql
        return fn
    return deco


def load_all() -> tuple[dict[str, QueryFn], dict[str, str]]:
    # Importing the modules fills the two dicts.
    from . import (calendars, forecasting, ingest, items, merges, providers, quality, reports,  # noqa: F401
                   series, streams)
    return dict(QUERIES), dict(ORACLE)
