"""M-14: the full data-quality analysis as one plan per output table."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import quality as Q
from ..operators import series as S
from ..sources import calendars as C
from .features import Calendars


@dataclass
class Analysis:
    context: DataFrame
    outliers: DataFrame
    missing_dates: DataFrame
    summary: DataFrame


def analyze(rows: DataFrame, cal: Calendars | None = None, z_threshold: float = 2.5,
            time_col: str = "time", blocks: dict | None = None) -> Analysis:
    """Context columns -> grouped outliers (W-10) + missing dates (J-20) ->
    per-business summary with grade (F-15) and advice (F-16)."""
    cal = cal or Calendars.for_data(rows)
    days = cal.days if cal.days is not None else C.days_of(rows.select("date"))
    ctx = Q.add_context(rows, days, cal.weather, cal.holidays, cal.games, cal.paydays, time_col, blocks)
    outliers = Q.grouped_outliers(ctx, z_threshold)
    missing = S.missing_dates(rows).withColumn("type", F.lit("missing_date"))
    return Analysis(ctx, outliers, missing, Q.quality_summary(rows, outliers, missing))
