"""Time-of-day blocks (F-06..F-08)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..util import col_of

# Default blocks, half-open [start, end), checked in this order.
DEFAULT_TIME_BLOCKS = {
    "morning": ("06:00", "11:00"),
    "afternoon": ("11:00", "16:00"),
    "evening": ("16:00", "20:00"),
    "night": ("20:00", "23:59"),
}
OTHER_BLOCK = "other"
NO_TIME_BLOCK = "all_day"


def _hhmm_to_minutes(text: str) -> int:
    hh, mm = text.split(":")[:2]
    return int(hh) * 60 + int(mm)


def minutes_of_day(time_text) -> Column:
    """'HH:MM' or 'HH:MM:SS' -> minutes since midnight; NULL when not a valid clock time."""
    parts = F.split(F.trim(col_of(time_text).cast("string")), ":")
    hh = F.try_element_at(parts, F.lit(1)).try_cast("int")
    mm = F.try_element_at(parts, F.lit(2)).try_cast("int")
    valid = hh.between(0, 23) & mm.between(0, 59) & (F.size(parts) <= 3)
    return F.when(valid, hh * 60 + mm)


def time_block(time_text, blocks: dict | None = None) -> Column:
    """F-06: block name for a clock time; first matching block wins, else 'other'.

    A NULL or malformed time also gives 'other' (the reference would raise).
    """
    blocks = blocks or DEFAULT_TIME_BLOCKS
    minutes = minutes_of_day(time_text)
    expr = None
    for name, (start, end) in blocks.items():
        cond = (minutes >= _hhmm_to_minutes(start)) & (minutes < _hhmm_to_minutes(end))
        expr = F.when(cond, F.lit(name)) if expr is None else expr.when(cond, F.lit(name))
    return expr.otherwise(F.lit(OTHER_BLOCK))


def time_block_or_default(df_columns, time_col: str = "time", blocks: dict | None = None) -> Column:
    """F-07: 'all_day' when the data has no time column."""
    if time_col in df_columns:
        return time_block(time_col, blocks)
    return F.lit(NO_TIME_BLOCK)


def time_block_code(block_name, blocks: dict | None = None) -> Column:
    """F-08: integer code of a block name: position in the block list, 'other' last.

    Codes come from the configuration, not from row order, so they are stable
    across partitions and runs without a global pass over the data.
    """
    names = list((blocks or DEFAULT_TIME_BLOCKS).keys()) + [OTHER_BLOCK, NO_TIME_BLOCK]
    mapping = F.create_map(*[x for i, n in enumerate(names) for x in (F.lit(n), F.lit(i))])
    return F.coalesce(F.try_element_at(mapping, col_of(block_name)), F.lit(-1))
