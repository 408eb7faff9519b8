"""Date columns: parts, names, multi-format parsing (F-01..F-05, F-09, F-28, S-09, S-10)."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..util import col_of


def date_parts(date) -> dict[str, Column]:
    """F-01/F-02: Monday = 0 weekday, day, month, ISO week, weekend flag."""
    d = col_of(date)
    dow = F.weekday(d)
    return {
        "day_of_week": dow,
        "day_of_month": F.dayofmonth(d),
        "month": F.month(d),
        "week_of_year": F.weekofyear(d),
        "is_weekend": dow.isin(5, 6).cast("int"),
    }


def cyclical(date) -> dict[str, Column]:
    """F-03: sin/cos encodings of weekday (period 7) and month (period 12)."""
    d = col_of(date)
    two_pi = 2 * math.pi
    dow = F.weekday(d).cast("double")
    month = F.month(d).cast("double")
    return {
        "day_of_week_sin": F.sin(F.lit(two_pi) * dow / 7),
        "day_of_week_cos": F.cos(F.lit(two_pi) * dow / 7),
        "month_sin": F.sin(F.lit(two_pi) * month / 12),
        "month_cos": F.cos(F.lit(two_pi) * month / 12),
    }


def day_name(date) -> Column:
    """F-04: 'Monday' .. 'Sunday'."""
    return F.date_format(col_of(date), "EEEE")


def date_string(date) -> Column:
    """F-05: ISO text, only at the edges (tables keep DATE)."""
    return F.date_format(col_of(date), "yyyy-MM-dd")


# Accepted date layouts, in the order they are tried.
ISO_FORMATS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
DAY_FIRST_FORMATS = ("dd/MM/yyyy", "d/M/yyyy", "dd-MM-yyyy", "dd.MM.yyyy")
MONTH_FIRST_FORMATS = ("MM/dd/yyyy", "M/d/yyyy", "MM-dd-yyyy")


def parse_date(text, day_first: bool = True) -> Column:
    """S-09: one DATE from mixed date text.

    ISO layouts are always read year-month-day; slash/dot layouts follow
    ``day_first`` and fall back to the other order only when the first reading
    is impossible (e.g. 31/01/2024 under month-first). Unparsable -> NULL,
    never an exception (ANSI mode stays on).
    """
    t = F.trim(col_of(text).cast("string"))
    first, second = (DAY_FIRST_FORMATS, MONTH_FIRST_FORMATS) if day_first else (
        MONTH_FIRST_FORMATS, DAY_FIRST_FORMATS)
    tries = [F.try_to_timestamp(t, F.lit(fmt)) for fmt in (*ISO_FORMATS, *first, *second)]
    return F.coalesce(*tries).cast("date")


def safe_parse_date(text) -> Column:
    """S-10: trimmed text as Y-m-d, then d/m/Y, m/d/Y, Y/m/d; else NULL."""
    t = F.trim(col_of(text).cast("string"))
    return F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in
                        ("yyyy-MM-dd", "dd/MM/yyyy", "MM/dd/yyyy", "yyyy/MM/dd")]).cast("date")


def dated(df, text_col: str, name: str = "date"):
    """S-10: (rows with ``name`` parsed, rows whose non-empty text fits no
    layout), so that bad dates are reported instead of becoming NULL."""
    out = df.withColumn(name, safe_parse_date(text_col))
    bad = F.col(name).isNull() & (F.trim(F.col(text_col).cast("string")) != "")
    return out.where(~F.coalesce(bad, F.lit(False))), out.where(bad).drop(name)


def parse_hour(time_text) -> Column:
    """F-09: hour of day from 'HH:mm', 'HH:mm:ss', 'h:mm a' or a full timestamp."""
    t = F.trim(col_of(time_text).cast("string"))
    fmts = ("HH:mm:ss", "HH:mm", "H:mm", "h:mm a", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm:ss")
    return F.hour(F.coalesce(*[F.try_to_timestamp(t, F.lit(f)) for f in fmts]))


def football_day(date) -> Column:
    """F-28: Sunday in September..January."""
    d = col_of(date)
    return (F.weekday(d) == 6) & F.month(d).isin(9, 10, 11, 12, 1)


def event_label(is_holiday, is_football) -> Column:
    """F-28: 'Holiday', else 'Football', else ''."""
    return (F.when(col_of(is_holiday), F.lit("Holiday"))
            .when(col_of(is_football), F.lit("Football")).otherwise(F.lit("")))
