"""M-01 / M-02: model features for (business, date, item) rows.

Plan shape: every calendar feature depends on the date only, so they are
computed once per calendar day of the span (a table bounded by the number of
days, not by sales volume) and attached with ONE broadcast join. The weather
fill (W-09) is then done on the rows, because the reference weights its month
means by sales rows. Item codes are one row per (business, item).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.blocks import time_block, time_block_code
from ..functions.dates import cyclical, date_parts
from ..operators import calendar_joins as J
from ..operators.ranking import with_position
from ..sources import calendars as C
from ..util import with_business

# The model's feature columns, in order.
FEATURE_COLUMNS = (
    "day_of_week", "day_of_month", "month", "week_of_year", "is_weekend",
    "day_of_week_sin", "day_of_week_cos", "month_sin", "month_cos",
    "temp_max", "temp_min", "precipitation", "weather_code", "weather_missing",
    "is_holiday", "days_to_holiday", "days_from_holiday", "has_sports",
    "is_payday", "days_to_payday", "is_school_break",
    "item_encoded",
    "lag_1", "lag_7", "rolling_7_avg", "rolling_30_avg", "rolling_7_std",
)
TIME_BLOCK_FEATURE = "time_block_encoded"


@dataclass
class Calendars:
    weather: DataFrame | None
    holidays: DataFrame | None
    games: DataFrame | None
    paydays: DataFrame | None
    school: DataFrame | None
    days: DataFrame | None = None

    @classmethod
    def for_span(cls, spark, lo, hi) -> Calendars:
        """Calendars for the days lo..hi and the years around them (Q9)."""
        years = C.years_between(spark, lo.year - 1, hi.year + 1)
        days = C.days_between(spark, lo, hi)
        return cls(weather=C.weather_calendar(days), holidays=C.holiday_calendar(years),
                   games=C.games_calendar(years), paydays=C.payday_calendar(years),
                   school=C.school_calendar(years), days=days)

    @classmethod
    def for_data(cls, frame: DataFrame, date_col: str = "date") -> Calendars:
        """Calendars for the data's span: the span is one aggregate read once,
        so no calendar re-scans the (large) frame it is joined back to."""
        lo, hi = C.span_of(frame, date_col)
        return cls.for_span(frame.sparkSession, lo, hi)


_SIGNALS = ("is_holiday", "days_to_holiday", "days_from_holiday", "has_sports", "is_payday",
            "days_to_payday", "is_school_break")
_FLAG_DEFAULTS = {"is_holiday": 0, "days_to_holiday": 30, "days_from_holiday": 30, "has_sports": 0,
                  "is_payday": 0, "days_to_payday": 15, "is_school_break": 0}


def _signal(df: DataFrame, date: Column, **values) -> DataFrame:
    return df.select(date.alias("date"), *[(values[k] if k in values else F.lit(None).cast("int")).alias(k)
                                           for k in _SIGNALS])


def _within(dates: DataFrame, cap: int, forward: bool, name: str) -> DataFrame:
    k = F.explode(F.sequence(F.lit(0), F.lit(cap))).alias("_k")
    ev = dates.select("date").distinct().select("date", k)
    shifted = F.date_sub("date", F.col("_k")) if forward else F.date_add("date", F.col("_k"))
    return _signal(ev, shifted, **{name: F.col("_k").cast("int")})


def calendar_day_features(days: DataFrame, cal: Calendars) -> DataFrame:
    """Per calendar day: raw weather + missing flag and all event features.

    Every calendar contributes rows of (date, signal) - exact dates for flags,
    the cap + 1 days that can see an event for as-of distances, the covered
    days for breaks - and one ``groupBy(date)`` folds them (max for flags, min
    for distances). Then one join with the day list and one with the weather:
    two joins instead of one per feature, all on tables bounded by the span.
    """
    parts = []
    if cal.holidays is not None:
        parts += [_signal(cal.holidays, F.col("date"), is_holiday=F.lit(1)),
                  _within(cal.holidays, 30, True, "days_to_holiday"),
                  _within(cal.holidays, 30, False, "days_from_holiday")]
    if cal.games is not None:
        parts.append(_signal(cal.games, F.col("date"), has_sports=F.lit(1)))
    if cal.paydays is not None:
        parts += [_signal(cal.paydays, F.col("date"), is_payday=F.lit(1)),
                  _within(cal.paydays, 15, True, "days_to_payday")]
    if cal.school is not None:
        parts.append(_signal(J.break_days(cal.school), F.col("date"), is_school_break=F.lit(1)))
    df = days.select("date")
    if cal.weather is not None:
        df = J.weather_join(df, cal.weather)
    else:
        df = df.select("date", *[F.lit(None).cast("double").alias(c) for c in J.WEATHER_COLS],
                       F.lit(1).alias("weather_missing"))
    if parts:
        sig = parts[0]
        for p_ in parts[1:]:
            sig = sig.unionByName(p_)
        agg = sig.groupBy("date").agg(*[(F.min(k) if k.startswith("days_") else F.max(k)).alias(k)
                                        for k in _SIGNALS])
        df = df.join(F.broadcast(agg), "date", "left")
    else:
        df = df.select("*", *[F.lit(None).cast("int").alias(k) for k in _SIGNALS])
    return df.select("date", *J.WEATHER_COLS, "weather_missing",
                     *[F.coalesce(F.col(k), F.lit(v)).cast("int").alias(k) for k, v in _FLAG_DEFAULTS.items()])


def item_codes(frame: DataFrame, keys=("item_name",)) -> DataFrame:
    """M-03 (plan side): item code = alphabetical position within the business.

    A range-partitioned sort of the distinct items, so that a large catalogue is
    ranked by many tasks (``operators.ranking``).
    """
    df, _ = with_business(frame)
    items = df.select("business_id", *keys).where(F.col(keys[0]).isNotNull()).distinct()
    return with_position(items, ["business_id"], list(keys), "item_encoded").withColumn(
        "item_encoded", F.col("item_encoded").cast("int"))


def build_features(rows: DataFrame, cal: Calendars | None = None, time_col: str = "time",
                   blocks: dict | None = None, codes: DataFrame | None = None) -> DataFrame:
    """M-01: date parts, cyclical encodings, weather (+fill), events, item code,
    optional time block code. Lags are added separately (W-01..W-06)."""
    base, added = with_business(rows)
    cal = cal or Calendars.for_data(base)
    days = cal.days if cal.days is not None else C.days_of(base.select("date"))
    day_feats = calendar_day_features(days, cal)
    df = base.select("*", *[v.alias(k) for k, v in date_parts("date").items()],
                     *[v.alias(k) for k, v in cyclical("date").items()])
    if time_col in base.columns:
        df = df.withColumn("time_block", time_block(time_col, blocks))
        df = df.withColumn(TIME_BLOCK_FEATURE, time_block_code("time_block", blocks))
    df = df.join(F.broadcast(day_feats), "date", "left")
    df = J.fill_weather(df)
    codes = codes if codes is not None else item_codes(base)
    df = df.join(codes, ["business_id", "item_name"], "left").withColumn(
        "item_encoded", F.coalesce(F.col("item_encoded"), F.lit(-1)))
    return df.drop("business_id") if added else df


def feature_names(df: DataFrame) -> list[str]:
    names = list(FEATURE_COLUMNS)
    if TIME_BLOCK_FEATURE in df.columns:
        names.append(TIME_BLOCK_FEATURE)
    return names

