"""Joins of sales rows with calendars (J-01..J-12, J-25) and the weather fill (W-09).

All calendar sides are bounded by the number of days in the data's span (see
``sources/calendars``), so they are broadcast; the sales side is never shuffled
for these joins.

As-of joins (J-07..J-09) are capped distances ("days to the next holiday, at
most 30"). Instead of a sort-based as-of join, each event date is expanded to
the ``cap + 1`` days that can see it, and the nearest one is an equi-join plus
``min``: exact, shuffle-free on the big side, and bounded (events x (cap + 1)).
Interval joins (J-10) expand intervals to days the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..util import with_business

WEATHER_COLS = ("temp_max", "temp_min", "precipitation", "weather_code")
WEATHER_DEFAULTS = {"temp_max": 70.0, "temp_min": 50.0, "precipitation": 0.0, "weather_code": 0.0}


def weather_join(df: DataFrame, weather: DataFrame, date_col: str = "date") -> DataFrame:
    """J-01: left join weather by date; one row per date first (Q20); flag rows
    whose temp_max is missing with ``weather_missing`` = 1."""
    per_day = weather.groupBy(F.col("date").alias("_wdate")).agg(
        *[F.max(c).cast("double").alias(f"_w_{c}") for c in WEATHER_COLS])
    j = df.join(F.broadcast(per_day), F.col(date_col) == F.col("_wdate"), "left")
    existing = set(df.columns)
    cols = []
    for c in WEATHER_COLS:
        src = F.coalesce(F.col(c).cast("double"), F.col(f"_w_{c}")) if c in existing else F.col(f"_w_{c}")
        cols.append(src.alias(c))
    keep = [F.col(c) for c in df.columns if c not in WEATHER_COLS]
    out = j.select(*keep, *cols)
    return out.withColumn("weather_missing", F.when(F.col("temp_max").isNull(), 1).otherwise(0))


def fill_weather(df: DataFrame, date_col: str = "date") -> DataFrame:
    """W-09: NULL weather := mean of the same month (over this business's rows),
    then the business-wide median of the result, then 70 / 50 / 0 / 0 (Q21).

    The rows are first counted per (business, date and weather), a table of the
    days' size; means and medians are its weighted ones. The median is Spark's
    exact percentile, whose value -> count map follows the number of distinct
    weather values (at most one per day).
    """
    base, added = with_business(df)
    base = base.withColumn("_month", F.month(date_col))
    days = base.groupBy("business_id", "_month", F.col(date_col).alias("_wday"), *WEATHER_COLS).agg(F.count("*").alias("_n"))
    monthly = days.groupBy("business_id", "_month").agg(*[
        (F.sum(F.col(c).cast("double") * F.col("_n")) / F.sum(F.when(F.col(c).isNotNull(), F.col("_n")))).alias(f"_m_{c}")
        for c in WEATHER_COLS])

    def filled(frame: DataFrame) -> DataFrame:
        joined = frame.join(monthly, ["business_id", "_month"], "left")
        return joined.withColumns({c: F.coalesce(F.col(c).cast("double"), F.col(f"_m_{c}")) for c in WEATHER_COLS})

    medians = filled(days).groupBy("business_id").agg(
        *[F.percentile(c, F.lit(0.5), F.col("_n")).alias(f"_q_{c}") for c in WEATHER_COLS])
    step2 = filled(base).join(medians, "business_id", "left")
    step2 = step2.withColumns({c: F.coalesce(F.col(c), F.col(f"_q_{c}"), F.lit(WEATHER_DEFAULTS[c]))
                               for c in WEATHER_COLS})
    drop = ["_month"] + [f"_m_{c}" for c in WEATHER_COLS] + [f"_q_{c}" for c in WEATHER_COLS]
    out = step2.drop(*drop)
    return out.drop("business_id") if added else out


def date_flag(df: DataFrame, dates: DataFrame, name: str, date_col: str = "date",
              as_int: bool = True) -> DataFrame:
    """J-02 / J-04 / J-06: is the row's date in the calendar? (existence join)."""
    d = dates.select(F.col("date").alias("_fdate")).distinct().withColumn("_hit", F.lit(True))
    j = df.join(F.broadcast(d), F.col(date_col) == F.col("_fdate"), "left")
    flag = F.coalesce(F.col("_hit"), F.lit(False))
    return j.withColumn(name, flag.cast("int") if as_int else flag).drop("_fdate", "_hit")


def date_flag_named(df: DataFrame, events: DataFrame, flag: str, name_col: str,
                    date_col: str = "date", order_col: str | None = "seq") -> DataFrame:
    """J-03 / J-05: boolean flag plus the event's name; several events on one
    date -> the last in calendar order wins (Q20)."""
    if order_col and order_col in events.columns:
        per_day = events.groupBy(F.col("date").alias("_fdate")).agg(
            F.max_by("name", order_col).alias("_fname"))
    else:
        per_day = events.groupBy(F.col("date").alias("_fdate")).agg(F.max("name").alias("_fname"))
    j = df.join(F.broadcast(per_day.withColumn("_hit", F.lit(True))),
                F.col(date_col) == F.col("_fdate"), "left")
    return (j.withColumn(flag, F.coalesce(F.col("_hit"), F.lit(False)))
            .withColumn(name_col, F.col("_fname")).drop("_fdate", "_fname", "_hit"))


def _nearest_within(dates: DataFrame, cap: int, forward: bool) -> DataFrame:
    """(date, distance) for every day that has an event within ``cap`` days."""
    k = F.explode(F.sequence(F.lit(0), F.lit(cap))).alias("_k")
    ev = dates.select("date").distinct().select("date", k)
    shifted = F.date_sub("date", F.col("_k")) if forward else F.date_add("date", F.col("_k"))
    return ev.select(shifted.alias("_adate"), "_k").groupBy("_adate").agg(F.min("_k").alias("_dist"))


def days_to_next(df: DataFrame, dates: DataFrame, name: str, cap: int, date_col: str = "date") -> DataFrame:
    """J-07 / J-09: days until the first event on or after the date, at most ``cap``."""
    near = _nearest_within(dates, cap, forward=True)
    j = df.join(F.broadcast(near), F.col(date_col) == F.col("_adate"), "left")
    return j.withColumn(name, F.coalesce(F.col("_dist"), F.lit(cap)).cast("int")).drop("_adate", "_dist")


def days_since_last(df: DataFrame, dates: DataFrame, name: str, cap: int, date_col: str = "date") -> DataFrame:
    """J-08: days since the last event on or before the date, at most ``cap``."""
    near = _nearest_within(dates, cap, forward=False)
    j = df.join(F.broadcast(near), F.col(date_col) == F.col("_adate"), "left")
    return j.withColumn(name, F.coalesce(F.col("_dist"), F.lit(cap)).cast("int")).drop("_adate", "_dist")


def break_days(school: DataFrame, year: int | None = None) -> DataFrame:
    """Days covered by 'break' intervals (start <= day <= end), one row per day."""
    b = school.where(F.col("type") == "break")
    if year is not None:
        b = b.where(F.year("start_date") == year)
    end = F.coalesce(F.col("end_date"), F.col("start_date"))
    return b.select(F.explode(F.sequence("start_date", end)).alias("date")).distinct()


def school_break_flag(df: DataFrame, school: DataFrame, date_col: str = "date") -> DataFrame:
    """J-10: interval join start <= date <= end over breaks -> int flag."""
    return date_flag(df, break_days(school), "is_school_break", date_col)


def in_session(df: DataFrame, school: DataFrame, date_col: str = "date") -> DataFrame:
    """J-11: in session = the date is in no break of its own year's calendar
    (the calendar of year Y holds the winter break that ends in Y + 1)."""
    b = school.where(F.col("type") == "break")
    days = b.select(F.year("start_date").alias("_cal_year"),
                    F.explode(F.sequence("start_date", F.coalesce("end_date", "start_date"))).alias("_bdate")
                    ).distinct().withColumn("_hit", F.lit(True))
    cond = (F.col(date_col) == F.col("_bdate")) & (F.year(F.col(date_col)) == F.col("_cal_year"))
    j = df.join(F.broadcast(days), cond, "left")
    return j.withColumn("in_session", F.col("_hit").isNull()).drop("_cal_year", "_bdate", "_hit")


def overlapping(events: DataFrame, windows: DataFrame, start_col: str = "start_date",
                end_col: str = "end_date") -> DataFrame:
    """J-12: (window, event) pairs where e.start <= w.end and e.end >= w.start.

    ``windows`` has ``window_start`` / ``window_end``. Both sides are expanded to
    the days they cover and equi-joined on the day, then de-duplicated, so no
    theta join is needed; both sides are calendars (bounded by the span).
    """
    e_end = F.coalesce(F.col(end_col), F.col(start_col))
    ev = events.select("*", F.explode(F.sequence(F.col(start_col), e_end)).alias("_day"))
    wd = windows.select("window_start", "window_end",
                        F.explode(F.sequence("window_start", "window_end")).alias("_day"))
    return ev.join(wd, "_day").drop("_day").distinct()


def month_windows(frame: DataFrame, date_col: str = "date") -> DataFrame:
    """Calendar months present in ``frame`` as (window_start, window_end) windows."""
    m = frame.select(F.trunc(date_col, "month").alias("window_start")).distinct()
    return m.select("window_start", F.last_day("window_start").alias("window_end"))


def events_for_window(windows: DataFrame, holidays: DataFrame, games: DataFrame, paydays: DataFrame,
                      school: DataFrame, weather: DataFrame | None = None,
                      max_weather_days: int = 14) -> DataFrame:
    """J-25: every calendar limited to the window(s) in one typed table
    (window_start, kind, start_date, end_date, name, type). Weather only for the
    first ``max_weather_days`` days of a window. Windows come as a frame with
    ``window_start`` / ``window_end`` (e.g. a day, a range, or this month)."""
    wdays = windows.select("window_start", "window_end",
                           F.explode(F.sequence("window_start", "window_end")).alias("date"))

    def one_day(df: DataFrame, kind: str, name: Column, typ: Column) -> DataFrame:
        return df.join(wdays, "date").select(
            "window_start", F.lit(kind).alias("kind"), F.col("date").alias("start_date"),
            F.col("date").alias("end_date"), name.alias("name"), typ.alias("type"))

    parts = [
        one_day(holidays, "holiday", F.col("name"), F.col("type")),
        one_day(games, "sports", F.col("name"), F.lit("game")),
        one_day(paydays.select("date").distinct(), "payday", F.lit("Payday"), F.lit("payday")),
        overlapping(school, windows).select(
            "window_start", F.lit("school").alias("kind"), "start_date",
            F.coalesce("end_date", "start_date").alias("end_date"), "name", "type"),
    ]
    if weather is not None:
        w14 = wdays.where(F.col("date") < F.date_add("window_start", max_weather_days))
        parts.append(weather.join(w14, "date").select(
            "window_start", F.lit("weather").alias("kind"), F.col("date").alias("start_date"),
            F.col("date").alias("end_date"), F.col("weather_code").cast("string").alias("name"),
            F.lit("weather").alias("type")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
