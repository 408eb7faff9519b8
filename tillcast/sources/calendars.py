"""Calendar tables generated for the years the data covers (S-22..S-24, J-25 inputs).

Every generator takes a ``years`` frame (one ``year`` column), normally made by
:func:`years_of` from the sales data itself, so calendars grow with the data's
time span (Q9: first year - 1 .. last year + 1). Rows are produced with
``explode(sequence(...))`` per year: no cross joins, no driver-side lists.

Size bound: every calendar holds at most a constant number of rows per day of
the span (paydays <= 2/day, holidays and school events a few per year), so the
tables are broadcast when joined to sales: 100 years are ~40k rows.

Holidays, games and weather normally come from web services (not built). The
stand-ins here are deterministic rules on the date so that every engine can
recompute them: US public holidays from their calendar rules, football Sundays
(Sept..Jan), and a weather formula keyed on the epoch day.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.dates import football_day


def years_of(frame: DataFrame, date_col: str = "date", pad: int = 1) -> DataFrame:
    """Years spanned by ``frame`` plus ``pad`` on each side, one row per year."""
    span = frame.agg(F.min(F.year(date_col)).alias("lo"), F.max(F.year(date_col)).alias("hi"))
    return span.select(F.explode(F.sequence(F.col("lo") - pad, F.col("hi") + pad)).alias("year"))


def days_of(frame: DataFrame, date_col: str = "date") -> DataFrame:
    """Every calendar day from the first to the last date of ``frame``."""
    span = frame.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi"))
    return span.select(F.explode(F.sequence("lo", "hi")).alias("date"))


def span_of(frame: DataFrame, date_col: str = "date"):
    """(first, last) date of ``frame``: one aggregate, two scalars to the driver.
    Calendars built from these literals do not re-scan the data they describe."""
    r = frame.agg(F.min(date_col).alias("lo"), F.max(date_col).alias("hi")).first()
    return r["lo"], r["hi"]


def years_between(spark, lo_year: int, hi_year: int) -> DataFrame:
    return spark.range(int(lo_year), int(hi_year) + 1).select(F.col("id").cast("int").alias("year"))


def days_between(spark, lo, hi) -> DataFrame:
    return spark.range(1).select(F.explode(F.sequence(F.lit(lo), F.lit(hi))).alias("date"))


def _year_days(year: Column) -> Column:
    return F.sequence(F.make_date(year, F.lit(1), F.lit(1)), F.make_date(year, F.lit(12), F.lit(31)))


def payday_calendar(years: DataFrame) -> DataFrame:
    """S-22: the 1st and 15th of every month plus every Friday; (date, type).

    A Friday that is also the 1st or 15th appears twice with two types, as in
    the reference; flag joins de-duplicate by date.
    """
    months = years.select("year", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    first = months.select(F.make_date("year", "month", F.lit(1)).alias("date"),
                          F.lit("monthly_1st").alias("type"))
    fifteenth = months.select(F.make_date("year", "month", F.lit(15)).alias("date"),
                              F.lit("monthly_15th").alias("type"))
    fridays = (years.select(F.explode(_year_days(F.col("year"))).alias("date"))
               .where(F.weekday("date") == 4)
               .select("date", F.lit("weekly_friday").alias("type")))
    return first.unionByName(fifteenth).unionByName(fridays)


def ebt_calendar(years: DataFrame) -> DataFrame:
    """S-23: days 1..10 of every month, type 'ebt_window'."""
    return (years.select(F.explode(_year_days(F.col("year"))).alias("date"))
            .where(F.dayofmonth("date") <= 10)
            .select("date", F.lit("ebt_window").alias("type")))


# School calendar template per year
# (name, type, start month, start day, end month, end day, end year offset).
SCHOOL_EVENTS = (
    ("school_resumes_spring", "school_start", 1, 6, 1, 6, 0),
    ("spring_break", "break", 3, 10, 3, 17, 0),
    ("summer_break", "break", 5, 25, 8, 15, 0),
    ("back_to_school", "school_start", 8, 16, 8, 16, 0),
    ("thanksgiving_break", "break", 11, 20, 11, 24, 0),
    ("winter_break", "break", 12, 18, 1, 5, 1),
)


def _literal_rows(rows, names) -> Column:
    return F.array(*[F.struct(*[F.lit(v).alias(n) for v, n in zip(r, names)]) for r in rows])


def school_calendar(years: DataFrame) -> DataFrame:
    """S-24: six events a year; the winter break ends on Jan 5 of the next year."""
    names = ("name", "type", "sm", "sd", "em", "ed", "ey")
    ev = years.select("year", F.explode(_literal_rows(SCHOOL_EVENTS, names)).alias("e"))
    return ev.select(
        F.make_date("year", "e.sm", "e.sd").alias("start_date"),
        F.make_date(F.col("year") + F.col("e.ey"), "e.em", "e.ed").alias("end_date"),
        F.col("e.name").alias("name"), F.col("e.type").alias("type"))


# US public holiday rules
# (name, month, fixed day or None, weekday Mon=0 or None, nth weekday; -1 = last).
HOLIDAY_RULES = (
    ("New Year's Day", 1, 1, None, None),
    ("Martin Luther King, Jr. Day", 1, None, 0, 3),
    ("Presidents Day", 2, None, 0, 3),
    ("Memorial Day", 5, None, 0, -1),
    ("Juneteenth", 6, 19, None, None),
    ("Independence Day", 7, 4, None, None),
    ("Labor Day", 9, None, 0, 1),
    ("Columbus Day", 10, None, 0, 2),
    ("Veterans Day", 11, 11, None, None),
    ("Thanksgiving Day", 11, None, 3, 4),
    ("Christmas Day", 12, 25, None, None),
)


def holiday_calendar(years: DataFrame) -> DataFrame:
    """Holidays for the years: (date, name, type='Public'). Rule order = ``seq``."""
    rules = [(i, *r) for i, r in enumerate(HOLIDAY_RULES)]
    typed = F.array(*[F.struct(F.lit(r[0]).alias("seq"), F.lit(r[1]).alias("name"),
                               F.lit(r[2]).alias("month"), F.lit(r[3]).cast("int").alias("day"),
                               F.lit(r[4]).cast("int").alias("wd"), F.lit(r[5]).cast("int").alias("nth"))
                      for r in rules])
    ev = years.select("year", F.explode(typed).alias("r"))
    first = F.make_date("year", "r.month", F.lit(1))
    last = F.last_day(first)
    nth_day = F.date_add(first, ((F.col("r.wd") - F.weekday(first) + 7) % 7) + 7 * (F.col("r.nth") - 1))
    last_wd = F.date_sub(last, (F.weekday(last) - F.col("r.wd") + 7) % 7)
    date = (F.when(F.col("r.day").isNotNull(), F.make_date("year", "r.month", "r.day"))
            .when(F.col("r.nth") == -1, last_wd).otherwise(nth_day))
    return ev.select(date.alias("date"), F.col("r.name").alias("name"),
                     F.lit("Public").alias("type"), F.col("r.seq").alias("seq"))


def games_calendar(years: DataFrame) -> DataFrame:
    """Football Sundays (Sept..Jan): (date, name, home_team, away_team, venue)."""
    days = years.select(F.explode(_year_days(F.col("year"))).alias("date"))
    return days.where(football_day("date")).select(
        "date", F.lit("Sunday Football").alias("name"),
        F.lit(None).cast("string").alias("home_team"), F.lit(None).cast("string").alias("away_team"),
        F.lit("Unknown").alias("venue"))


# Weather codes cycled through by the stand-in weather formula.
WEATHER_CODE_CYCLE = (0, 1, 2, 3, 45, 61, 71, 95)


def weather_calendar(days: DataFrame) -> DataFrame:
    """Stand-in daily weather for the given days: (date, temp_max, temp_min, precipitation, weather_code).

    Keyed on the epoch day ``e``: no row when e % 11 = 0 (missing day), a NULL
    temp_max when e % 13 = 0 (gap inside a row), so the fill logic is exercised.
    """
    e = F.unix_date("date")
    month = F.month("date")
    codes = F.array(*[F.lit(c) for c in WEATHER_CODE_CYCLE])
    return days.where(e % 11 != 0).select(
        "date",
        F.when(e % 13 == 0, F.lit(None)).otherwise(20 + 7 * month + e % 11).cast("double").alias("temp_max"),
        (7 * month + e % 5 - 5).cast("double").alias("temp_min"),
        ((e * 7) % 19 * 0.75).cast("double").alias("precipitation"),
        F.element_at(codes, (e % len(WEATHER_CODE_CYCLE) + 1).cast("int")).cast("int").alias("weather_code"),
    )


# ---------------------------------------------------------------- oracle SQL
# The same calendars as DuckDB CTEs over a ``sales`` CTE.

YEARS_SQL = """
years AS (SELECT unnest(generate_series(min(year(date)) - 1, max(year(date)) + 1)) AS year FROM sales)"""

YEAR_DAYS_SQL = """
ydays AS (SELECT CAST(unnest(generate_series(make_date(year, 1, 1), make_date(year, 12, 31), INTERVAL 1 DAY)) AS DATE) AS date FROM years)"""

PAYDAYS_SQL = """
paydays AS (
  SELECT make_date(year, m, 1) AS date, 'monthly_1st' AS type FROM years, range(1, 13) t(m)
  UNION ALL SELECT make_date(year, m, 15), 'monthly_15th' FROM years, range(1, 13) t(m)
  UNION ALL SELECT date, 'weekly_friday' FROM ydays WHERE isodow(date) = 5
)"""

EBT_SQL = """
ebt AS (SELECT date, 'ebt_window' AS type FROM ydays WHERE day(date) <= 10)"""

SCHOOL_SQL = """
school_t(name, type, sm, sd, em, ed, ey) AS (VALUES
  ('school_resumes_spring', 'school_start', 1, 6, 1, 6, 0),
  ('spring_break', 'break', 3, 10, 3, 17, 0),
  ('summer_break', 'break', 5, 25, 8, 15, 0),
  ('back_to_school', 'school_start', 8, 16, 8, 16, 0),
  ('thanksgiving_break', 'break', 11, 20, 11, 24, 0),
  ('winter_break', 'break', 12, 18, 1, 5, 1)),
school AS (
  SELECT make_date(y.year, t.sm, t.sd) AS start_date, make_date(y.year + t.ey, t.em, t.ed) AS end_date,
         t.name, t.type
  FROM years y, school_t t
)"""

HOLIDAYS_SQL = """
hrules(seq, name, month, day, wd, nth) AS (VALUES
  (0, 'New Year''s Day', 1, 1, NULL, NULL),
  (1, 'Martin Luther King, Jr. Day', 1, NULL, 0, 3),
  (2, 'Presidents Day', 2, NULL, 0, 3),
  (3, 'Memorial Day', 5, NULL, 0, -1),
  (4, 'Juneteenth', 6, 19, NULL, NULL),
  (5, 'Independence Day', 7, 4, NULL, NULL),
  (6, 'Labor Day', 9, NULL, 0, 1),
  (7, 'Columbus Day', 10, NULL, 0, 2),
  (8, 'Veterans Day', 11, 11, NULL, NULL),
  (9, 'Thanksgiving Day', 11, NULL, 3, 4),
  (10, 'Christmas Day', 12, 25, NULL, NULL)),
hbase AS (
  SELECT y.year, r.*, make_date(y.year, r.month, 1) AS f, last_day(make_date(y.year, r.month, 1)) AS l
  FROM years y, hrules r
),
holidays AS (
  SELECT CAST(CASE WHEN day IS NOT NULL THEN make_date(year, month, day)
              WHEN nth = -1 THEN l - CAST(((isodow(l) - 1) - wd + 7) % 7 AS INTEGER)
              ELSE f + CAST((wd - (isodow(f) - 1) + 7) % 7 + 7 * (nth - 1) AS INTEGER) END AS DATE) AS date,
         name, 'Public' AS type, seq
  FROM hbase
)"""

GAMES_SQL = """
games AS (
  SELECT date, 'Sunday Football' AS name, CAST(NULL AS VARCHAR) AS home_team,
         CAST(NULL AS VARCHAR) AS away_team, 'Unknown' AS venue
  FROM ydays WHERE isodow(date) = 7 AND month(date) IN (9, 10, 11, 12, 1)
)"""

SPAN_DAYS_SQL = """
sdays AS (SELECT CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date FROM sales)"""

WEATHER_SQL = """
wbase AS (SELECT date, CAST(date_diff('day', DATE '1970-01-01', date) AS BIGINT) AS e FROM sdays),
weather AS (
  SELECT date,
         CAST(CASE WHEN e % 13 = 0 THEN NULL ELSE 20 + 7 * month(date) + e % 11 END AS DOUBLE) AS temp_max,
         CAST(7 * month(date) + e % 5 - 5 AS DOUBLE) AS temp_min,
         CAST((e * 7) % 19 * 0.75 AS DOUBLE) AS precipitation,
         CAST([0, 1, 2, 3, 45, 61, 71, 95][CAST(e % 8 AS INTEGER) + 1] AS INTEGER) AS weather_code
  FROM wbase WHERE e % 11 <> 0
)"""

ALL_CALENDARS_SQL = (YEARS_SQL, YEAR_DAYS_SQL, PAYDAYS_SQL, EBT_SQL, SCHOOL_SQL, HOLIDAYS_SQL,
                     GAMES_SQL, SPAN_DAYS_SQL, WEATHER_SQL)
