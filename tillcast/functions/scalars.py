"""Scalar column expressions (F-10..F-27). All are built-in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..util import col_of


def weather_type(precipitation, temp_max, temp_min) -> Column:
    """F-10: 'rain' if precipitation > 10, else 'extreme_temp' if temp_max > 95 or
    temp_min < 20, else 'normal'. Missing values take the defaults 0 / 70 / 50 (Q19)."""
    p = F.coalesce(col_of(precipitation), F.lit(0.0))
    hi = F.coalesce(col_of(temp_max), F.lit(70.0))
    lo = F.coalesce(col_of(temp_min), F.lit(50.0))
    return (F.when(p > 10, F.lit("rain"))
            .when((hi > 95) | (lo < 20), F.lit("extreme_temp"))
            .otherwise(F.lit("normal")))


# WMO weather codes and their descriptions.
WEATHER_CODES = {
    0: "Clear sky", 1: "Mainly clear", 2: "Partly cloudy", 3: "Overcast",
    45: "Foggy", 48: "Depositing rime fog",
    51: "Light drizzle", 53: "Moderate drizzle", 55: "Dense drizzle",
    61: "Slight rain", 63: "Moderate rain", 65: "Heavy rain",
    71: "Slight snow", 73: "Moderate snow", 75: "Heavy snow", 77: "Snow grains",
    80: "Slight rain showers", 81: "Moderate rain showers", 82: "Violent rain showers",
    85: "Slight snow showers", 86: "Heavy snow showers",
    95: "Thunderstorm", 96: "Thunderstorm with slight hail", 99: "Thunderstorm with heavy hail",
}


def weather_description(code) -> Column:
    """F-11: code -> text via an in-expression map, 'Unknown' otherwise."""
    mapping = F.create_map(*[x for k, v in WEATHER_CODES.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(mapping, col_of(code).cast("int")), F.lit("Unknown"))


def expected_range(mean, std) -> Column:
    """F-13: 'max(0, mean-2std) - mean+2std' with no decimals."""
    m, s = col_of(mean), col_of(std)
    # Half-even to a whole number first: Java's %.0f would round halves up.
    lo = F.bround(F.greatest(F.lit(0.0), m - 2 * s), 0)
    hi = F.bround(m + 2 * s, 0)
    return F.format_string("%.0f - %.0f", lo, hi)


def z_score(value, mean, std) -> Column:
    """F-14: |x - mean| / std (NULL when std is 0 or NULL)."""
    return F.abs(col_of(value) - col_of(mean)) / F.nullif(col_of(std), F.lit(0.0))


# Data quality grades and advice texts.
GRADES = ("no_data", "excellent", "good", "fair", "poor")
ADVICE_MISSING = "Too many missing dates. Fill gaps before training."
ADVICE_OUTLIERS = "High number of outliers. Review flagged data points before training."
ADVICE_SOME = "Found %d outliers. Review them, but okay to proceed with training."
ADVICE_CLEAN = "Data looks clean. Ready for training."


def quality_grade(anomaly_count, total_rows) -> Column:
    """F-15: data quality grade from the anomaly rate."""
    rate = col_of(anomaly_count) / col_of(total_rows)
    return (F.when(col_of(total_rows) == 0, F.lit(GRADES[0]))
            .when(rate < 0.01, F.lit(GRADES[1]))
            .when(rate < 0.03, F.lit(GRADES[2]))
            .when(rate < 0.05, F.lit(GRADES[3]))
            .otherwise(F.lit(GRADES[4])))


def recommendation(outlier_count, missing_count, total_rows) -> Column:
    """F-16: advice text; checks run in the reference's order."""
    o, m, n = col_of(outlier_count), col_of(missing_count), col_of(total_rows)
    return (F.when(m > n * 0.1, F.lit(ADVICE_MISSING))
            .when(o > n * 0.05, F.lit(ADVICE_OUTLIERS))
            .when(o > 0, F.format_string(ADVICE_SOME, o))
            .otherwise(F.lit(ADVICE_CLEAN)))


def ape(actual, predicted, skip_nonpositive: bool = False) -> Column:
    """Absolute percentage error of one row; NULL where it is skipped.

    F-17 (training) skips actual = 0; the reports skip actual <= 0 (Q12).
    """
    a, p = col_of(actual), col_of(predicted)
    keep = (a > 0) if skip_nonpositive else (a != 0)
    return F.when(keep, F.abs((a - p) / a) * 100)


def round_prediction(raw) -> Column:
    """F-18: half-even round to a whole number, floored at 0."""
    return F.greatest(F.bround(col_of(raw), 0).cast("int"), F.lit(0))


# Friendly names of model features.
FEATURE_DISPLAY_NAMES = {
    "is_payday": "Payday", "item_encoded": "Item Type", "day_of_week": "Day of Week",
    "is_holiday": "Holiday", "is_school_break": "School Break", "temp_max": "Max Temperature",
    "temp_min": "Min Temperature", "weather_code": "Weather", "has_sports": "Sports Event",
    "week_of_year": "Week of Year", "precipitation": "Precipitation", "day_of_month": "Day of Month",
    "month": "Month", "is_weekend": "Weekend",
}


def display_name(name) -> Column:
    """F-23: known feature name, else underscores to spaces and each word capitalised."""
    n = col_of(name)
    mapping = F.create_map(*[x for k, v in FEATURE_DISPLAY_NAMES.items() for x in (F.lit(k), F.lit(v))])
    # Upper-case the first letter of every word; keep the rest as written.
    spaced = F.regexp_replace(n, "_", " ")
    words = F.split(spaced, " ", -1)
    titled = F.array_join(F.transform(words, lambda w: F.concat(F.upper(F.substring(w, 1, 1)),
                                                                  F.substr(w, F.lit(2)))), " ")
    return F.coalesce(F.try_element_at(mapping, n), titled)


# Accepted business types.
BUSINESS_TYPES = ("restaurant", "retail", "service", "fashion", "electronics", "food_grocery",
                  "home_garden", "health_beauty", "other_online")


def valid_business_type(btype) -> Column:
    """F-24: membership test; rows failing it go to a reject table."""
    return col_of(btype).isin(*BUSINESS_TYPES)


def line_measures(unit_price, unit_cost, quantity) -> dict[str, Column]:
    """F-27: line revenue, line cost and gross margin, each rounded to 2."""
    rev = F.bround(col_of(unit_price) * col_of(quantity), 2)
    cost = F.bround(col_of(unit_cost) * col_of(quantity), 2)
    return {"line_revenue": rev, "line_cost": cost, "gross_margin": F.bround(rev - cost, 2)}
