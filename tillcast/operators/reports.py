"""Reports over predictions, forecasts and sales.

A-16..A-21, A-23..A-27, A-29..A-32, W-13, T-05, F-19.

Reports are keyed aggregates (partial aggregation before the shuffle).
Windows only run over already-aggregated, bounded sets (an item's days, a
business's forecast horizon). Top-k per group uses ``row_number() <= k``,
which Spark plans with a partial WindowGroupLimit before the shuffle, so a hot
group sends k rows per map task, not all of its rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import ape
from ..util import with_business

PERIODS = ("week", "month", "quarter", "year")


def with_as_of(df: DataFrame, date_col: str, name: str = "as_of") -> DataFrame:
    """Attach each business's newest date as its 'today' (one row per business; Spark's size check picks the join)."""
    mx = df.groupBy("business_id").agg(F.max(date_col).alias(name))
    return df.join(mx, "business_id")


def scored(predictions: DataFrame, models: DataFrame, since_days: int | None = None) -> DataFrame:
    """Predictions with an actual, joined to their model's business (J-17),
    optionally limited to the last ``since_days`` before the business's newest date."""
    p = predictions.where(F.col("actual_quantity").isNotNull()).join(
        models.select("model_id", "business_id"), "model_id")
    if since_days is not None:
        p = with_as_of(p, "prediction_date", "_as_of").where(
            F.col("prediction_date") >= F.date_sub("_as_of", since_days)).drop("_as_of")
    return p


def accuracy(scored_rows: DataFrame, skip_nonpositive: bool = True) -> DataFrame:
    """A-16: totals, MAE, MAPE over actual > 0 (0 if none), accuracy =
    max(0, 100 - MAPE), data points and distinct days, per business (all its
    models pooled, Q13). Full precision; round at display."""
    p, a = F.col("predicted_quantity"), F.col("actual_quantity")
    mape = F.coalesce(F.avg(ape(a, p, skip_nonpositive)), F.lit(0.0))
    return scored_rows.groupBy("business_id").agg(
        F.sum(p).cast("long").alias("total_predicted"), F.sum(a).cast("long").alias("total_actual"),
        F.avg(F.abs(p - a)).alias("mae"), mape.alias("mape"),
        F.greatest(F.lit(0.0), 100 - mape).alias("accuracy"),
        F.count(F.lit(1)).alias("data_points"), F.countDistinct("prediction_date").alias("days_tracked"))


def daily_comparison(scored_rows: DataFrame) -> DataFrame:
    """A-17: predicted and actual sums per date."""
    return (scored_rows.groupBy("business_id", "prediction_date")
            .agg(F.sum("predicted_quantity").cast("long").alias("predicted"),
                 F.sum("actual_quantity").cast("long").alias("actual"))
            .orderBy("business_id", "prediction_date"))


def _period_starts(today: Column) -> dict[str, tuple[Column, Column]]:
    week = F.date_sub(today, F.weekday(today))
    month = F.trunc(today, "month")
    quarter = F.trunc(today, "quarter")
    year = F.trunc(today, "year")
    return {"week": (week, F.date_sub(week, 7)),
            "month": (month, F.add_months(month, -1)),
            "quarter": (quarter, F.add_months(quarter, -3)),
            "year": (year, F.add_months(year, -12))}


def period_comparison(scored_rows: DataFrame) -> DataFrame:
    """A-18: current vs previous week / month / quarter / year relative to the
    business's newest date: sums, row counts (Q11) and change percent. One
    aggregation pass with conditional sums, then one row per period."""
    df = with_as_of(scored_rows, "prediction_date", "_today")
    d, p, a = F.col("prediction_date"), F.col("predicted_quantity"), F.col("actual_quantity")
    aggs = []
    for name, (cur, prev) in _period_starts(F.col("_today")).items():
        in_cur = d >= cur
        in_prev = (d >= prev) & (d < cur)
        aggs += [F.sum(F.when(in_cur, p).otherwise(0)).cast("long").alias(f"{name}_cp"),
                 F.sum(F.when(in_cur, a).otherwise(0)).cast("long").alias(f"{name}_ca"),
                 F.count(F.when(in_cur, 1)).alias(f"{name}_cn"),
                 F.sum(F.when(in_prev, p).otherwise(0)).cast("long").alias(f"{name}_pp"),
                 F.sum(F.when(in_prev, a).otherwise(0)).cast("long").alias(f"{name}_pa"),
                 F.count(F.when(in_prev, 1)).alias(f"{name}_pn")]
    g = df.groupBy("business_id").agg(*aggs)
    rows = F.explode(F.array(*[F.struct(
        F.lit(n).alias("period"), F.col(f"{n}_cp").alias("current_predicted"),
        F.col(f"{n}_ca").alias("current_actual"), F.col(f"{n}_cn").alias("current_rows"),
        F.col(f"{n}_pp").alias("previous_predicted"), F.col(f"{n}_pa").alias("previous_actual"),
        F.col(f"{n}_pn").alias("previous_rows")) for n in PERIODS])).alias("r")
    out = g.select("business_id", rows).select("business_id", "r.*")
    change = F.when(F.col("previous_actual") > 0,
                    (F.col("current_actual") - F.col("previous_actual")) / F.col("previous_actual") * 100
                    ).otherwise(F.lit(0.0))
    return out.withColumn("change_percent", change)


def top_k(df: DataFrame, part: Sequence[str], order: Sequence[Column], k: int, name: str = "rank") -> DataFrame:
    """Top-k rows per group by ``order`` (row_number <= k, a partial
    WindowGroupLimit runs before the shuffle)."""
    w = Window.partitionBy(*part).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w)).where(F.col(name) <= k)


def top_items(scored_rows: DataFrame, k: int = 10) -> DataFrame:
    """A-19: predicted / actual per item, the top ``k`` by actual (name tie-break)."""
    by_item = scored_rows.groupBy("business_id", "item_name").agg(
        F.sum("predicted_quantity").cast("long").alias("predicted"),
        F.sum("actual_quantity").cast("long").alias("actual"))
    return top_k(by_item, ["business_id"], [F.col("actual").desc(), F.col("item_name")], k)


def weekday_profile(scored_rows: DataFrame) -> DataFrame:
    """A-20: mean predicted / actual per weekday (Monday = 0); all seven days
    present (a day without rows averages 0)."""
    g = scored_rows.groupBy("business_id", F.weekday("prediction_date").alias("dow")).agg(
        F.sum("predicted_quantity").alias("_p"), F.sum("actual_quantity").alias("_a"),
        F.count(F.lit(1)).alias("_n"))
    days = (scored_rows.select("business_id").distinct()
            .select("business_id", F.explode(F.sequence(F.lit(0), F.lit(6))).alias("dow")))
    j = days.join(g, ["business_id", "dow"], "left")
    n = F.greatest(F.coalesce(F.col("_n"), F.lit(0)), F.lit(1))
    names = F.array(*[F.lit(x) for x in ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday",
                                         "Saturday", "Sunday")])
    return j.select("business_id", "dow", F.element_at(names, F.col("dow") + 1).alias("day"),
                    (F.coalesce(F.col("_p"), F.lit(0)) / n).alias("avg_predicted"),
                    (F.coalesce(F.col("_a"), F.lit(0)) / n).alias("avg_actual"))


def source_row_counts(sources: dict[str, DataFrame]) -> DataFrame:
    """A-23: rows per external source, one union of counts."""
    parts = [df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(name).alias("source"), "rows")
             for name, df in sources.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def forecast_summary(forecast: DataFrame, qty: str = "predicted_quantity", date_col: str = "prediction_date"
                     ) -> DataFrame:
    """A-24 / A-26: rows, total, average per record (Q17), peak and low rows,
    rows above the average. Peak ties go to the earliest (date, item), low ties
    to the latest, matching a stable descending sort."""
    f, _ = with_business(forecast)
    row = F.struct(F.col(date_col).alias("d"), F.col("item_name").alias("i"), F.col(qty).alias("q"))
    order = F.struct((-F.col(qty)).alias("nq"), F.col(date_col), F.col("item_name"))
    # keyed aggregates (partial aggregation), no window over a whole business
    stats = f.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("rows"), F.sum(qty).cast("long").alias("total"),
        F.avg(qty).alias("avg_per_record"),
        F.min_by(row, order).alias("_peak"),   # largest qty, then earliest date, item
        F.max_by(row, order).alias("_low"))    # smallest qty, then latest date, item
    stats = stats.select("business_id", "rows", "total", "avg_per_record",
                         F.col("_peak.d").alias("peak_date"), F.col("_peak.i").alias("peak_item"),
                         F.col("_peak.q").alias("peak_quantity"), F.col("_low.d").alias("low_date"),
                         F.col("_low.i").alias("low_item"), F.col("_low.q").alias("low_quantity"))
    above = (f.join(stats.select("business_id", "avg_per_record"), "business_id")
             .groupBy("business_id").agg(F.count_if(F.col(qty) > F.col("avg_per_record")).alias("days_above_average")))
    return stats.join(above, "business_id")


def key_factors(factors: DataFrame, name_col: str = "feature", weight_col: str = "importance", k: int = 5) -> DataFrame:
    """A-24: the ``k`` weightiest factor names as one text (a top-k report; ties by name)."""
    top = factors.orderBy(F.col(weight_col).desc(), name_col).limit(k)
    rows = F.sort_array(F.collect_list(F.struct((-F.col(weight_col)).alias("w"), F.col(name_col).alias("n"))))
    return top.agg(F.concat_ws(", ", F.transform(rows, lambda r: r["n"])).alias("key_factors"))


def daily_totals(forecast: DataFrame, days: int = 14, qty: str = "predicted_quantity",
                 date_col: str = "prediction_date") -> DataFrame:
    """A-25: total per date over the first ``days`` days of each business's
    forecast, flagged busiest / slowest (ties -> earliest date)."""
    f, _ = with_business(forecast)
    start = f.groupBy("business_id").agg(F.min(date_col).alias("_start"))
    t = (f.join(start, "business_id").where(F.col(date_col) < F.date_add("_start", days))
         .groupBy("business_id", date_col).agg(F.sum(qty).cast("long").alias("total")))
    w = Window.partitionBy("business_id")  # at most ``days`` rows per business
    best = F.min_by(F.col(date_col), F.struct(-F.col("total"), F.col(date_col))).over(w)
    worst = F.min_by(F.col(date_col), F.struct(F.col("total"), F.col(date_col))).over(w)
    return t.select("business_id", date_col, "total", (F.col(date_col) == best).alias("busiest"),
                    (F.col(date_col) == worst).alias("slowest"))


def series_points(daily: DataFrame, value: str = "quantity") -> DataFrame:
    """A-27: per item, its (date, value) points in date order, as rows with a
    position (the flat form of an ordered list; collect per item only at the edge)."""
    d, _ = with_business(daily)
    w = Window.partitionBy("business_id", "item_name").orderBy("date")
    return d.select("business_id", "item_name", F.row_number().over(w).alias("pos"), "date", value)


def value_counts(df: DataFrame, col: str, k: int = 10) -> DataFrame:
    """A-29: frequency of ``col`` per business, top ``k`` (count desc, value asc)."""
    d, _ = with_business(df)
    c = d.groupBy("business_id", col).agg(F.count(F.lit(1)).alias("count"))
    return top_k(c, ["business_id"], [F.col("count").desc(), F.col(col)], k)


def pivot_last_days(daily: DataFrame, days: int = 7, value: str = "quantity") -> DataFrame:
    """A-30: items x the last ``days`` days of each business, missing -> 0.
    Pivot values are the known day offsets 0..days-1, so no extra pass runs to
    discover them."""
    d, _ = with_business(daily)
    d = with_as_of(d, "date", "_last")
    d = d.where(F.col("date") > F.date_sub("_last", days)).withColumn(
        "_day", F.concat(F.lit("d"), (F.lit(days - 1) - F.datediff("_last", "date")).cast("string")))
    names = [f"d{i}" for i in range(days)]
    return (d.groupBy("business_id", "item_name").pivot("_day", names).agg(F.sum(value)).fillna(0.0, names))


def distinct_orders(sales: DataFrame) -> DataFrame:
    """A-32: number of distinct order ids per business."""
    s, _ = with_business(sales)
    return s.groupBy("business_id").agg(F.countDistinct("order_id").alias("orders"))


def last_messages(messages: DataFrame, n: int = 10, key: str = "conv_id", order: str = "turn") -> DataFrame:
    """W-13: the last ``n`` messages of every conversation, oldest first."""
    w = Window.partitionBy(key).orderBy(F.col(order).desc())
    last = messages.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n)
    return last.select("*", (F.lit(n) + 1 - F.col("_rn")).alias("_pos")).drop("_rn")


def day_digest(days: DataFrame, holidays: DataFrame, games: DataFrame, school: DataFrame,
               totals: DataFrame) -> DataFrame:
    """A-31: per (business, date): holiday names, game names and school events
    covering the day, each joined with ', ' in name order, plus the predicted total."""
    def names_per_day(df: DataFrame, alias: str) -> DataFrame:
        return df.groupBy("date").agg(F.array_join(F.sort_array(F.collect_list("name")), ", ").alias(alias))

    sch = (school.select("name", F.explode(F.sequence("start_date", F.coalesce("end_date", "start_date")))
                         .alias("date")))
    d = (days.join(F.broadcast(names_per_day(holidays, "holidays")), "date", "left")
         .join(F.broadcast(names_per_day(games, "games")), "date", "left")
         .join(F.broadcast(names_per_day(sch, "school")), "date", "left")
         .join(totals, ["business_id", "date"], "left"))
    return d.select("business_id", "date", F.coalesce("holidays", F.lit("")).alias("holidays"),
                    F.coalesce("games", F.lit("")).alias("games"), F.coalesce("school", F.lit("")).alias("school"),
                    F.coalesce("predicted_total", F.lit(0)).cast("long").alias("predicted_total"))
