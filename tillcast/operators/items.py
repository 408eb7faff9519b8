"""Item profiles, hourly patterns, item lookup fallbacks and size expansion.

A-05..A-15, J-21..J-23, P-01..P-04, F-26.

Every profile is a ``groupBy`` with partial aggregation, so a hot item costs
one partial row per map task. Collections (sizes, size shares) hold at most
one entry per distinct size of an item: bounded by the catalogue, not by sales.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.dates import parse_hour
from ..util import with_business
from .ranking import with_position

DEFAULT_CATEGORY = "Other"
OVERALL_SCOPE = "_overall"


def item_size_stats(sales: DataFrame, value: str | None = "quantity") -> DataFrame:
    """One aggregate over the raw sales at (business, item, size) grain, from
    which every item profile below is derived: a single scan and shuffle of the
    sales however many profiles are asked for (Spark reuses the exchange when
    several profiles of one plan read it). Rows with a NULL size keep a NULL
    size group (they count in the quantity denominator, A-09)."""
    df, _ = with_business(sales)
    df = df.where(F.col("item_name").isNotNull())
    measure = F.col(value) if value and value in df.columns else F.lit(1.0)
    # only fixed-width buffers (counts, sums, min/max of numbers): a hash
    # aggregate with map-side combine; the first type (a string-ordered pick)
    # is its own aggregate in ``item_category``
    return df.groupBy("business_id", "item_name", F.col("size").cast("string").alias("size")).agg(
        F.count(F.lit(1)).alias("rows"),
        F.coalesce(F.sum(measure), F.lit(0.0)).cast("double").alias("qty"),
        F.sum("unit_price").alias("price_sum"), F.count("unit_price").alias("price_n"),
        F.min("unit_price").alias("price_min"), F.max("unit_price").alias("price_max"),
        F.sum(F.col("unit_price").cast("decimal(18,6)")).alias("price_total"))


def _size_stats(sales: DataFrame, stats: DataFrame | None) -> DataFrame:
    return stats if stats is not None else item_size_stats(sales)


def _items(stats: DataFrame):
    return stats.groupBy("business_id", "item_name")


def item_category(sales: DataFrame) -> DataFrame:
    """A-06: first non-NULL ``type`` of each item, 'first' = earliest by
    (date, order_id, type) (Q27). Items without any type get 'Other'."""
    df, _ = with_business(sales)
    # the earliest date is a fixed-width hash aggregate over all rows; only that
    # day's rows meet the string-ordered pick
    named = df.where(F.col("item_name").isNotNull()).select("business_id", "item_name", "type", "date", "order_id")
    per_item = named.groupBy("business_id", "item_name").agg(
        F.min(F.when(F.col("type").isNotNull(), F.col("date"))).alias("_first"))
    day = (named.where(F.col("type").isNotNull()).join(per_item, ["business_id", "item_name"])
           .where(F.col("date").eqNullSafe(F.col("_first")))
           .groupBy("business_id", "item_name").agg(F.min_by("type", F.struct("order_id", "type")).alias("category")))
    return (per_item.drop("_first").join(day, ["business_id", "item_name"], "left")
            .withColumn("category", F.coalesce("category", F.lit(DEFAULT_CATEGORY))))


def item_sizes(sales: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """A-07: sorted distinct non-NULL sizes per item (array; one entry per size)."""
    return (_items(_size_stats(sales, stats).where(F.col("size").isNotNull()))
            .agg(F.sort_array(F.collect_list("size")).alias("sizes")))


def primary_size(sales: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """A-08: most frequent size (rows), smallest on ties."""
    return (_items(_size_stats(sales, stats).where(F.col("size").isNotNull()))
            .agg(F.min_by("size", F.struct(-F.col("rows"), F.col("size"))).alias("primary_size")))


def size_distribution(sales: DataFrame, value: str | None = "quantity", stats: DataFrame | None = None) -> DataFrame:
    """A-09: share of the item's quantity per size, as flat rows
    (business_id, item_name, size, share). The denominator includes rows with
    a NULL size; without a quantity column, rows are counted. Items whose total
    is not > 0 get no shares."""
    st = stats if stats is not None else item_size_stats(sales, value)
    w = Window.partitionBy("business_id", "item_name")  # one row per size of the item
    shares = st.withColumn("_total", F.sum("qty").over(w))
    return (shares.where(F.col("size").isNotNull() & (F.col("_total") > 0))
            .select("business_id", "item_name", "size", (F.col("qty") / F.col("_total")).alias("share")))


def size_prices(sales: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """A-10: mean unit price per (item, size), NULL prices skipped."""
    st = _size_stats(sales, stats).where(F.col("size").isNotNull() & (F.col("price_n") > 0))
    return st.select("business_id", "item_name", "size", (F.col("price_sum") / F.col("price_n")).alias("size_price"))


def price_stats(sales: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """A-11: mean, min and max unit price per item."""
    return (_items(_size_stats(sales, stats)).agg(
        (F.sum("price_sum") / F.sum("price_n")).alias("unit_price"), F.min("price_min").alias("min_price"),
        F.max("price_max").alias("max_price")).where(F.col("unit_price").isNotNull()))


def category_index(categories: DataFrame) -> DataFrame:
    """A-13: category -> its items in order, one row per item with its position.

    The default category can hold most of a catalogue, so positions come from a
    range-partitioned sort and not from a window over the category."""
    placed = with_position(categories.select("business_id", "category", "item_name"), ["business_id", "category"], ["item_name"])
    return placed.select("business_id", "category", (F.col("pos") + 1).cast("int").alias("pos"), "item_name")


def category_average(daily: DataFrame, categories: DataFrame, value: str = "quantity") -> DataFrame:
    """A-05: mean daily-item quantity per category."""
    df, _ = with_business(daily)
    return (df.join(categories, ["business_id", "item_name"], "left")
            .withColumn("category", F.coalesce("category", F.lit(DEFAULT_CATEGORY)))
            .groupBy("business_id", "category").agg(F.avg(value).alias("category_avg")))


def item_metadata(sales: DataFrame, daily: DataFrame, stats: DataFrame | None = None,
                  categories: DataFrame | None = None) -> DataFrame:
    """All per-item metadata in one row per item (category, sizes, primary size,
    size shares / prices as maps, price stats, average daily quantity).
    ``stats`` / ``categories``: a precomputed ``item_size_stats`` / ``item_category``."""
    dist = (size_distribution(sales, stats=stats).groupBy("business_id", "item_name")
            .agg(F.map_from_entries(F.collect_list(F.struct("size", "share"))).alias("size_distribution")))
    prices = (size_prices(sales, stats).groupBy("business_id", "item_name")
              .agg(F.map_from_entries(F.collect_list(F.struct("size", "size_price"))).alias("size_prices")))
    d, _ = with_business(daily)
    avg_daily = d.groupBy("business_id", "item_name").agg(F.avg("quantity").alias("avg_daily_qty"))
    keys = ["business_id", "item_name"]
    category = categories if categories is not None else item_category(sales)
    return (category.join(item_sizes(sales, stats), keys, "left")
            .join(primary_size(sales, stats), keys, "left").join(dist, keys, "left")
            .join(prices, keys, "left").join(price_stats(sales, stats), keys, "left")
            .join(avg_daily, keys, "left"))


def hourly_patterns(timed: DataFrame, value: str = "quantity", time_col: str = "time") -> DataFrame:
    """A-14 + A-15: per (item, hour) from the raw rows, then per hour over all
    items (scope '_overall') from those few rows. Percentage of the scope's
    total, half-even to 1 decimal; 0 when the total is not > 0."""
    df, _ = with_business(timed)
    df = df.where(F.col("item_name").isNotNull()).withColumn("hour", parse_hour(time_col)).where(
        F.col("hour").isNotNull())
    per_item = df.groupBy("business_id", "item_name", "hour").agg(F.sum(value).alias("_sum"), F.count(value).alias("count"))
    overall = per_item.groupBy("business_id", "hour").agg(F.sum("_sum").alias("_sum"), F.sum("count").alias("count"))
    g = (per_item.withColumnRenamed("item_name", "scope")
         .unionByName(overall.withColumn("scope", F.lit(OVERALL_SCOPE)))
         .select("business_id", "scope", "hour", F.coalesce("_sum", F.lit(0.0)).alias("sum"), "count",
                 F.when(F.col("count") > 0, F.col("_sum") / F.col("count")).alias("mean")))
    w = Window.partitionBy("business_id", "scope")  # <= 24 rows per scope
    total = F.sum("sum").over(w)
    pct = F.when(total > 0, F.bround(F.col("sum") / total * 100, 1)).otherwise(F.lit(0.0))
    return g.select("business_id", "scope", "hour", "sum", "count", "mean", pct.alias("percentage"))


# ---------------------------------------------------------------- lookups

GRAM = 3  # longest gram of the substring index


def _grams(s: Column, longest: int = GRAM) -> Column:
    """The distinct substrings of up to ``longest`` characters: at most ``longest`` x length of them."""
    def of(k: int) -> Column:
        starts = F.when(F.length(s) >= k, F.sequence(F.lit(1), F.length(s) - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: F.substring(s, i, F.lit(k)))
    return F.array_distinct(F.flatten(F.array(*[of(k) for k in range(1, longest + 1)])))


def _contained(inner: DataFrame, outer: DataFrame) -> DataFrame:
    """(business_id, a, b) with ``a`` a value of ``inner`` and a substring of ``b``, a value of ``outer``.

    ``outer`` is indexed by its grams; an inner value is looked up by one key,
    the rarest in the index of its grams of ``GRAM`` characters (a shorter value
    is its own gram), and every hit is verified. A value with a gram that the
    index lacks is contained nowhere and is not joined at all."""
    index = outer.select("business_id", "b", F.explode(_grams(F.col("b"))).alias("g"))
    often = index.groupBy("business_id", "g").agg(F.count("*").alias("n"))
    own = F.filter(_grams(F.col("a")), lambda g: F.length(g) == F.least(F.length("a"), F.lit(GRAM)))
    probes = inner.select("business_id", "a", F.explode(own).alias("g")).join(often, ["business_id", "g"], "left")
    rarest = probes.groupBy("business_id", "a").agg(
        F.min_by("g", F.struct("n", "g")).alias("g"), F.count_if(F.col("n").isNull()).alias("lacking")).where("lacking = 0")
    return (rarest.join(index, ["business_id", "g"]).where(F.contains(F.col("b"), F.col("a")))
            .select("business_id", "a", "b"))


def similar_items(names: DataFrame, known: DataFrame) -> DataFrame:
    """J-22: for each name, the known item that contains it or is contained in
    it (case-insensitive). Either direction is a lookup of the shorter value in
    a gram index of the longer ones (``_contained``), so a name costs keys in
    proportion to its length. Deterministic pick (Q15): closest length, then
    category, then item name.

    ``names``: (business_id, name); ``known``: (business_id, item_name, category).
    """
    nm = names.select("business_id", "name", F.lower("name").alias("_lname")).where(F.length("_lname") > 0)
    kn = known.select("business_id", "item_name", "category", F.lower("item_name").alias("_lknown"))
    short = nm.select("business_id", F.col("_lname").alias("a")).distinct()
    long = kn.where(F.length("_lknown") > 0).select("business_id", F.col("_lknown").alias("b")).distinct()
    pairs = _contained(short, long).select("business_id", F.col("a").alias("_lname"), F.col("b").alias("_lknown")).union(
        _contained(long.withColumnRenamed("b", "a"), short.withColumnRenamed("a", "b")).select("business_id", "b", "a")).distinct()
    cand = nm.join(pairs, ["business_id", "_lname"]).join(kn, ["business_id", "_lknown"])
    rank = F.struct(F.abs(F.length("_lknown") - F.length("_lname")).alias("d"),
                    F.col("category").alias("c"), F.col("item_name").alias("i"))
    return (cand.groupBy("business_id", "name")
            .agg(F.min_by("item_name", rank).alias("similar_item"),
                 F.min_by("category", rank).alias("similar_category")))


def item_code_lookup(names: DataFrame, codes: DataFrame, known: DataFrame,
                     avg_daily: DataFrame) -> DataFrame:
    """J-21: name -> trained code; unknown -> similar item's code, else the code
    of the best seller (highest average daily quantity, name as tie-break),
    else -1. ``codes``: (business_id, item_name, item_encoded)."""
    direct = names.select("business_id", "name").distinct().join(
        codes.withColumnRenamed("item_name", "name"), ["business_id", "name"], "left")
    sim = similar_items(direct.where(F.col("item_encoded").isNull()).select("business_id", "name"), known)
    sim_code = sim.join(codes.select("business_id", F.col("item_name").alias("similar_item"),
                                     F.col("item_encoded").alias("_sim_code")),
                        ["business_id", "similar_item"], "left")
    best = (avg_daily.join(codes, ["business_id", "item_name"])
            .groupBy("business_id")
            .agg(F.max_by("item_encoded", F.struct("avg_daily_qty", F.col("item_name"))).alias("_best_code")))
    out = (direct.join(sim_code.select("business_id", "name", "_sim_code"), ["business_id", "name"], "left")
           .join(best, "business_id", "left"))
    return out.select("business_id", "name",
                      F.coalesce("item_encoded", "_sim_code", "_best_code", F.lit(-1)).cast("int")
                      .alias("item_encoded"))


def fallback_quantity(names: DataFrame, avg_daily: DataFrame, known: DataFrame,
                      category_avg: DataFrame, global_avg: DataFrame) -> DataFrame:
    """J-23: item's own average daily quantity -> similar item's category
    average -> business average."""
    own = names.select("business_id", "name").distinct().join(
        avg_daily.withColumnRenamed("item_name", "name"), ["business_id", "name"], "left")
    sim = similar_items(own.where(F.col("avg_daily_qty").isNull()).select("business_id", "name"), known).join(
        category_avg.withColumnRenamed("category", "similar_category"),
        ["business_id", "similar_category"], "left")
    out = (own.join(sim.select("business_id", "name", "category_avg"), ["business_id", "name"], "left")
           .join(global_avg, "business_id", "left"))
    return out.select("business_id", "name",
                      F.coalesce("avg_daily_qty", "category_avg", "global_avg", F.lit(0.0)).alias("fallback_qty"))


# ---------------------------------------------------------------- size expansion

def money(total: Column, n: Column, qty: Column | None = None) -> Column:
    """Half-even to whole cents of (qty x) total / n, ``total`` an exact decimal
    sum of the given prices: the division is done with remainders, so neither
    summation order nor a rounded quotient can turn a tie."""
    cents = total * F.lit(100) if qty is None else total * F.lit(100) * qty.cast("decimal(10,0)")
    count = n.cast("decimal(20,0)")
    rest = F.pmod(cents, count)
    whole = ((cents - rest) / count).cast("decimal(38,0)")
    up = (rest * 2 > count) | ((rest * 2 == count) & (F.pmod(whole, F.lit(2)) == 1))
    return (whole + F.when(up, 1).otherwise(0)).cast("double") / 100


def size_profile(sales: DataFrame, value: str | None = "quantity", stats: DataFrame | None = None) -> DataFrame:
    """Per (item, size): quantity share (A-09) and the price as exact
    sum + count (A-10), one row per size. ``stats``: a precomputed
    ``item_size_stats`` (e.g. materialised once for several profiles)."""
    st = stats if stats is not None else item_size_stats(sales, value)
    w = Window.partitionBy("business_id", "item_name")  # one row per size of the item
    return (st.withColumn("_total", F.sum("qty").over(w))
            .where(F.col("size").isNotNull() & (F.col("_total") > 0))
            .select("business_id", "item_name", "size", (F.col("qty") / F.col("_total")).alias("share"),
                    "price_total", "price_n"))


def item_profile(sales: DataFrame, stats: DataFrame | None = None) -> DataFrame:
    """Per item: category (A-06), sizes (A-07), primary size (A-08), number of
    size shares and the item price as exact sum + count (A-11), all
    from the one (item, size) aggregate."""
    st = stats if stats is not None else item_size_stats(sales)
    w = Window.partitionBy("business_id", "item_name")
    st = st.withColumn("_total", F.sum("qty").over(w))
    sized = F.col("size").isNotNull()
    prof = _items(st).agg(
        F.sort_array(F.collect_list(F.when(sized, F.col("size")))).alias("sizes"),
        F.min_by(F.when(sized, F.col("size")), F.when(sized, F.struct(-F.col("rows"), F.col("size"))))
        .alias("primary_size"),
        F.count(F.when(sized & (F.col("_total") > 0), 1)).alias("n_sizes"),
        F.sum("price_total").alias("item_total"), F.sum("price_n").alias("item_n"))
    return item_category(sales).join(prof, ["business_id", "item_name"])


def expand_by_size(predictions: DataFrame, items: DataFrame, sizes: DataFrame,
                   qty_col: str = "predicted_quantity") -> DataFrame:
    """P-01..P-04: attach item metadata to each prediction; items with more than
    one size share get one row per size (a join on the item's size rows, at most
    one per size) with quantity max(1, round(base x share)) (half-even), the
    size's mean price (else the item's), revenue = round(qty x price, 2) and the
    share in percent; other items keep one row with the primary size (Q14).
    A zero price gives NULL price and revenue, as in the reference.
    """
    keys = ["business_id", "item_name"]
    base = [c for c in predictions.columns if c != qty_col]
    j = predictions.join(items, keys, "left")
    multi = F.coalesce(F.col("n_sizes"), F.lit(0)) > 1
    many = j.where(multi).join(sizes, keys)
    use_size = F.col("price_n") > 0
    total = F.when(use_size, F.col("price_total")).otherwise(F.col("item_total"))
    n = F.when(use_size, F.col("price_n")).otherwise(F.col("item_n"))
    qty = F.greatest(F.lit(1), F.bround(F.col(qty_col) * F.col("share"), 0).cast("int"))
    nonzero = total != 0
    many = many.select(
        *base, qty.alias(qty_col), "size",
        F.when(nonzero, money(total, n)).alias("unit_price"),
        F.when(nonzero, money(total, n, qty)).alias("predicted_revenue"),
        "category", F.coalesce("sizes", F.array().cast("array<string>")).alias("available_sizes"),
        F.bround(F.col("share") * 100, 1).alias("size_proportion"))
    has_price = F.coalesce(F.col("item_n"), F.lit(0)) > 0
    one = j.where(~multi).select(
        *base, F.col(qty_col), F.col("primary_size").alias("size"),
        F.when(has_price, money(F.col("item_total"), F.col("item_n"))).alias("unit_price"),
        F.when(has_price, money(F.col("item_total"), F.col("item_n"), F.col(qty_col))).alias("predicted_revenue"),
        "category", F.coalesce("sizes", F.array().cast("array<string>")).alias("available_sizes"),
        F.lit(None).cast("double").alias("size_proportion"))
    return many.unionByName(one)

