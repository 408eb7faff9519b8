"""Provider-shaped JSON documents built from the driver tables.

The reference receives these payloads from point-of-sale and calendar web
services (not built). To exercise the flatteners on data that grows with the
tables, each order of ``orders`` (with its ``lineitem`` rows and ``part``
names) is rendered as a Square / Shopify / Toast / Clover order, each part as
a catalogue item, and the calendars as weather / holiday / games payloads.
One document per order or part: documents stay small however large the
tables get; the per-order line list is bounded by the order's size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import read_table


def cents(x) -> Column:
    c = F.col(x) if isinstance(x, str) else x
    return F.round(c * 100).cast("long")


def order_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """order -> business_id (region of the customer's nation)."""
    o = read_table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus",
                                                  "o_totalprice", "o_orderdate")
    c = read_table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    n = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (o.join(c, o.o_custkey == c.c_custkey).join(F.broadcast(n), F.col("c_nationkey") == n.n_nationkey)
            .select("o_orderkey", "o_orderstatus", "o_totalprice", "o_orderdate",
                    F.col("n_regionkey").cast("long").alias("business_id")))


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read_table(spark, sf_dir, "lineitem").select("l_orderkey", "l_partkey", "l_quantity",
                                                      "l_extendedprice", "l_returnflag")
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_retailprice")
    return li.join(p, li.l_partkey == p.p_partkey)


def _iso_z(ts: str) -> Column:
    return F.date_format(F.col(ts), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def square_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.col("p_name").alias("name"), F.col("l_quantity").cast("int").cast("string").alias("quantity"),
        F.struct(cents("p_retailprice").alias("amount")).alias("base_price_money"),
        F.struct(cents("l_extendedprice").alias("amount")).alias("total_money"))).alias("line_items"))
    o = order_business(spark, sf_dir)
    j = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    doc = F.struct(F.col("o_orderkey").cast("string").alias("id"), _iso_z("o_orderdate").alias("created_at"),
                   F.when(F.col("o_orderstatus") == "F", "COMPLETED").otherwise("OPEN").alias("state"),
                   F.struct(cents("o_totalprice").alias("amount")).alias("total_money"), "line_items")
    return j.select("business_id", F.to_json(doc).alias("payload"))


def shopify_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.col("p_name").alias("title"), F.col("l_quantity").cast("long").alias("quantity"),
        F.col("p_retailprice").cast("string").alias("price"))).alias("line_items"))
    o = order_business(spark, sf_dir)
    j = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    doc = F.struct(F.col("o_orderkey").alias("id"), _iso_z("o_orderdate").alias("created_at"),
                   F.col("o_totalprice").cast("string").alias("total_price"), "line_items")
    return j.select("business_id", F.to_json(doc).alias("payload"))


def toast_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One check per return flag of the order's lines (a natural split)."""
    checks = (_lines(spark, sf_dir).groupBy("l_orderkey", "l_returnflag")
              .agg(F.sum("l_extendedprice").alias("totalAmount"),
                   F.collect_list(F.struct(F.col("p_name").alias("displayName"),
                                           F.col("l_quantity").alias("quantity"),
                                           F.col("p_retailprice").alias("price"))).alias("selections"))
              .groupBy("l_orderkey").agg(F.collect_list(F.struct("totalAmount", "selections")).alias("checks")))
    o = order_business(spark, sf_dir)
    j = o.join(checks, o.o_orderkey == checks.l_orderkey, "left")
    doc = F.struct(F.col("o_orderkey").cast("string").alias("guid"),
                   F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("openedDate"), "checks")
    return j.select("business_id", F.to_json(doc).alias("payload"))


def clover_orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _lines(spark, sf_dir).groupBy("l_orderkey").agg(F.collect_list(F.struct(
        F.col("p_name").alias("name"), cents("p_retailprice").alias("price"))).alias("elements"))
    o = order_business(spark, sf_dir)
    j = o.join(lines, o.o_orderkey == lines.l_orderkey, "left")
    doc = F.struct(F.col("o_orderkey").cast("string").alias("id"),
                   F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("createdTime"),
                   cents("o_totalprice").alias("total"), F.struct("elements").alias("lineItems"))
    return j.select("business_id", F.to_json(doc).alias("payload"))


def _parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read_table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_brand", "p_type", "p_retailprice")
    # business = the brand's manufacturer digit (Brand#MN -> M - 1)
    return p.withColumn("business_id", (F.substring("p_brand", 7, 1).cast("int") - 1).cast("long"))


def square_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    var = F.struct(F.struct(F.col("p_brand").alias("sku"),
                            F.struct(cents("p_retailprice").alias("amount")).alias("price_money")
                            ).alias("item_variation_data"))
    doc = F.struct(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"),
                   F.when(F.col("p_type").startswith("PROMO"), "CATEGORY").otherwise("ITEM").alias("type"),
                   F.struct(F.col("p_name").alias("name"), F.col("p_type").alias("category_id"),
                            F.array(var).alias("variations")).alias("item_data"))
    return p.select("business_id", F.to_json(doc).alias("payload"))


def shopify_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    doc = F.struct(F.col("p_partkey").alias("id"), F.col("p_name").alias("title"),
                   F.col("p_type").alias("product_type"),
                   F.array(F.struct(F.col("p_retailprice").cast("string").alias("price"),
                                    F.col("p_brand").alias("sku"))).alias("variants"))
    return p.select("business_id", F.to_json(doc).alias("payload"))


def toast_menus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One menu per part: one group (the part type) holding the one item."""
    p = _parts(spark, sf_dir)
    item = F.struct(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("guid"),
                    F.col("p_name").alias("name"), F.col("p_brand").alias("sku"),
                    F.struct(F.col("p_retailprice").alias("basePrice")).alias("pricing"))
    menus = F.array(F.struct(F.array(F.struct(F.col("p_type").alias("name"),
                                              F.array(item).alias("items"))).alias("groups")))
    return p.select("business_id", F.to_json(menus).alias("payload"))


def clover_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _parts(spark, sf_dir)
    doc = F.struct(F.concat(F.lit("P"), F.col("p_partkey").cast("string")).alias("id"),
                   F.col("p_name").alias("name"), F.col("p_brand").alias("sku"),
                   cents("p_retailprice").alias("price"),
                   F.struct(F.array(F.struct(F.col("p_type").alias("name"))).alias("elements")).alias("categories"))
    return p.select("business_id", F.to_json(doc).alias("payload"))


def weather_docs(weather: DataFrame) -> DataFrame:
    """One struct-of-arrays payload per calendar month of the weather table."""
    m = weather.groupBy(F.trunc("date", "month").alias("month")).agg(
        F.sort_array(F.collect_list(F.struct("date", "temp_max", "temp_min", "precipitation",
                                             "weather_code"))).alias("_d"))
    daily = F.struct(
        F.transform("_d", lambda r: F.date_format(r["date"], "yyyy-MM-dd")).alias("time"),
        F.transform("_d", lambda r: r["temp_max"]).alias("temperature_2m_max"),
        F.transform("_d", lambda r: r["temp_min"]).alias("temperature_2m_min"),
        F.transform("_d", lambda r: r["precipitation"]).alias("precipitation_sum"),
        F.transform("_d", lambda r: r["weather_code"]).alias("weathercode"))
    return m.select("month", F.to_json(F.struct(daily.alias("daily"))).alias("payload"))


def holiday_docs(holidays: DataFrame) -> DataFrame:
    """One payload per year: [{date, localName, name, types}]."""
    y = holidays.groupBy(F.year("date").alias("year")).agg(F.collect_list(F.struct(
        F.date_format("date", "yyyy-MM-dd").alias("date"), F.col("name").alias("localName"),
        F.col("name").alias("name"), F.array("type").alias("types"))).alias("_h"))
    return y.select("year", F.to_json("_h").alias("payload"))


def games_docs(games: DataFrame) -> DataFrame:
    """One payload per year; January games list a single competitor."""
    team = lambda n: F.struct(F.struct(F.lit(n).alias("displayName")).alias("team"))
    competitors = F.when(F.month("date") == 1, F.array(team("Home"))).otherwise(F.array(team("Home"), team("Away")))
    ev = F.struct(F.date_format("date", "yyyy-MM-dd'T'18:00'Z'").alias("date"), F.col("name").alias("name"),
                  F.array(F.struct(F.struct(F.col("venue").alias("fullName")).alias("venue"),
                                   competitors.alias("competitors"))).alias("competitions"))
    y = games.groupBy(F.year("date").alias("year")).agg(F.collect_list(ev).alias("events"))
    return y.select("year", F.to_json(F.struct("events")).alias("payload"))
