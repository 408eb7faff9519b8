"""Point-of-sale provider payloads -> canonical ORDERS / PRODUCTS / SALES rows.

S-11..S-21, S-25..S-27.

Every payload is a JSON string column parsed with ``from_json`` and an explicit
schema (no inference pass), then reshaped with higher-order functions
(``transform``, ``aggregate``, ``flatten``) inside one projection. Documents
are independent rows, so parsing is embarrassingly parallel; the only
shuffle-free fan-out is ``explode`` of line items.

ORDERS: external_id, order_date TIMESTAMP, total_amount DOUBLE, item_count INT,
        line_items ARRAY<STRUCT<name, quantity DOUBLE, unit_price DOUBLE, total DOUBLE>>
PRODUCTS: external_id, name, category, sku, price DOUBLE
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

LINE = T.StructType([T.StructField("name", T.StringType()), T.StructField("quantity", T.DoubleType()),
                     T.StructField("unit_price", T.DoubleType()), T.StructField("total", T.DoubleType())])

_MONEY = T.StructType([T.StructField("amount", T.LongType())])

SQUARE_ORDER = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("created_at", T.StringType()),
    T.StructField("state", T.StringType()), T.StructField("total_money", _MONEY),
    T.StructField("line_items", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("quantity", T.StringType()),
        T.StructField("base_price_money", _MONEY), T.StructField("total_money", _MONEY)]))),
])

SHOPIFY_ORDER = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("created_at", T.StringType()),
    T.StructField("total_price", T.StringType()),
    T.StructField("line_items", T.ArrayType(T.StructType([
        T.StructField("title", T.StringType()), T.StructField("quantity", T.LongType()),
        T.StructField("price", T.StringType())]))),
])

TOAST_ORDER = T.StructType([
    T.StructField("guid", T.StringType()), T.StructField("openedDate", T.StringType()),
    T.StructField("checks", T.ArrayType(T.StructType([
        T.StructField("totalAmount", T.DoubleType()),
        T.StructField("selections", T.ArrayType(T.StructType([
            T.StructField("displayName", T.StringType()), T.StructField("quantity", T.DoubleType()),
            T.StructField("price", T.DoubleType())])))]))),
])

CLOVER_ORDER = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("createdTime", T.LongType()),
    T.StructField("total", T.LongType()),
    T.StructField("lineItems", T.StructType([T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType()), T.StructField("price", T.LongType())])))])),
])

SQUARE_PRODUCT = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("type", T.StringType()),
    T.StructField("item_data", T.StructType([
        T.StructField("name", T.StringType()), T.StructField("category_id", T.StringType()),
        T.StructField("variations", T.ArrayType(T.StructType([T.StructField("item_variation_data", T.StructType([
            T.StructField("sku", T.StringType()), T.StructField("price_money", _MONEY)]))])))])),
])

SHOPIFY_PRODUCT = T.StructType([
    T.StructField("id", T.LongType()), T.StructField("title", T.StringType()),
    T.StructField("product_type", T.StringType()),
    T.StructField("variants", T.ArrayType(T.StructType([
        T.StructField("price", T.StringType()), T.StructField("sku", T.StringType())]))),
])

TOAST_MENUS = T.ArrayType(T.StructType([T.StructField("groups", T.ArrayType(T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("items", T.ArrayType(T.StructType([
        T.StructField("guid", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("sku", T.StringType()),
        T.StructField("pricing", T.StructType([T.StructField("basePrice", T.DoubleType())]))])))])))]))

CLOVER_ITEM = T.StructType([
    T.StructField("id", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("sku", T.StringType()), T.StructField("price", T.LongType()),
    T.StructField("categories", T.StructType([T.StructField("elements", T.ArrayType(T.StructType([
        T.StructField("name", T.StringType())])))])),
])

WEATHER_DOC = T.StructType([T.StructField("daily", T.StructType([
    T.StructField("time", T.ArrayType(T.StringType())),
    T.StructField("temperature_2m_max", T.ArrayType(T.DoubleType())),
    T.StructField("temperature_2m_min", T.ArrayType(T.DoubleType())),
    T.StructField("precipitation_sum", T.ArrayType(T.DoubleType())),
    T.StructField("weathercode", T.ArrayType(T.LongType()))]))])

HOLIDAY_DOC = T.ArrayType(T.StructType([
    T.StructField("date", T.StringType()), T.StructField("localName", T.StringType()),
    T.StructField("name", T.StringType()), T.StructField("types", T.ArrayType(T.StringType()))]))

GAMES_DOC = T.StructType([T.StructField("events", T.ArrayType(T.StructType([
    T.StructField("date", T.StringType()), T.StructField("name", T.StringType()),
    T.StructField("competitions", T.ArrayType(T.StructType([
        T.StructField("venue", T.StructType([T.StructField("fullName", T.StringType())])),
        T.StructField("competitors", T.ArrayType(T.StructType([T.StructField("team", T.StructType([
            T.StructField("displayName", T.StringType())]))])))])))])))])


def _cents(amount: Column) -> Column:
    return F.coalesce(amount, F.lit(0)).cast("double") / 100


def _iso_instant(text: Column) -> Column:
    """ISO-8601 text with 'Z' or an offset -> TIMESTAMP (an instant)."""
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")),
                      F.try_to_timestamp(text, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]")),
                      F.try_to_timestamp(text))


def _orders(df: DataFrame, external_id: Column, order_date: Column, total: Column, lines: Column,
            keep: list[str]) -> DataFrame:
    lines = F.coalesce(lines, F.array().cast(T.ArrayType(LINE)))
    return df.select(*keep, external_id.cast("string").alias("external_id"), order_date.alias("order_date"),
                     total.cast("double").alias("total_amount"), F.size(lines).alias("item_count"),
                     lines.alias("line_items"))


def _parsed(df: DataFrame, col: str, schema) -> tuple[DataFrame, list[str]]:
    keep = [c for c in df.columns if c != col]
    return df.select(*keep, F.from_json(col, schema).alias("_d")), keep


def flatten_square_orders(docs: DataFrame, col: str = "payload", start=None, end=None,
                          completed_only: bool = True) -> DataFrame:
    """S-11: cents / 100, string quantity -> number, name default 'Unknown';
    only COMPLETED orders, optionally created within [start, end] (dates)."""
    df, keep = _parsed(docs, col, SQUARE_ORDER)
    d = F.col("_d")
    lines = F.transform(d["line_items"], lambda li: F.struct(
        F.coalesce(li["name"], F.lit("Unknown")).alias("name"),
        F.coalesce(li["quantity"], F.lit("1")).try_cast("double").alias("quantity"),
        _cents(li["base_price_money"]["amount"]).alias("unit_price"),
        _cents(li["total_money"]["amount"]).alias("total")))
    when = _iso_instant(d["created_at"])
    out = df
    if completed_only:
        out = out.where(d["state"] == "COMPLETED")
    if start is not None:
        out = out.where(when >= F.to_timestamp(F.lit(f"{start} 00:00:00")))
    if end is not None:
        out = out.where(when <= F.to_timestamp(F.lit(f"{end} 23:59:59")))
    return _orders(out, d["id"], when, _cents(d["total_money"]["amount"]), lines, keep)


def flatten_shopify_orders(docs: DataFrame, col: str = "payload") -> DataFrame:
    """S-12: title, string price -> double, line total = price x quantity."""
    df, keep = _parsed(docs, col, SHOPIFY_ORDER)
    d = F.col("_d")

    def line(li):
        price = F.coalesce(li["price"].try_cast("double"), F.lit(0.0))
        qty = F.coalesce(li["quantity"], F.lit(1)).cast("double")
        return F.struct(F.coalesce(li["title"], F.lit("Unknown")).alias("name"), qty.alias("quantity"),
                        price.alias("unit_price"), (price * qty).alias("total"))

    return _orders(df, d["id"], _iso_instant(d["created_at"]),
                   F.coalesce(d["total_price"].try_cast("double"), F.lit(0.0)),
                   F.transform(d["line_items"], line), keep)


def flatten_toast_orders(docs: DataFrame, col: str = "payload") -> DataFrame:
    """S-13: checks[].selections[] flattened in order; total = sum of check
    totals; a missing openedDate becomes the current time."""
    df, keep = _parsed(docs, col, TOAST_ORDER)
    d = F.col("_d")
    checks = F.coalesce(d["checks"], F.array())

    def sel(s):
        price = F.coalesce(s["price"], F.lit(0.0))
        qty = F.coalesce(s["quantity"], F.lit(1.0))
        return F.struct(F.coalesce(s["displayName"], F.lit("Unknown")).alias("name"), qty.alias("quantity"),
                        price.alias("unit_price"), (price * qty).alias("total"))

    lines = F.flatten(F.transform(checks, lambda c: F.transform(
        F.coalesce(c["selections"], F.array()), sel)))
    total = F.aggregate(checks, F.lit(0.0), lambda acc, c: acc + F.coalesce(c["totalAmount"], F.lit(0.0)))
    when = F.coalesce(_iso_instant(d["openedDate"]), F.current_timestamp())
    return _orders(df, F.coalesce(d["guid"], F.lit("")), when, total, lines, keep)


def flatten_clover_orders(docs: DataFrame, col: str = "payload") -> DataFrame:
    """S-14: epoch milliseconds -> timestamp (0 / missing -> now); quantity 1;
    cents / 100."""
    df, keep = _parsed(docs, col, CLOVER_ORDER)
    d = F.col("_d")
    lines = F.transform(d["lineItems"]["elements"], lambda li: F.struct(
        F.coalesce(li["name"], F.lit("Unknown")).alias("name"), F.lit(1.0).alias("quantity"),
        _cents(li["price"]).alias("unit_price"), _cents(li["price"]).alias("total")))
    ms = F.coalesce(d["createdTime"], F.lit(0))
    when = F.when(ms != 0, F.timestamp_millis(ms)).otherwise(F.current_timestamp())
    return _orders(df, F.coalesce(d["id"], F.lit("")), when, _cents(d["total"]), lines, keep)


def _products(df: DataFrame, keep, external_id, name, category, sku, price) -> DataFrame:
    return df.select(*keep, external_id.cast("string").alias("external_id"),
                     F.coalesce(name, F.lit("Unknown")).alias("name"), category.alias("category"),
                     sku.alias("sku"), price.cast("double").alias("price"))


def flatten_square_products(docs: DataFrame, col: str = "payload") -> DataFrame:
    """S-15: ITEM objects only; first variation's sku and price (cents / 100)."""
    df, keep = _parsed(docs, col, SQUARE_PRODUCT)
    d = F.col("_d")
    first = F.try_element_at(d["item_data"]["variations"], F.lit(1))["item_variation_data"]
    price = F.when(first["price_money"].isNotNull(), _cents(first["price_money"]["amount"]))
    return _products(df.where(d["type"] == "ITEM"), keep, d["id"], d["item_data"]["name"],
                     d["item_data"]["category_id"], first["sku"], price)


def flatten_shopify_products(docs: DataFrame, col: str = "payload") -> DataFrame:
    """S-16: first variant's price (string -> double) and sku."""
    df, keep = _parsed(docs, col, SHOPIFY_PRODUCT)
    d = F.col("_d")
    first = F.try_element_at(d["variants"], F.lit(1))
    price = F.when(first.isNotNull(), F.coalesce(first["price"].try_cast("double"), F.lit(0.0)))
    return _products(df, keep, d["id"], d["title"], d["product_type"], first["sku"], price)


def flatten_toast_products(docs: DataFrame, col: str = "payload") -> DataFrame:
    """S-17: menus -> groups -> items; category = group name; basePrice
    (pricing without basePrice -> 0, no pricing -> NULL)."""
    keep = [c for c in docs.columns if c != col]
    menus = docs.select(*keep, F.explode(F.from_json(col, TOAST_MENUS)).alias("_m"))
    groups = menus.select(*keep, F.explode(F.coalesce("_m.groups", F.array())).alias("_g"))
    items = groups.select(*keep, F.col("_g.name").alias("_cat"),
                          F.explode(F.coalesce("_g.items", F.array())).alias("_i"))
    i = F.col("_i")
    price = F.when(i["pricing"].isNotNull(), F.coalesce(i["pricing"]["basePrice"], F.lit(0.0)))
    return _products(items, keep, F.coalesce(i["guid"], F.lit("")), i["name"], F.col("_cat"), i["sku"], price)


def flatten_clover_products(docs: DataFrame, col: str = "payload") -> DataFrame:
    """S-18: first category name; price cents / 100."""
    df, keep = _parsed(docs, col, CLOVER_ITEM)
    d = F.col("_d")
    cat = F.try_element_at(d["categories"]["elements"], F.lit(1))["name"]
    return _products(df, keep, F.coalesce(d["id"], F.lit("")), d["name"], cat, d["sku"], _cents(d["price"]))


def weather_to_rows(docs: DataFrame, col: str = "payload") -> DataFrame:
    """S-19: struct-of-arrays ``daily`` -> one row per day; a missing array
    gives NULLs. Archive and forecast payloads share this shape."""
    keep = [c for c in docs.columns if c != col]
    d = F.from_json(col, WEATHER_DOC)["daily"]
    z = F.arrays_zip(d["time"].alias("t"), d["temperature_2m_max"].alias("hi"),
                     d["temperature_2m_min"].alias("lo"), d["precipitation_sum"].alias("p"),
                     d["weathercode"].alias("c"))
    rows = docs.select(*keep, F.explode(z).alias("_r"))
    return rows.select(*keep, F.to_date("_r.t").alias("date"), F.col("_r.hi").alias("temp_max"),
                       F.col("_r.lo").alias("temp_min"), F.col("_r.p").alias("precipitation"),
                       F.col("_r.c").cast("int").alias("weather_code"))


def normalize_holidays(docs: DataFrame, col: str = "payload") -> DataFrame:
    """S-20: localName else name; first of types else 'Public'; non-objects skipped."""
    keep = [c for c in docs.columns if c != col]
    rows = docs.select(*keep, F.explode(F.from_json(col, HOLIDAY_DOC)).alias("_h")).where(F.col("_h").isNotNull())
    h = F.col("_h")
    typ = F.coalesce(F.try_element_at(h["types"], F.lit(1)), F.lit("Public"))
    return rows.select(*keep, F.coalesce(h["date"], F.lit("")).alias("date_text"),
                       F.to_date(h["date"]).alias("date"),
                       F.coalesce(h["localName"], h["name"], F.lit("")).alias("name"), typ.alias("type"))


def normalize_games(docs: DataFrame, col: str = "payload", with_venue: bool = True) -> DataFrame:
    """S-21: date = first 10 characters; home / away from the first two
    competitors (away '' when only one); venue default 'Unknown'."""
    keep = [c for c in docs.columns if c != col]
    rows = docs.select(*keep, F.explode(F.from_json(col, GAMES_DOC)["events"]).alias("_e"))
    e = F.col("_e")
    comp = F.try_element_at(e["competitions"], F.lit(1))
    teams = comp["competitors"]
    home = F.coalesce(F.try_element_at(teams, F.lit(1))["team"]["displayName"], F.lit(""))
    away = F.when(F.size(teams) > 1, F.coalesce(F.try_element_at(teams, F.lit(2))["team"]["displayName"],
                                                 F.lit(""))).otherwise(F.lit(""))
    out = [*keep, F.to_date(F.substring(F.coalesce(e["date"], F.lit("")), 1, 10)).alias("date"),
           F.coalesce(e["name"], F.lit("")).alias("name"), home.alias("home_team"), away.alias("away_team")]
    if with_venue:
        out.append(F.coalesce(comp["venue"]["fullName"], F.lit("Unknown")).alias("venue"))
    return rows.select(*out)


def orders_to_sales(orders: DataFrame) -> DataFrame:
    """S-25: one sales row per line item (name 'Unknown', quantity 1 when
    missing); an order without line items gives one 'All Items' row with
    quantity = item_count, or 1 when that is 0 or missing."""
    keep = [c for c in ("business_id", "integration_id") if c in orders.columns]
    rows = orders.select(*keep, "external_id", "order_date", "total_amount", "item_count",
                         F.explode_outer(F.when(F.size("line_items") > 0, F.col("line_items"))).alias("_li"))
    has = F.col("_li").isNotNull()
    ic = F.col("item_count")
    return rows.select(
        *keep, F.to_date("order_date").alias("date"),
        F.when(has, F.coalesce("_li.name", F.lit("Unknown"))).otherwise(F.lit("All Items")).alias("item_name"),
        F.when(has, F.coalesce("_li.quantity", F.lit(1.0)))
        .otherwise(F.when(F.coalesce(ic, F.lit(0)) == 0, F.lit(1.0)).otherwise(ic.cast("double"))).alias("quantity"),
        F.when(has, F.col("_li.unit_price")).alias("unit_price"),
        F.when(has, F.col("_li.total")).otherwise(F.col("total_amount")).alias("total_price"),
        F.col("external_id").alias("order_id"))


def write_sales_csv(sales: DataFrame, path: str) -> None:
    """S-26: CSV export with a header line, no index column; quotes inside
    fields are doubled and blanks at their ends kept."""
    (sales.write.mode("overwrite").option("header", True).option("quote", '"').option("escape", '"')
     .option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path))


def products_lookup(products: DataFrame, business_id=None, integration_id=None) -> DataFrame:
    """S-27: active products as external_id -> (name, category, sku, price)."""
    p = products.where(F.coalesce(F.col("is_active"), F.lit(True)))
    if business_id is not None:
        p = p.where(F.col("business_id") == business_id)
    if integration_id is not None:
        p = p.where(F.col("integration_id") == integration_id)
    return p.select("business_id", "external_id", "name", "category", "sku", "price")


def sync_summary(orders: DataFrame, products: DataFrame) -> DataFrame:
    """A-21: per business: order count, active products, first / last order
    date, revenue (NULL totals count as 0)."""
    o = orders.groupBy("business_id").agg(
        F.count(F.lit(1)).alias("order_count"), F.min("order_date").alias("first_order"),
        F.max("order_date").alias("last_order"),
        F.sum(F.coalesce("total_amount", F.lit(0.0))).alias("total_revenue"))
    p = (products.where(F.coalesce(F.col("is_active"), F.lit(True))).groupBy("business_id")
         .agg(F.count(F.lit(1)).alias("product_count")))
    return (o.join(p, "business_id", "full_outer")
            .select("business_id", F.coalesce("order_count", F.lit(0)).alias("order_count"),
                    F.coalesce("product_count", F.lit(0)).alias("product_count"), "first_order", "last_order",
                    F.coalesce("total_revenue", F.lit(0.0)).alias("total_revenue")))
