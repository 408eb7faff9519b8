"""Registered queries: provider payload flattening, order -> sales, product and
order merges, sync summary.

S-11..S-21, S-25, S-27, J-18, J-19, A-21.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import bucketed as BK
from ..operators import merges as M
from ..sources import calendars as C
from ..sources import documents as D
from ..sources import providers as P
from ..session import scratch_path
from ..sources import derived as V
from ..sources import tables as T
from ..util import round_doubles
from . import query

_ORD = """WITH
ob AS (SELECT o.o_orderkey, o.o_orderstatus, o.o_totalprice, o.o_orderdate, CAST(n.n_regionkey AS BIGINT) AS business_id
       FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey JOIN nation n ON c.c_nationkey = n.n_nationkey),
ln AS (SELECT l.l_orderkey, l.l_quantity, l.l_extendedprice, l.l_returnflag, p.p_name, p.p_retailprice
       FROM lineitem l JOIN part p ON l.l_partkey = p.p_partkey),
cnt AS (SELECT l_orderkey, COUNT(*) AS n, SUM(l_extendedprice) AS ext FROM ln GROUP BY l_orderkey),
pt AS (SELECT p_partkey, p_name, p_brand, p_type, p_retailprice,
              CAST(CAST(substring(p_brand, 7, 1) AS INTEGER) - 1 AS BIGINT) AS business_id FROM part)
"""

_C = "CAST(round({x} * 100) AS BIGINT) / 100"


def _lines_out(orders):
    """Orders table -> one row per line item (orders without lines keep one row)."""
    o = orders.select("business_id", "external_id", F.col("order_date").cast("timestamp_ntz").alias("order_date"),
                      "total_amount", "item_count", F.explode_outer("line_items").alias("li"))
    return round_doubles(o.select("business_id", "external_id", "order_date", "total_amount", "item_count",
                                  F.col("li.name").alias("name"), F.col("li.quantity").alias("quantity"),
                                  F.col("li.unit_price").alias("unit_price"), F.col("li.total").alias("total")))


def _order_sql(where: str, total_amount: str, quantity: str, unit_price: str, total: str, name: str = "ln.p_name"):
    return _ORD + f"""
SELECT ob.business_id, CAST(ob.o_orderkey AS VARCHAR) AS external_id, ob.o_orderdate AS order_date,
  ROUND({total_amount}, 6) AS total_amount, CAST(COALESCE(cnt.n, 0) AS INTEGER) AS item_count,
  {name} AS name, ROUND({quantity}, 6) AS quantity, ROUND({unit_price}, 6) AS unit_price, ROUND({total}, 6) AS total
FROM ob LEFT JOIN ln ON ln.l_orderkey = ob.o_orderkey LEFT JOIN cnt ON cnt.l_orderkey = ob.o_orderkey
{where}"""


@query("S11_flatten_square_orders", _order_sql(
    "WHERE ob.o_orderstatus = 'F'", _C.format(x="ob.o_totalprice"), "CAST(CAST(ln.l_quantity AS INTEGER) AS DOUBLE)",
    _C.format(x="ln.p_retailprice"), _C.format(x="ln.l_extendedprice")))
def square_orders(spark, sf_dir):
    return _lines_out(P.flatten_square_orders(D.square_orders(spark, sf_dir)))


@query("S12_flatten_shopify_orders", _order_sql(
    "", "ob.o_totalprice", "CAST(CAST(ln.l_quantity AS BIGINT) AS DOUBLE)", "ln.p_retailprice",
    "ln.p_retailprice * CAST(CAST(ln.l_quantity AS BIGINT) AS DOUBLE)"))
def shopify_orders(spark, sf_dir):
    return _lines_out(P.flatten_shopify_orders(D.shopify_orders(spark, sf_dir)))


@query("S13_flatten_toast_orders", _order_sql(
    "", "COALESCE(cnt.ext, 0.0)", "ln.l_quantity", "ln.p_retailprice", "ln.p_retailprice * ln.l_quantity"))
def toast_orders(spark, sf_dir):
    return _lines_out(P.flatten_toast_orders(D.toast_orders(spark, sf_dir)))


@query("S14_flatten_clover_orders", _order_sql(
    "", _C.format(x="ob.o_totalprice"), "CASE WHEN ln.p_name IS NULL THEN NULL ELSE CAST(1.0 AS DOUBLE) END",
    _C.format(x="ln.p_retailprice"), _C.format(x="ln.p_retailprice")))
def clover_orders(spark, sf_dir):
    return _lines_out(P.flatten_clover_orders(D.clover_orders(spark, sf_dir)))


def _product_sql(ext: str, price: str, where: str = "") -> str:
    return _ORD + f"""
SELECT business_id, {ext} AS external_id, p_name AS name, p_type AS category, p_brand AS sku,
       ROUND({price}, 6) AS price FROM pt {where}"""


@query("S15_flatten_square_products", _product_sql("'P' || CAST(p_partkey AS VARCHAR)",
                                                   _C.format(x="p_retailprice"), "WHERE p_type NOT LIKE 'PROMO%'"))
def square_products(spark, sf_dir):
    return round_doubles(P.flatten_square_products(D.square_products(spark, sf_dir)))


@query("S16_flatten_shopify_products", _product_sql("CAST(p_partkey AS VARCHAR)", "p_retailprice"))
def shopify_products(spark, sf_dir):
    return round_doubles(P.flatten_shopify_products(D.shopify_products(spark, sf_dir)))


@query("S17_flatten_toast_products", _product_sql("'P' || CAST(p_partkey AS VARCHAR)", "p_retailprice"))
def toast_products(spark, sf_dir):
    return round_doubles(P.flatten_toast_products(D.toast_menus(spark, sf_dir)))


@query("S18_flatten_clover_products", _product_sql("'P' || CAST(p_partkey AS VARCHAR)",
                                                   _C.format(x="p_retailprice")))
def clover_products(spark, sf_dir):
    return round_doubles(P.flatten_clover_products(D.clover_items(spark, sf_dir)))


_DER = T.with_ctes(V.DERIVED_SQL)


@query("S19_weather_to_rows", _DER + "SELECT date, temp_max, temp_min, precipitation, weather_code FROM d_weather")
def weather_to_rows(spark, sf_dir):
    return P.weather_to_rows(D.weather_docs(V.daily_weather(spark, sf_dir))).drop("month")


@query("S20_normalize_holidays", _DER + "SELECT date, name, type FROM d_holidays")
def normalize_holidays(spark, sf_dir):
    return P.normalize_holidays(D.holiday_docs(V.monthly_holidays(spark, sf_dir))).select("date", "name", "type")


@query("S21_normalize_games", _DER + """
SELECT date, name, 'Home' AS home_team, CASE WHEN month(date) = 1 THEN '' ELSE 'Away' END AS away_team, venue
FROM d_games""")
def normalize_games(spark, sf_dir):
    return P.normalize_games(D.games_docs(V.daily_games(spark, sf_dir))).drop("year")


@query("S25_orders_to_sales", _ORD + f"""
SELECT ob.business_id, CAST(ob.o_orderdate AS DATE) AS date, COALESCE(ln.p_name, 'All Items') AS item_name,
  ROUND(CASE WHEN ln.p_name IS NULL THEN 1.0 ELSE CAST(CAST(ln.l_quantity AS INTEGER) AS DOUBLE) END, 6) AS quantity,
  ROUND(CASE WHEN ln.p_name IS NULL THEN NULL ELSE {_C.format(x="ln.p_retailprice")} END, 6) AS unit_price,
  ROUND(CASE WHEN ln.p_name IS NULL THEN {_C.format(x="ob.o_totalprice")}
             ELSE {_C.format(x="ln.l_extendedprice")} END, 6) AS total_price,
  CAST(ob.o_orderkey AS VARCHAR) AS order_id
FROM ob LEFT JOIN ln ON ln.l_orderkey = ob.o_orderkey WHERE ob.o_orderstatus = 'F'""")
def orders_to_sales(spark, sf_dir):
    return round_doubles(P.orders_to_sales(P.flatten_square_orders(D.square_orders(spark, sf_dir))))


@query("S27_F22_products_lookup", _product_sql("'P' || CAST(p_partkey AS VARCHAR)", _C.format(x="p_retailprice"),
                                           "WHERE p_type NOT LIKE 'PROMO%'"))
def products_lookup(spark, sf_dir):
    prods = P.flatten_square_products(D.square_products(spark, sf_dir)).withColumn("is_active", F.lit(True))
    return round_doubles(P.products_lookup(prods))


def _stored_products(spark, sf_dir):
    return (P.flatten_square_products(D.square_products(spark, sf_dir))
            .withColumn("integration_id", F.lit(1).cast("long")).withColumn("is_active", F.lit(True))
            .withColumn("updated_at", F.lit(None).cast("timestamp")))


@query("J18_upsert_products", _ORD + f"""
SELECT CAST(1 AS BIGINT) AS integration_id, 'P' || CAST(p_partkey AS VARCHAR) AS external_id, business_id,
  p_name AS name, p_type AS category, p_brand AS sku, ROUND({_C.format(x="p_retailprice")}, 6) AS price,
  TRUE AS is_active, p_type LIKE 'PROMO%' AS is_new
FROM pt""")
def upsert_products(spark, sf_dir):
    incoming = (P.flatten_clover_products(D.clover_items(spark, sf_dir))
                .withColumn("integration_id", F.lit(1).cast("long"))
                .withColumn("synced_at", F.lit(None).cast("timestamp")))
    out = M.upsert_products(_stored_products(spark, sf_dir), incoming)
    return round_doubles(out.drop("updated_at"))


_NEW_ORDERS = _ORD + f"""
SELECT CAST(1 AS BIGINT) AS integration_id, CAST(ob.o_orderkey AS VARCHAR) AS external_id, ob.business_id,
  ob.o_orderdate AS order_date, ROUND({_C.format(x="ob.o_totalprice")}, 6) AS total_amount,
  CAST(COALESCE(cnt.n, 0) AS INTEGER) AS item_count
FROM ob LEFT JOIN cnt ON cnt.l_orderkey = ob.o_orderkey WHERE ob.o_orderstatus <> 'F'"""


def _stored_and_incoming(spark, sf_dir):
    one = F.lit(1).cast("long").alias("integration_id")
    return (P.flatten_square_orders(D.square_orders(spark, sf_dir)).select("*", one),
            P.flatten_clover_orders(D.clover_orders(spark, sf_dir)).select("*", one))


def _order_columns(inserted):
    return round_doubles(inserted.select("integration_id", "external_id", "business_id",
                                         F.col("order_date").cast("timestamp_ntz").alias("order_date"),
                                         "total_amount", "item_count"))


@query("J19_insert_new_orders", _NEW_ORDERS)
def insert_new_orders(spark, sf_dir):
    inserted, _ = M.insert_new_orders(*_stored_and_incoming(spark, sf_dir))
    return _order_columns(inserted)


@query("J19_insert_into_stored_table", _NEW_ORDERS)
def insert_into_stored_table(spark, sf_dir):
    """The same into a stored table: filters of its keys tell most new orders without a look at the stored ones."""
    stored, incoming = _stored_and_incoming(spark, sf_dir)
    table = BK.Table.create(stored, scratch_path(spark, "orders-table"), M.ORDER_KEY, buckets=16, filtered=True)
    return _order_columns(table.insert_absent(incoming, lambda df: M.first_per_key(df, M.ORDER_KEY)))


@query("A21_sync_summary", _ORD + f""",
o AS (SELECT business_id, COUNT(*) AS order_count, MIN(o_orderdate) AS first_order, MAX(o_orderdate) AS last_order,
             SUM({_C.format(x="o_totalprice")}) AS total_revenue FROM ob WHERE o_orderstatus = 'F' GROUP BY ALL),
p AS (SELECT business_id, COUNT(*) AS product_count FROM pt WHERE p_type NOT LIKE 'PROMO%' GROUP BY ALL)
SELECT COALESCE(o.business_id, p.business_id) AS business_id, COALESCE(order_count, 0) AS order_count,
  COALESCE(product_count, 0) AS product_count, first_order, last_order,
  ROUND(COALESCE(total_revenue, 0.0), 6) AS total_revenue
FROM o FULL OUTER JOIN p ON o.business_id = p.business_id""")
def sync_summary(spark, sf_dir):
    orders = P.flatten_square_orders(D.square_orders(spark, sf_dir))
    out = P.sync_summary(orders, _stored_products(spark, sf_dir))
    return round_doubles(out.select("business_id", "order_count", "product_count",
                                    F.col("first_order").cast("timestamp_ntz").alias("first_order"),
                                    F.col("last_order").cast("timestamp_ntz").alias("last_order"),
                                    "total_revenue"))
