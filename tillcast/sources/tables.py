"""Views over the driver tables that give the operators their canonical inputs.

Each view is defined twice, once as a lazy DataFrame and once as a SQL CTE
(the oracle text run by DuckDB), so that the two engines see identical inputs.

* ``sales``: lineitem x part x supplier/nation. One row per line item in the
  canonical SALES shape; ``business_id`` is the supplier nation's region, so
  one job serves several businesses at once.
* ``timed_sales``: the ``events`` table as sales with a time of day.
* ``predictions``: a naive lag-7 forecast next to the actual daily quantity,
  the table the accuracy and merge operators work on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
          "events", "documents", "embeddings", "pages", "benchmark", "labels",
          "conversations")


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def supplier_business(spark: SparkSession, sf_dir: str) -> DataFrame:
    """supplier -> business_id (region of the supplier's nation).

    ``nation`` has 25 rows by definition of the schema, so broadcasting it is
    a fixed-size broadcast; supplier itself is left to the planner (AQE turns
    the join into a broadcast only if its runtime size is under the threshold).
    """
    supplier = read_table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    nation = read_table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return (supplier.join(F.broadcast(nation), supplier.s_nationkey == nation.n_nationkey)
            .select("s_suppkey", F.col("n_regionkey").cast("long").alias("business_id")))


def sales(spark: SparkSession, sf_dir: str, spread_parts: bool = False) -> DataFrame:
    """The sales view. ``spread_parts`` shuffles part to the line items: part grows with the
    data and packs well, so a file that the planner takes for small is a table of some 100
    bytes a row once broadcast, and a plan that reads the sales often holds several."""
    li = read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_shipdate")
    part = read_table(spark, sf_dir, "part").select(
        "p_partkey", "p_brand", "p_type", "p_size", "p_retailprice")
    biz = supplier_business(spark, sf_dir)
    part = part.hint("shuffle_hash") if spread_parts else part
    joined = (li.join(part, li.l_partkey == part.p_partkey)
              .join(biz, li.l_suppkey == biz.s_suppkey))
    return joined.select(
        "business_id",
        F.col("l_shipdate").cast("date").alias("date"),
        F.col("p_brand").alias("item_name"),
        F.col("l_quantity").alias("quantity"),
        F.col("p_size").cast("string").alias("size"),
        F.col("p_type").alias("type"),
        F.col("p_retailprice").alias("unit_price"),
        F.col("l_extendedprice").alias("total_price"),
        F.col("l_orderkey").cast("string").alias("order_id"),
    )


SALES_SQL = """
sales AS (
  SELECT CAST(n.n_regionkey AS BIGINT) AS business_id,
         CAST(l.l_shipdate AS DATE) AS date,
         p.p_brand AS item_name,
         l.l_quantity AS quantity,
         CAST(p.p_size AS VARCHAR) AS size,
         p.p_type AS type,
         p.p_retailprice AS unit_price,
         l.l_extendedprice AS total_price,
         CAST(l.l_orderkey AS VARCHAR) AS order_id
  FROM lineitem l
  JOIN part p ON l.l_partkey = p.p_partkey
  JOIN supplier s ON l.l_suppkey = s.s_suppkey
  JOIN nation n ON s.s_nationkey = n.n_nationkey
)"""


def timed_sales(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = read_table(spark, sf_dir, "events").select("event_id", "ts", "event_type", "value")
    return ev.select(
        F.lit(0).cast("long").alias("business_id"),
        F.col("ts").cast("date").alias("date"),
        F.col("event_type").alias("item_name"),
        F.col("value").alias("quantity"),
        F.date_format("ts", "HH:mm").alias("time"),
        F.col("event_id").cast("string").alias("order_id"),
    )


TIMED_SALES_SQL = """
timed_sales AS (
  SELECT CAST(0 AS BIGINT) AS business_id,
         CAST(ts AS DATE) AS date,
         event_type AS item_name,
         value AS quantity,
         strftime(ts, '%H:%M') AS time,
         CAST(event_id AS VARCHAR) AS order_id
  FROM events
)"""


def daily_sales_sql(source: str = "sales") -> str:
    return f"""
daily AS (
  SELECT business_id, date, item_name, SUM(quantity) AS quantity
  FROM {source}
  WHERE item_name IS NOT NULL AND date IS NOT NULL
  GROUP BY business_id, date, item_name
)"""


def with_ctes(*ctes: str) -> str:
    return "WITH " + ",".join(ctes) + "\n"


# ---------------------------------------------------------------- predictions

LAGS_SQL = """
m AS (SELECT business_id, AVG(quantity) AS mean_q FROM daily GROUP BY business_id),
w AS (
  SELECT d.*,
    LAG(quantity, 1) OVER win AS l1,
    LAG(quantity, 7) OVER win AS l7,
    AVG(quantity) OVER (win ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS r7,
    AVG(quantity) OVER (win ROWS BETWEEN 30 PRECEDING AND 1 PRECEDING) AS r30,
    STDDEV_SAMP(quantity) OVER (win ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING) AS s7
  FROM daily d
  WINDOW win AS (PARTITION BY business_id, item_name ORDER BY date)
),
lags AS (
  SELECT w.business_id, w.date, w.item_name, w.quantity,
    COALESCE(l1, r7, mean_q, 0) AS lag_1, COALESCE(l7, r7, mean_q, 0) AS lag_7,
    COALESCE(r7, mean_q, 0) AS rolling_7_avg, COALESCE(r30, r7, mean_q, 0) AS rolling_30_avg,
    COALESCE(s7, r7, mean_q, 0) AS rolling_7_std
  FROM w LEFT JOIN m ON w.business_id = m.business_id
)"""

PREDICTIONS_SQL = """
predictions AS (
  SELECT business_id * 10000 + year(date) AS model_id, date AS prediction_date, item_name,
         GREATEST(CAST(round_even(lag_7, 0) AS INTEGER), 0) AS predicted_quantity,
         CAST(trunc(quantity) AS INTEGER) AS actual_quantity
  FROM lags
),
models AS (
  SELECT business_id * 10000 + year(date) AS model_id, business_id,
         CAST(MAX(date) AS TIMESTAMP) AS created_at, COUNT(*) AS training_rows,
         year(date) = MAX(year(date)) OVER (PARTITION BY business_id) AS is_active
  FROM daily GROUP BY business_id, year(date)
)"""

PRED_CTES = (SALES_SQL, daily_sales_sql(), LAGS_SQL, PREDICTIONS_SQL)


def model_id_of(business: str = "business_id", date: str = "date"):
    """Model of a (business, date): one model per business and year."""
    return (F.col(business) * 10000 + F.year(date)).cast("long")


def daily_series(spark: SparkSession, sf_dir: str, materialize: bool = True) -> DataFrame:
    """A-01 over the sales view. With ``materialize`` the compact series is
    written once to the shared checkpoint folder, so queries that branch off
    it (lags + means, forecasts, models, calendars) read it instead of
    re-scanning and re-aggregating the line items in every branch."""
    from ..operators.series import daily_item_sales
    from ..session import cut_lineage

    daily = daily_item_sales(sales(spark, sf_dir))
    return cut_lineage(daily) if materialize else daily


def predictions(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """PREDICTIONS table stand-in: a naive lag-7 forecast (W-02, rounded and
    floored as F-18) next to the actual daily quantity. Each prediction belongs
    to the model of its business and year."""
    from ..functions.scalars import round_prediction
    from ..operators.series import lag_features

    daily = daily if daily is not None else daily_series(spark, sf_dir)
    lags = lag_features(daily)
    return lags.select(
        model_id_of().alias("model_id"), F.col("date").alias("prediction_date"), "item_name",
        round_prediction("lag_7").alias("predicted_quantity"),
        F.col("quantity").cast("int").alias("actual_quantity"))


def models(spark: SparkSession, sf_dir: str, daily: DataFrame | None = None) -> DataFrame:
    """MODELS registry stand-in: one model per (business, year) of data, created
    at the year's last sales date; the newest model of a business is active."""
    from pyspark.sql import Window

    daily = (daily if daily is not None else daily_series(spark, sf_dir)).withColumn("year", F.year("date"))
    per_year = daily.groupBy("business_id", "year").agg(
        F.max("date").cast("timestamp_ntz").alias("created_at"), F.count(F.lit(1)).alias("training_rows"))
    w = Window.partitionBy("business_id")  # one row per model of the business
    return per_year.select(
        (F.col("business_id") * 10000 + F.col("year")).cast("long").alias("model_id"), "business_id",
        "created_at", "training_rows", (F.col("year") == F.max("year").over(w)).alias("is_active"))
