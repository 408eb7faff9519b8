"""Registered queries: streaming feed, de-duplication, windowed daily sales,
streaming auto-compare and its sync log (X-01..X-05).

Each query lands data derived from the driver tables in a fresh folder under
the shared checkpoint folder, runs the stream with availableNow (process what
is there, then stop) and returns the sink read back as a batch DataFrame.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import merges as M
from ..session import scratch_path
from ..sources import tables as T
from ..streaming import orders as X
from . import query


@query("X01_X02_stream_dedup", """
SELECT event_id, ts, user_id, event_type, value, props FROM events""")
def stream_dedup(spark, sf_dir):
    """Every event lands twice, the second time in later micro-batches; the
    stream keeps one row per event id."""
    ev = T.read_table(spark, sf_dir, "events")
    landing = scratch_path(spark, "landing-events")
    ev.write.parquet(landing)
    files = len(spark.read.parquet(landing).inputFiles())
    ev.write.mode("append").parquet(landing)
    stream = X.order_feed(spark, landing, ev.schema, max_files_per_trigger=files)
    sink = scratch_path(spark, "sink-dedup")
    X.run_available_now(X.dedup_stream(stream, ["event_id"], "ts", "3650 days"), sink,
                        scratch_path(spark, "ckpt-dedup"))
    return spark.read.schema(ev.schema).parquet(sink)


@query("X03_stream_daily_item_sales", """
SELECT date, item_name, quantity, rows FROM (
  SELECT CAST(ts AS DATE) AS date, event_type AS item_name, ROUND(SUM(value), 6) AS quantity, COUNT(*) AS rows
  FROM events GROUP BY CAST(ts AS DATE), event_type)
WHERE CAST(date + INTERVAL 1 DAY AS TIMESTAMP) <= (SELECT MAX(ts) FROM events) - INTERVAL 1 DAY""")
def stream_daily_item_sales(spark, sf_dir):
    """One-day tumbling windows with a one-day watermark: the windows still
    open when the input ends are not emitted (the SQL applies the same cut)."""
    from ..util import round_doubles

    ev = T.read_table(spark, sf_dir, "events")
    landing = scratch_path(spark, "landing-daily")
    ev.write.parquet(landing)
    stream = X.order_feed(spark, landing, ev.schema)
    agg = X.daily_item_stream(stream, "ts", "event_type", "value", "1 day")
    sink = scratch_path(spark, "sink-daily")
    X.run_available_now(agg, sink, scratch_path(spark, "ckpt-daily"))
    return round_doubles(spark.read.parquet(sink))


def _auto_compare_run(spark, sf_dir):
    """All sales land in at least three micro-batches that each hold a part of
    every (date, item)."""
    daily = T.daily_series(spark, sf_dir)
    sales = T.sales(spark, sf_dir)
    preds0 = T.predictions(spark, sf_dir, daily).withColumn("actual_quantity", F.lit(None).cast("int"))
    table = scratch_path(spark, "predictions")
    X.write_version(preds0, table, 0)
    landing = scratch_path(spark, "landing-sales")
    parts = max(3, int(spark.conf.get("spark.sql.shuffle.partitions")) // 3 * 3)
    sales.repartition(parts, "order_id").write.parquet(landing)
    files = len(spark.read.parquet(landing).inputFiles())
    stream = X.order_feed(spark, landing, sales.schema, max_files_per_trigger=-(-files // 3))
    log = scratch_path(spark, "sync-log")
    X.auto_compare_stream(stream, T.models(spark, sf_dir, daily), table, scratch_path(spark, "sales-ledger"), log,
                          scratch_path(spark, "ckpt-compare"))
    return table, log


_CMP = T.with_ctes(*T.PRED_CTES).rstrip() + """,
act AS (SELECT s.business_id, s.date, s.item_name, CAST(trunc(SUM(s.quantity)) AS INTEGER) AS actual
        FROM sales s WHERE s.item_name IS NOT NULL GROUP BY ALL)
SELECT p.model_id, p.prediction_date, p.item_name, p.predicted_quantity, a.actual AS actual_quantity
FROM predictions p LEFT JOIN models m USING (model_id)
LEFT JOIN act a ON a.business_id = m.business_id AND a.date = p.prediction_date AND a.item_name = p.item_name"""


@query("X04_stream_auto_compare", _CMP)
def stream_auto_compare(spark, sf_dir):
    table, _ = _auto_compare_run(spark, sf_dir)
    return X.current_predictions(spark, table).select(*M.PRED_KEY, "predicted_quantity", "actual_quantity")


@query("X05_sync_log", T.with_ctes(T.SALES_SQL) + """
SELECT TRUE AS three_batches_or_more, 'completed' AS status, COUNT(*) AS rows, CAST(0 AS BIGINT) AS errors FROM sales""")
def sync_log(spark, sf_dir):
    """The log of the auto-compare stream, summed over its micro-batches (their times and sizes vary)."""
    _, log = _auto_compare_run(spark, sf_dir)
    return spark.read.parquet(log).groupBy("status").agg(
        (F.count("*") >= 3).alias("three_batches_or_more"), F.sum("rows").alias("rows"),
        F.count("error").alias("errors"))
