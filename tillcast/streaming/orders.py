"""Structured Streaming jobs for the incremental order / sales feed.

X-01..X-05. The reference pulls new provider orders once a day and inserts
unseen ones; here that is a file-source stream (explicit schema, no
inference) run with ``trigger(availableNow=True)`` from an external
scheduler: each run processes what has arrived since the last checkpoint and
stops. Checkpoints and sinks live in the shared folder, so a run survives
executor or driver loss and restarts from its checkpoint.
"""

from __future__ import annotations

import datetime as dt
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from ..operators import merges as M
from ..session import cut_lineage

LOG_SCHEMA = ("run string, batch_id long, status string, rows long, late_rows long, error string, "
              "started_at timestamp, finished_at timestamp")

# Seven days of de-duplication state for every key of a feed do not fit a heap.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def order_feed(spark: SparkSession, source_dir: str, schema, fmt: str = "parquet",
               max_files_per_trigger: int | None = None) -> DataFrame:
    """X-01: a streaming DataFrame over a landing directory."""
    r = spark.readStream.schema(schema).format(fmt)
    if max_files_per_trigger:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return r.load(source_dir)


def _event_time(stream: DataFrame, ts_col: str) -> tuple[DataFrame, str]:
    """Watermarks need an instant: a wall-clock TIMESTAMP_NTZ is read in the
    session time zone (UTC) into a helper column."""
    if dict(stream.dtypes)[ts_col] == "timestamp":
        return stream, ts_col
    return stream.withColumn("_event_time", F.col(ts_col).cast("timestamp")), "_event_time"


def dedup_stream(stream: DataFrame, keys, ts_col: str, delay: str = "7 days") -> DataFrame:
    """X-02: insert-if-absent as streaming de-duplication on the natural key;
    state for a key is kept until the watermark passes its event time + delay."""
    s, et = _event_time(stream, ts_col)
    out = s.withWatermark(et, delay).dropDuplicatesWithinWatermark(list(keys))
    return out.drop("_event_time") if et != ts_col else out


def daily_item_stream(stream: DataFrame, ts_col: str, item_col: str, value_col: str,
                      delay: str = "1 day") -> DataFrame:
    """X-03: tumbling one-day windows per item, emitted (append mode) once the
    watermark passes the window end; rows later than the watermark are dropped
    and counted in the query progress (``numRowsDroppedByWatermark``)."""
    s, et = _event_time(stream, ts_col)
    agg = (s.withWatermark(et, delay)
           .groupBy(F.window(et, "1 day").alias("w"), F.col(item_col).alias("item_name"))
           .agg(F.sum(value_col).alias("quantity"), F.count(F.lit(1)).alias("rows")))
    return agg.select(F.to_date("w.start").alias("date"), "item_name", "quantity", "rows")


class _Dropped(StreamingQueryListener):
    """Rows dropped by the watermark over a whole run, whatever its length
    (a query's own progress list keeps its newest reports only)."""

    def __init__(self) -> None:
        self.rows: dict[str, int] = {}
        self.ended: dict[str, threading.Event] = {}

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        run = str(event.progress.runId)
        self.rows[run] = self.rows.get(run, 0) + sum(op.numRowsDroppedByWatermark for op in event.progress.stateOperators)

    def onQueryTerminated(self, event) -> None:
        self.ended.setdefault(str(event.runId), threading.Event()).set()


def run_available_now(stream: DataFrame, sink_path: str, checkpoint: str, mode: str = "append",
                      fmt: str = "parquet") -> StreamingQuery:
    """Process everything available, then stop (exactly-once file sink). The
    returned query has ``late_rows``: rows the watermark dropped in this run."""
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    dropped = _Dropped()
    spark.streams.addListener(dropped)
    try:
        q = (stream.writeStream.format(fmt).outputMode(mode).option("checkpointLocation", checkpoint)
             .trigger(availableNow=True).start(sink_path))
        run = str(q.runId)
        q.awaitTermination()
        ended = dropped.ended.setdefault(run, threading.Event()).wait(60)  # events arrive after the query has ended
    finally:
        spark.streams.removeListener(dropped)
    if not ended:
        raise RuntimeError("the query has ended, but its progress reports did not come: late rows are not known")
    q.late_rows = dropped.rows.get(run, 0)
    return q


def late_rows(q: StreamingQuery) -> int:
    """Rows dropped by the watermark over the run."""
    return q.late_rows


def _listed(spark: SparkSession, path: str, prefix: str = "") -> list[str]:
    """Names of the folders under ``path`` that begin with ``prefix``; none if it is not there. No data is read."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    files = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = [s.getPath().getName() for s in files.listStatus(hadoop)] if files.exists(hadoop) else []
    return sorted(n for n in names if n.startswith(prefix))


def _numbers(spark: SparkSession, path: str, prefix: str) -> list[int]:
    return sorted(int(n[len(prefix):]) for n in _listed(spark, path, prefix))


_PREDICTIONS = "model_id long, prediction_date date, item_name string, predicted_quantity int, actual_quantity int"


def _newest(spark: SparkSession, table_path: str, months: list[int]) -> dict[int, int]:
    found = {m: _numbers(spark, f"{table_path}/month={m}", "version=") for m in months}
    return {m: v[-1] for m, v in found.items() if v}


def current_predictions(spark: SparkSession, table_path: str, months: list[int] | None = None) -> DataFrame:
    """The predictions table (of some months): each month's newest version. Versions are found by folder names, and
    only the folders that are asked for are opened."""
    newest = _newest(spark, table_path, _numbers(spark, table_path, "month=") if months is None else months)
    at = [f"{table_path}/month={m}/version={v}" for m, v in sorted(newest.items())]
    return spark.read.schema(_PREDICTIONS).parquet(*at) if at else spark.createDataFrame([], _PREDICTIONS)


def write_version(df: DataFrame, table_path: str, version: int) -> None:
    """Write a version of the months in ``df``; other months keep theirs.
    Writing the same version again replaces it. A month's rows are dealt to as
    many tasks as their size asks for."""
    (df.withColumn("month", _month("prediction_date")).withColumn("version", F.lit(int(version)).cast("long"))
     .hint("rebalance", "month").write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy("month", "version").parquet(table_path))


def _month(date_col: str):
    return (F.year(date_col) * 100 + F.month(date_col)).cast("int")


_LEDGER = "business_id long, date date, item_name string, quantity double, rows long, month int, run string, batch long"


def _entries(spark: SparkSession, path: str, month: int, run: str, batch_id: int) -> list[str]:
    """The folders with each run's newest entry of a month before this batch: it holds all of that run's sums so far."""
    out = []
    for r in _listed(spark, f"{path}/month={month}", "run="):
        older = [b for b in _numbers(spark, f"{path}/month={month}/{r}", "batch=") if r != f"run={run}" or b < batch_id]
        out += [f"{path}/month={month}/{r}/batch={older[-1]}"] if older else []
    return out


def _ledger(spark: SparkSession, path: str, months: list[int], run: str, batch_id: int) -> DataFrame:
    """Totals by (business, date, item, run) of the given months before this batch. Folders of other months are neither
    listed nor read."""
    at = [e for m in months for e in _entries(spark, path, m, run, batch_id)]
    return spark.read.schema(_LEDGER).option("basePath", path).parquet(*at) if at else spark.createDataFrame([], _LEDGER)


def _newest_date(spark: SparkSession, path: str, run: str, batch_id: int, unless: Callable[[dt.date], bool]) -> dt.date | None:
    """The newest date in the ledger before this batch: months are found by folder names, and the newest is read
    ``unless`` that holds for its last day, the newest date there can be."""
    for month in reversed(_numbers(spark, path, "month=")):
        if _entries(spark, path, month, run, batch_id):
            if unless(dt.date(month // 100 + month % 100 // 12, month % 100 % 12 + 1, 1) - dt.timedelta(days=1)):
                return None
            return _ledger(spark, path, [month], run, batch_id).agg(F.max("date")).first()[0]
    return None


def auto_compare_stream(stream: DataFrame, models: DataFrame, predictions_path: str, ledger_path: str, log_path: str,
                        checkpoint: str, late_after_days: int = 7) -> StreamingQuery:
    """X-04 + X-05: micro-batches of sales rows against stored predictions (J-15).

    The ledger holds the sums per (business, date, item), in a folder per month,
    run (checkpoint) and batch. A batch reads the newest entries of the months it
    touches, adds its own sums and writes what they are now as its own entry, so
    a replayed batch replaces its part, the result does not depend on how files
    fall into batches nor on the checkpoint they were read under, and what a
    batch reads does not grow with the history: the entries and predictions of
    other months are not opened. The touched months get a new version in the
    predictions table.

    One log row per batch: status, rows, rows dated more than
    ``late_after_days`` before the newest date known before the batch, error
    text and times.
    """
    run = checkpoint.rstrip("/").rsplit("/", 1)[-1]
    keys = ["business_id", "date", "item_name"]

    def merge(batch: DataFrame, batch_id: int) -> tuple[int, int]:
        spark = batch.sparkSession
        part = cut_lineage(batch.where(F.col("item_name").isNotNull() & F.col("date").isNotNull())
                           .groupBy(*keys).agg(F.sum("quantity").alias("quantity"), F.count("*").alias("rows")), "batch-sums")
        days = {r.date: r.n for r in part.groupBy("date").agg(F.sum("rows").alias("n")).collect()}  # a row a day of the batch
        is_late = lambda day, newest: day < newest - dt.timedelta(days=late_after_days)
        newest = _newest_date(spark, ledger_path, run, batch_id, lambda last: not any(is_late(day, last) for day in days))
        late = sum(n for day, n in days.items() if newest is not None and is_late(day, newest))
        months = sorted({day.year * 100 + day.month for day in days})
        before = _ledger(spark, ledger_path, months, run, batch_id)
        mine = cut_lineage(part.unionByName(before.where(F.col("run") == run).select(*part.columns)).groupBy(*keys).agg(
            F.sum("quantity").alias("quantity"), F.sum("rows").alias("rows")), "totals")
        (mine.withColumns({"month": _month("date"), "run": F.lit(run), "batch": F.lit(int(batch_id)).cast("long")})
         .hint("rebalance", "month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("month", "run", "batch").parquet(ledger_path))
        actuals = M.actual_sales(mine.select(*keys, "quantity").unionByName(
            before.where(F.col("run") != run).select(*keys, "quantity")))
        touched = current_predictions(spark, predictions_path, months)
        merged = M.auto_compare(touched, models, actuals).select(*M.PRED_KEY, "predicted_quantity", "actual_quantity")
        write_version(merged, predictions_path, max(_newest(spark, predictions_path, months).values(), default=-1) + 1)
        return int(batch.count()), int(late)

    def per_batch(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        started = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        status, err, rows, late = "completed", None, 0, 0
        batch.persist()
        try:
            if not batch.isEmpty():
                rows, late = merge(batch, batch_id)
        except Exception as exc:  # recorded, then re-raised so the batch is retried
            status, err = "failed", str(exc)
            raise
        finally:
            batch.unpersist()
            finished = dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
            log = spark.createDataFrame([(run, int(batch_id), status, rows, late, err, started, finished)], LOG_SCHEMA)
            log.write.mode("append").parquet(log_path)

    q = (stream.writeStream.foreachBatch(per_batch).option("checkpointLocation", checkpoint)
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return q
