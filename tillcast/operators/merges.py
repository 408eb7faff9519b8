"""Table merges without a transactional format: upserts as full outer joins,
insert-if-absent as anti joins, de-duplication as keyed aggregates.

J-14..J-19, A-28, M-11, M-12, T-01..T-03.

Each merge is one join on the natural key, so Spark shuffles both sides once
on that key (or broadcasts the small side when AQE measures it small). The
result is written as a new table version (``write_table``) - never in place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PRED_KEY = ("model_id", "prediction_date", "item_name")
PRODUCT_KEY = ("integration_id", "external_id")
ORDER_KEY = ("integration_id", "external_id")


def merge_join(left: DataFrame, right: DataFrame, key: Sequence[str]) -> DataFrame:
    """Full outer join on ``key`` in which NULL equals NULL, so that a key with a
    NULL part (an item without a name) is one key on both sides. One shuffle of
    each side, as for a plain join."""
    r = right.select(*[F.col(c).alias(f"_r_{c}") if c in key else F.col(c) for c in right.columns])
    on = F.lit(True)
    for c in key:
        on = on & left[c].eqNullSafe(r[f"_r_{c}"])
    joined = left.withColumn("_l", F.lit(True)).join(r, on, "full_outer")
    return joined.withColumns({c: F.when(F.col("_l"), F.col(c)).otherwise(F.col(f"_r_{c}")) for c in key}).drop(
        "_l", *[f"_r_{c}" for c in key])


def upsert_predictions(existing: DataFrame, new: DataFrame, seq_col: str | None = None) -> DataFrame:
    """J-14: key (model, date, item): a new row overwrites the predicted
    quantity and keeps the stored actual; new keys are inserted. Of several new
    rows for one key the last by ``seq_col`` wins (without one, the largest)."""
    n = new.groupBy(*PRED_KEY).agg(
        F.max_by("predicted_quantity", seq_col or "predicted_quantity").alias("_new_pred"))
    j = merge_join(existing, n, PRED_KEY)
    return j.select(*PRED_KEY,
                    F.coalesce("_new_pred", "predicted_quantity").alias("predicted_quantity"),
                    "actual_quantity")


def actual_sales(sales: DataFrame) -> DataFrame:
    """Daily actual quantity per (business, date, item), truncated to int."""
    return (sales.where(F.col("item_name").isNotNull() & F.col("date").isNotNull())
            .groupBy("business_id", "date", "item_name")
            .agg(F.sum("quantity").cast("int").alias("actual")))


def auto_compare(predictions: DataFrame, models: DataFrame, actuals: DataFrame) -> DataFrame:
    """J-15: set ``actual_quantity`` from uploaded actuals on predictions of the
    business's models (any model) dated inside the upload's date range.

    ``actuals``: (business_id, date, item_name, actual). Returns the whole
    predictions table plus a boolean ``matched``.
    """
    rng = actuals.groupBy("business_id").agg(F.min("date").alias("_lo"), F.max("date").alias("_hi"))
    p = predictions.join(models.select("model_id", "business_id"), "model_id", "left")
    p = p.join(rng, "business_id", "left")
    in_range = F.col("prediction_date").between(F.col("_lo"), F.col("_hi"))
    a = actuals.select("business_id", F.col("date").alias("prediction_date"), "item_name", "actual")
    j = p.join(a, ["business_id", "prediction_date", "item_name"], "left")
    matched = in_range & F.col("actual").isNotNull()
    return j.select(*PRED_KEY, "predicted_quantity",
                    F.when(matched, F.col("actual")).otherwise(F.col("actual_quantity")).alias("actual_quantity"),
                    "business_id", F.coalesce(matched, F.lit(False)).alias("matched"))


def matched_counts(compared: DataFrame) -> DataFrame:
    """J-15 counter: updated predictions per business."""
    return (compared.where("matched").groupBy("business_id")
            .agg(F.count(F.lit(1)).alias("actuals_matched")))


def active_model(models: DataFrame) -> DataFrame:
    """The active model per business (newest created_at, then highest id, if
    several are flagged)."""
    act = models.where("is_active")
    return act.groupBy("business_id").agg(
        F.max_by("model_id", F.struct("created_at", "model_id")).alias("model_id"))


def save_actuals(predictions: DataFrame, models: DataFrame, entries: DataFrame, seq_col: str = "entry_seq") -> DataFrame:
    """J-16: entries (business_id, date, item_name, actual_quantity) go to the
    business's active model: matched rows get the actual, unmatched entries are
    inserted with predicted 0. Of several entries for one key the last by
    ``seq_col`` wins.
    Returns the merged table with ``change`` in {'updated', 'created', None}."""
    act = active_model(models)
    e = (entries.join(act, "business_id")
         .groupBy("model_id", F.col("date").alias("prediction_date"), "item_name")
         .agg(F.max_by("actual_quantity", seq_col).alias("_actual")))
    j = merge_join(predictions, e, PRED_KEY)
    change = (F.when(F.col("_actual").isNull(), F.lit(None))
              .when(F.col("predicted_quantity").isNull(), F.lit("created")).otherwise(F.lit("updated")))
    return j.select(*PRED_KEY,
                    F.coalesce("predicted_quantity", F.lit(0)).alias("predicted_quantity"),
                    F.coalesce(F.col("_actual"), F.col("actual_quantity")).alias("actual_quantity"),
                    change.alias("change"))


def change_counts(merged: DataFrame, models: DataFrame) -> DataFrame:
    """J-16 / J-18 counters: updated and created rows per business."""
    m = merged.join(models.select("model_id", "business_id"), "model_id")
    return m.groupBy("business_id").agg(
        F.count(F.when(F.col("change") == "updated", 1)).alias("updated"),
        F.count(F.when(F.col("change") == "created", 1)).alias("created"))


def upsert_products(existing: DataFrame, incoming: DataFrame, now_col: str = "synced_at",
                    seq_col: str | None = None) -> DataFrame:
    """J-18: key (integration, external_id): update name/category/sku/price and
    ``updated_at`` of known products, insert new ones; ``is_new`` marks inserts.
    The provider's values replace the stored ones, cleared (NULL) fields too. Of
    several incoming rows for one key the last by ``seq_col`` wins (without one,
    the last by ``now_col`` and values)."""
    cols = ("business_id", "name", "category", "sku", "price")
    last = [seq_col] if seq_col else [now_col, *cols]
    inc = (incoming.groupBy(*PRODUCT_KEY)
           .agg(F.max_by(F.struct(*cols, F.col(now_col).alias("at")), F.struct(*last)).alias("_n"), F.lit(True).alias("_seen")))
    j = merge_join(existing.withColumn("_known", F.lit(True)), inc, PRODUCT_KEY)
    known, seen = F.col("_known").isNotNull(), F.col("_seen").isNotNull()
    return j.select(*PRODUCT_KEY,
                    F.coalesce("business_id", "_n.business_id").alias("business_id"),
                    *[F.when(seen, F.col(f"_n.{c}")).otherwise(F.col(c)).alias(c) for c in cols if c != "business_id"],
                    F.coalesce("is_active", F.lit(True)).alias("is_active"),
                    F.coalesce("_n.at", "updated_at").alias("updated_at"),
                    (seen & ~known).alias("is_new"))


def insert_new_orders(existing: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """J-19: orders whose (integration, external_id) is not stored yet.
    Returns (inserted rows, new table = existing + inserted)."""
    unseen = incoming.join(existing.select(*ORDER_KEY), list(ORDER_KEY), "left_anti")
    inserted = first_per_key(unseen, ORDER_KEY)  # only what is new is reduced, payloads and all
    return inserted, existing.unionByName(inserted.select(*existing.columns))


def first_per_key(df: DataFrame, key: Sequence[str], order: str | None = None) -> DataFrame:
    """One row per key, deterministic: the smallest (order, all columns) row."""
    others = [c for c in df.columns if c not in key]
    if not others:
        return df.select(*key).distinct()
    ordered = [order] + [c for c in others if c != order] if order else others
    packed = F.min(F.struct(*[F.col(c) for c in ordered])).alias("_row")
    return df.groupBy(*key).agg(packed).select(*key, *[F.col(f"_row.{c}").alias(c) for c in others])


def keep_latest(df: DataFrame, key: Sequence[str], id_col: str = "id") -> DataFrame:
    """A-28: one row per natural key, the one with the highest id.

    NULL key values are equal to each other, as in a GROUP BY; a NULL id is
    lower than any other. The highest id per key is a hash aggregate of fixed
    width (a key duplicated a million times collapses map-side); whole rows are
    joined back for the winners only, and only they are compared when an id
    repeats within a key.
    """
    others = [c for c in df.columns if c not in key and c != id_col]
    top = df.groupBy(*[F.col(c).alias(f"_t_{c}") for c in key]).agg(F.max(id_col).alias("_t_id"))
    on = F.col(id_col).eqNullSafe(F.col("_t_id"))
    for c in key:
        on = on & F.col(c).eqNullSafe(F.col(f"_t_{c}"))
    won = df.join(top, on, "left_semi")
    if not others:
        return won.select(*key, id_col).distinct()
    packed = F.max(F.struct(*[F.col(c) for c in others])).alias("_row")
    return won.groupBy(*key, id_col).agg(packed).select(*key, id_col, *[F.col(f"_row.{c}").alias(c) for c in others])


def activate_model(models: DataFrame, model_id: int | DataFrame | None = None) -> DataFrame:
    """M-11: make one model the only active one of its business. ``model_id``
    is one id, or a frame of model ids (one per business); without it, the
    newest model of each business is activated."""
    if isinstance(model_id, DataFrame):
        target = model_id.join(models.select("model_id", "business_id"), "model_id").select(
            "business_id", F.col("model_id").alias("_target"))
    elif model_id is not None:
        target = models.where(F.col("model_id") == model_id).select("business_id", F.col("model_id").alias("_target"))
    else:
        target = models.groupBy("business_id").agg(
            F.max_by("model_id", F.struct("created_at", "model_id")).alias("_target"))
    j = models.join(target, "business_id", "left")
    active = F.when(F.col("_target").isNull(), F.col("is_active")).otherwise(F.col("model_id") == F.col("_target"))
    return j.select(*[c for c in models.columns if c != "is_active"], active.alias("is_active"))


def delete_model(models: DataFrame, predictions: DataFrame, model_id: int | DataFrame,
                 uploads: DataFrame | None = None) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """M-12: drop models (one id, or a frame with a ``model_id`` column) and
    their predictions; NULL out upload references."""
    spark = models.sparkSession
    gone = (model_id.select("model_id").distinct() if isinstance(model_id, DataFrame)
            else spark.createDataFrame([(model_id,)], "model_id long"))
    up = None
    if uploads is not None:
        up = (uploads.join(gone.withColumn("_gone", F.lit(True)), "model_id", "left")
              .withColumn("model_id", F.when(F.col("_gone").isNull(), F.col("model_id"))).select(*uploads.columns))
    return (models.join(gone, "model_id", "left_anti").select(*models.columns),
            predictions.join(gone, "model_id", "left_anti").select(*predictions.columns), up)


def models_newest_first(models: DataFrame) -> DataFrame:
    """T-01: models by created_at descending, id as tie-break (Q26)."""
    return models.orderBy(F.col("created_at").desc(), F.col("model_id").desc())


def newest(df: DataFrame, ts_col: str, limit: int = 10, max_limit: int = 100,
           tie_break: str | None = None) -> DataFrame:
    """T-02: newest first, limited to ``limit`` (1 to ``max_limit``, else an
    error) - a top-k report (planned as TakeOrderedAndProject: per-task top-k, no sort)."""
    n = int(limit)
    if not 1 <= n <= max_limit:
        raise ValueError(f"limit {n} is not between 1 and {max_limit}")
    order = [F.col(ts_col).desc()] + ([F.col(tie_break).desc()] if tie_break else [])
    return df.orderBy(*order).limit(n)


def upcoming_active_forecasts(predictions: DataFrame, models: DataFrame, from_date) -> DataFrame:
    """T-03: predictions of each business's active model from ``from_date`` on,
    by date. ``from_date`` is a date string or a Column that may use the active
    model's ``created_at``."""
    act = active_model(models).join(models.select("model_id", "created_at"), "model_id")
    start = F.to_date(F.lit(from_date)) if isinstance(from_date, str) else from_date
    return (predictions.join(act, "model_id").where(F.col("prediction_date") >= start)
            .drop("created_at").orderBy("business_id", "prediction_date", "item_name"))


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> None:
    """S-28: persist a table version as Parquet (partitioned, e.g. by model_id)."""
    w = df.write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.parquet(path)

