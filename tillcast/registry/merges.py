"""Registered queries: prediction/model table merges and listings.

J-14..J-17, A-28, M-11, M-12, T-01..T-03.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.scalars import round_prediction
from ..operators import bucketed as BK
from ..operators import merges as M
from ..operators import reports as R
from ..operators import series as S
from ..plans import forecast as FC
from ..session import cut_lineage, scratch_path
from ..sources import tables as T
from . import query

_P = T.with_ctes(*T.PRED_CTES)


def _new_forecasts(spark, sf_dir, daily):
    """A second forecast to merge: every key of the history twice, first with
    the rolling-30 and then with the rolling-7 naive forecast (the later one
    must win), plus the 8-day grid ahead (item average)."""
    lags = S.lag_features(daily)
    hist = [lags.select(T.model_id_of().alias("model_id"), F.col("date").alias("prediction_date"), "item_name",
                        round_prediction(c).alias("predicted_quantity"), F.lit(seq).alias("seq"))
            for seq, c in enumerate(("rolling_30_avg", "rolling_7_avg"))]
    ahead = FC.naive_forecast(daily, 7).select(
        T.model_id_of("business_id", "prediction_date").alias("model_id"), "prediction_date", "item_name",
        "predicted_quantity", F.lit(0).alias("seq"))
    return hist[0].unionByName(hist[1]).unionByName(ahead)


_NEW_SQL = """,
mx AS (SELECT business_id, MAX(date) AS last_date FROM daily GROUP BY business_id),
avgd AS (SELECT business_id, item_name, AVG(quantity) AS a FROM daily GROUP BY ALL),
new AS (
  SELECT l.business_id * 10000 + year(l.date) AS model_id, l.date AS prediction_date, l.item_name,
         GREATEST(CAST(round_even(l.rolling_7_avg, 0) AS INTEGER), 0) AS predicted_quantity
  FROM lags l
  UNION ALL
  SELECT g.business_id * 10000 + year(g.d), g.d, g.item_name, GREATEST(CAST(round_even(a.a, 0) AS INTEGER), 0)
  FROM (SELECT i.business_id, i.item_name,
               CAST(unnest(generate_series(mx.last_date + 1, mx.last_date + 8, INTERVAL 1 DAY)) AS DATE) AS d
        FROM (SELECT DISTINCT business_id, item_name FROM daily) i JOIN mx USING (business_id)) g
  JOIN avgd a USING (business_id, item_name)
)"""


_UPSERT_SQL = _P.rstrip() + _NEW_SQL + """
SELECT COALESCE(p.model_id, n.model_id) AS model_id, COALESCE(p.prediction_date, n.prediction_date) AS prediction_date,
       COALESCE(p.item_name, n.item_name) AS item_name,
       COALESCE(n.predicted_quantity, p.predicted_quantity) AS predicted_quantity, p.actual_quantity
FROM predictions p FULL OUTER JOIN new n
  ON p.model_id = n.model_id AND p.prediction_date = n.prediction_date AND p.item_name = n.item_name"""


@query("J14_upsert_predictions", _UPSERT_SQL)
def upsert_predictions(spark, sf_dir):
    daily = T.daily_series(spark, sf_dir)
    return M.upsert_predictions(T.predictions(spark, sf_dir, daily), _new_forecasts(spark, sf_dir, daily), "seq")


@query("J14_merge_into_stored_table", _UPSERT_SQL)
def merge_into_stored_table(spark, sf_dir):
    """The same as two merges into a stored table of buckets: first the rolling-30 forecasts, then all others."""
    daily = T.daily_series(spark, sf_dir)
    table = BK.Table.create(T.predictions(spark, sf_dir, daily), scratch_path(spark, "predictions-table"), M.PRED_KEY, buckets=16)
    new = cut_lineage(_new_forecasts(spark, sf_dir, daily), "new-forecasts")
    for part in ("seq = 0", "seq = 1"):
        table.merge(new.where(part), lambda stored, rows: M.upsert_predictions(stored, rows, "seq"))
    return table.read()


def _compare(spark, sf_dir):
    """Predictions without actuals, compared with all sales."""
    daily = T.daily_series(spark, sf_dir)
    sales = T.sales(spark, sf_dir)
    preds = T.predictions(spark, sf_dir, daily).withColumn("actual_quantity", F.lit(None).cast("int"))
    return M.auto_compare(preds, T.models(spark, sf_dir, daily), M.actual_sales(sales))


_CMP_SQL = """,
act AS (SELECT s.business_id, s.date, s.item_name, CAST(trunc(SUM(s.quantity)) AS INTEGER) AS actual
        FROM sales s WHERE s.item_name IS NOT NULL GROUP BY ALL),
rng AS (SELECT business_id, MIN(date) AS lo, MAX(date) AS hi FROM act GROUP BY business_id),
cmp AS (
  SELECT p.model_id, p.prediction_date, p.item_name, p.predicted_quantity, m.business_id,
         (p.prediction_date BETWEEN r.lo AND r.hi AND a.actual IS NOT NULL) AS hit, a.actual
  FROM predictions p LEFT JOIN models m USING (model_id) LEFT JOIN rng r ON m.business_id = r.business_id
  LEFT JOIN act a ON a.business_id = m.business_id AND a.date = p.prediction_date AND a.item_name = p.item_name
)"""


@query("J15_auto_compare", _P.rstrip() + _CMP_SQL + """
SELECT model_id, prediction_date, item_name, predicted_quantity,
       CASE WHEN hit THEN actual END AS actual_quantity, business_id, COALESCE(hit, FALSE) AS matched
FROM cmp""")
def auto_compare(spark, sf_dir):
    return _compare(spark, sf_dir)


@query("J15_matched_count", _P.rstrip() + _CMP_SQL + """
SELECT business_id, COUNT(*) AS actuals_matched FROM cmp WHERE hit GROUP BY business_id""")
def matched_count(spark, sf_dir):
    return M.matched_counts(_compare(spark, sf_dir))


def _save(spark, sf_dir):
    """Stored: the active models' predictions without actuals; entered: all
    daily sales, each twice (first 5 too many, then corrected: the last entry
    counts). Entries of years before the active model's create rows."""
    daily = T.daily_series(spark, sf_dir)
    models = T.models(spark, sf_dir, daily)
    stored = (T.predictions(spark, sf_dir, daily).join(M.active_model(models), "model_id", "left_semi")
              .withColumn("actual_quantity", F.lit(None).cast("int")))
    once = daily.select("business_id", "date", "item_name", F.col("quantity").cast("int").alias("actual_quantity"))
    entries = once.withColumn("entry_seq", F.lit(1)).unionByName(
        once.withColumn("actual_quantity", F.col("actual_quantity") + 5).withColumn("entry_seq", F.lit(0)))
    return M.save_actuals(stored, models, entries), models


_SAVE_SQL = """,
act AS (SELECT business_id, arg_max(model_id, (created_at, model_id)) AS model_id FROM models
        WHERE is_active GROUP BY business_id),
stored AS (
  SELECT p.model_id, p.prediction_date, p.item_name, p.predicted_quantity, CAST(NULL AS INTEGER) AS actual_quantity
  FROM predictions p JOIN act USING (model_id)
),
entries AS (
  SELECT act.model_id, d.date AS prediction_date, d.item_name, MAX(CAST(trunc(d.quantity) AS INTEGER)) AS a
  FROM daily d JOIN act USING (business_id) GROUP BY ALL
),
merged AS (
  SELECT COALESCE(s.model_id, e.model_id) AS model_id, COALESCE(s.prediction_date, e.prediction_date) AS prediction_date,
         COALESCE(s.item_name, e.item_name) AS item_name, COALESCE(s.predicted_quantity, 0) AS predicted_quantity,
         COALESCE(e.a, s.actual_quantity) AS actual_quantity,
         CASE WHEN e.a IS NULL THEN NULL WHEN s.predicted_quantity IS NULL THEN 'created' ELSE 'updated' END AS change
  FROM stored s FULL OUTER JOIN entries e
    ON s.model_id = e.model_id AND s.prediction_date = e.prediction_date AND s.item_name = e.item_name
)"""


@query("J16_save_actuals", _P.rstrip() + _SAVE_SQL + "\nSELECT * FROM merged")
def save_actuals(spark, sf_dir):
    return _save(spark, sf_dir)[0]


@query("J16_change_counts", _P.rstrip() + _SAVE_SQL + """
SELECT m.business_id, COUNT(*) FILTER (WHERE change = 'updated') AS updated,
       COUNT(*) FILTER (WHERE change = 'created') AS created
FROM merged g JOIN models m USING (model_id) GROUP BY m.business_id""")
def change_counts(spark, sf_dir):
    merged, models = _save(spark, sf_dir)
    return M.change_counts(merged, models)


@query("J17_predictions_models", _P + """
SELECT p.model_id, p.prediction_date, p.item_name, p.predicted_quantity, p.actual_quantity, m.business_id
FROM predictions p JOIN models m ON p.model_id = m.model_id WHERE p.actual_quantity IS NOT NULL""")
def predictions_models(spark, sf_dir):
    daily = T.daily_series(spark, sf_dir)
    return R.scored(T.predictions(spark, sf_dir, daily), T.models(spark, sf_dir, daily))


@query("A28_keep_latest", """
SELECT l_orderkey, l_linenumber AS id, l_partkey, l_quantity, l_shipdate FROM (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey
    ORDER BY l_linenumber DESC, l_partkey DESC, l_quantity DESC, l_shipdate DESC) AS rn FROM lineitem)
WHERE rn = 1""")
def keep_latest(spark, sf_dir):
    li = T.read_table(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.col("l_linenumber").alias("id"), "l_partkey", "l_quantity", "l_shipdate")
    return M.keep_latest(li, ["l_orderkey"], "id")


@query("A28_keep_latest_null_keys", """
SELECT k, priority, id, o_totalprice FROM (
  SELECT CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 1000 END AS k,
         CASE WHEN o_orderstatus <> 'P' THEN o_orderpriority END AS priority, o_orderkey AS id, o_totalprice FROM orders)
QUALIFY row_number() OVER (PARTITION BY k, priority ORDER BY id DESC) = 1""")
def keep_latest_null_keys(spark, sf_dir):
    """A third of all rows have a NULL key part; NULLs are one key."""
    o = T.read_table(spark, sf_dir, "orders").select(
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey") % 1000).alias("k"),
        F.when(F.col("o_orderstatus") != "P", F.col("o_orderpriority")).alias("priority"), F.col("o_orderkey").alias("id"), "o_totalprice")
    return M.keep_latest(o, ["k", "priority"], "id")


@query("J14_upsert_null_items", _P.rstrip() + _NEW_SQL.replace("l.item_name,", "NULLIF(l.item_name, 'Brand#1') AS item_name,").replace(
    "SELECT g.business_id * 10000 + year(g.d), g.d, g.item_name,", "SELECT g.business_id * 10000 + year(g.d), g.d, NULLIF(g.item_name, 'Brand#1'),") + """,
old AS (SELECT model_id, prediction_date, NULLIF(item_name, 'Brand#1') AS item_name, predicted_quantity, actual_quantity FROM predictions)
SELECT COALESCE(p.model_id, n.model_id) AS model_id, COALESCE(p.prediction_date, n.prediction_date) AS prediction_date,
       COALESCE(p.item_name, n.item_name) AS item_name,
       COALESCE(n.predicted_quantity, p.predicted_quantity) AS predicted_quantity, p.actual_quantity
FROM old p FULL OUTER JOIN new n
  ON p.model_id = n.model_id AND p.prediction_date = n.prediction_date AND p.item_name IS NOT DISTINCT FROM n.item_name""")
def upsert_null_items(spark, sf_dir):
    """As J14, with one item that has no name: its rows are one key a day on both sides."""
    daily = T.daily_series(spark, sf_dir)
    nameless = F.when(F.col("item_name") != "Brand#1", F.col("item_name"))
    return M.upsert_predictions(T.predictions(spark, sf_dir, daily).withColumn("item_name", nameless),
                                _new_forecasts(spark, sf_dir, daily).withColumn("item_name", nameless), "seq")


@query("M11_activate_model", _P + """,
tgt AS (SELECT business_id, arg_min(model_id, (created_at, model_id)) AS t FROM models GROUP BY business_id)
SELECT m.model_id, m.business_id, m.created_at, m.training_rows, m.model_id = tgt.t AS is_active
FROM models m JOIN tgt USING (business_id)""")
def activate_model(spark, sf_dir):
    daily = T.daily_series(spark, sf_dir)
    models = T.models(spark, sf_dir, daily)
    return M.activate_model(models, _oldest(models))


@query("M12_delete_model", _P + """,
old AS (SELECT business_id, arg_min(model_id, (created_at, model_id)) AS t FROM models GROUP BY business_id)
SELECT p.* FROM predictions p WHERE p.model_id NOT IN (SELECT t FROM old)""")
def delete_model(spark, sf_dir):
    daily = T.daily_series(spark, sf_dir)
    models = T.models(spark, sf_dir, daily)
    preds = T.predictions(spark, sf_dir, daily)
    return M.delete_model(models, preds, _oldest(models))[1]


def _oldest(models):
    return models.groupBy("business_id").agg(
        F.min_by("model_id", F.struct("created_at", "model_id")).alias("model_id")).select("model_id")


@query("M12_models_left", _P + """,
old AS (SELECT business_id, arg_min(model_id, (created_at, model_id)) AS t FROM models GROUP BY business_id)
SELECT m.model_id, m.business_id, m.training_rows, m.is_active FROM models m WHERE m.model_id NOT IN (SELECT t FROM old)""")
def models_left(spark, sf_dir):
    daily = T.daily_series(spark, sf_dir)
    models = T.models(spark, sf_dir, daily)
    return M.delete_model(models, T.predictions(spark, sf_dir, daily), _oldest(models))[0].drop("created_at")


@query("M12_upload_references", _P + """,
old AS (SELECT business_id, arg_min(model_id, (created_at, model_id)) AS t FROM models GROUP BY business_id)
SELECT d.business_id, d.date AS upload_date,
       CASE WHEN d.business_id * 10000 + year(d.date) NOT IN (SELECT t FROM old)
            THEN d.business_id * 10000 + year(d.date) END AS model_id
FROM (SELECT DISTINCT business_id, date FROM daily) d""")
def upload_references(spark, sf_dir):
    """One upload per business and day, referring to the model of its year."""
    daily = T.daily_series(spark, sf_dir)
    models = T.models(spark, sf_dir, daily)
    uploads = daily.select("business_id", F.col("date").alias("upload_date")).distinct().withColumn(
        "model_id", T.model_id_of("business_id", "upload_date"))
    return M.delete_model(models, T.predictions(spark, sf_dir, daily), _oldest(models), uploads)[2]


@query("T01_models_newest_first", _P + """
SELECT model_id, business_id, created_at, training_rows, is_active FROM models
ORDER BY created_at DESC, model_id DESC""")
def models_newest_first(spark, sf_dir):
    daily = T.daily_series(spark, sf_dir)
    return M.models_newest_first(T.models(spark, sf_dir, daily))


@query("T02_newest_orders", """
SELECT o_orderkey, o_orderdate, o_totalprice FROM orders ORDER BY o_orderdate DESC, o_orderkey DESC LIMIT 10""")
def newest_orders(spark, sf_dir):
    o = T.read_table(spark, sf_dir, "orders").select("o_orderkey", "o_orderdate", "o_totalprice")
    return M.newest(o, "o_orderdate", 10, tie_break="o_orderkey")


@query("T03_upcoming_active_forecasts", _P + """,
act AS (SELECT business_id, arg_max(model_id, (created_at, model_id)) AS model_id FROM models
        WHERE is_active GROUP BY business_id)
SELECT p.model_id, p.prediction_date, p.item_name, p.predicted_quantity, p.actual_quantity, act.business_id
FROM predictions p JOIN act USING (model_id) JOIN models m USING (model_id)
WHERE p.prediction_date >= CAST(m.created_at AS DATE) - INTERVAL 14 DAY""")
def upcoming_active_forecasts(spark, sf_dir):
    daily = T.daily_series(spark, sf_dir)
    return M.upcoming_active_forecasts(T.predictions(spark, sf_dir, daily), T.models(spark, sf_dir, daily),
                                       F.date_sub(F.col("created_at").cast("date"), 14))
