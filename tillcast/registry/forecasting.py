"""Registered queries: splits, folds, item encoding, training, search,
importance, persistence and forecasting.

W-11, W-12, M-02..M-10, M-13, T-04, F-17, F-18. Model outputs (scores,
importances) depend on the boosting library, so those queries have no SQL
oracle (rows-only check); splits, folds, encodings and metrics formulas do.

Queries train with the library defaults (100 trees, depth 6, 3 folds) and
search 5 candidates of the whole grid. What is exact about the model outputs is
held against SQL: rows of every fold, candidate and business (``M05_M06_search_rows``,
``M04_row_counts``, ``M13_per_business_rows``), metrics recomputed from the scored
rows (``M07_metrics_recomputed``), importances that sum to one, the forecast grid,
and that a loaded model is the trained one.
"""

from __future__ import annotations

from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.scalars import display_name
from ..operators import reports as R
from ..operators import series as S
from ..plans import training as TR
from ..plans import features as FE
from ..session import cut_lineage, scratch_path
from ..sources import tables as T
from ..util import round_doubles
from . import calendars as CAL
from . import query
from .series import LAG_CTES

_DAILY = T.with_ctes(T.SALES_SQL, T.daily_sales_sql())
_MODELS: dict = {}
_FRAMES: dict = {}


def _frame(spark, sf_dir):
    """Training frame of one application and scale; it reads the daily series
    materialised in the shared folder, so later queries reuse that table."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FRAMES:
        _FRAMES[key] = TR.training_frame(T.sales(spark, sf_dir))
    return _FRAMES[key]


def _trained(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _MODELS:
        _MODELS[key] = TR.train(_frame(spark, sf_dir), tune=False, sales=T.sales(spark, sf_dir, spread_parts=True))
    return _MODELS[key]


@query("M03_item_encoding", _DAILY + """
SELECT item_name, CAST(DENSE_RANK() OVER (ORDER BY item_name) - 1 AS DOUBLE) AS item_index
FROM (SELECT DISTINCT item_name FROM daily)""")
def item_encoding(spark, sf_dir):
    daily = S.daily_item_sales(T.sales(spark, sf_dir))
    items = daily.select("item_name").distinct()
    return TR.item_indexer(daily).fit(daily).transform(items)


_EPOCH = "date_diff('day', DATE '1970-01-01', date)"


@query("W11_chronological_split", _DAILY + f""",
sp AS (SELECT business_id, CAST(DATE '1970-01-01' + CAST(floor(quantile_cont({_EPOCH}, 0.8)) AS INTEGER) AS DATE)
       AS split_date FROM daily GROUP BY business_id)
SELECT d.business_id, sp.split_date, COUNT(*) FILTER (WHERE d.date < sp.split_date) AS train_rows,
       COUNT(*) FILTER (WHERE d.date >= sp.split_date) AS test_rows
FROM daily d JOIN sp USING (business_id) GROUP BY d.business_id, sp.split_date""")
def chronological_split(spark, sf_dir):
    daily = S.daily_item_sales(T.sales(spark, sf_dir))
    sp = TR.split_dates(daily, 0.2)
    return (daily.join(sp, "business_id").groupBy("business_id", "split_date")
            .agg(F.count_if(F.col("date") < F.col("split_date")).alias("train_rows"),
                 F.count_if(F.col("date") >= F.col("split_date")).alias("test_rows")))


@query("W12_expanding_folds", _DAILY + f""",
q AS (SELECT business_id, quantile_cont({_EPOCH}, [0.25, 0.5, 0.75, 1.0]) AS qs FROM daily GROUP BY business_id),
b AS (
  SELECT business_id, k AS fold,
    CAST(DATE '1970-01-01' + CAST(floor(qs[k]) AS INTEGER) AS DATE) AS valid_start,
    CAST(DATE '1970-01-01' + CAST(floor(qs[k + 1]) AS INTEGER) + CASE WHEN k = 3 THEN 1 ELSE 0 END AS DATE)
      AS valid_end
  FROM q, range(1, 4) t(k)
)
SELECT b.business_id, CAST(b.fold AS INTEGER) AS fold, b.valid_start, b.valid_end,
  COUNT(*) FILTER (WHERE d.date < b.valid_start) AS train_rows,
  COUNT(*) FILTER (WHERE d.date >= b.valid_start AND d.date < b.valid_end) AS valid_rows
FROM b JOIN daily d USING (business_id) GROUP BY ALL""")
def expanding_folds(spark, sf_dir):
    daily = S.daily_item_sales(T.sales(spark, sf_dir))
    bounds = TR.fold_bounds(daily, 3)
    return (daily.join(bounds, "business_id")
            .groupBy("business_id", "fold", "valid_start", "valid_end")
            .agg(F.count_if(F.col("date") < F.col("valid_start")).alias("train_rows"),
                 F.count_if((F.col("date") >= F.col("valid_start")) & (F.col("date") < F.col("valid_end")))
                 .alias("valid_rows")))


@query("F17_safe_mape", T.with_ctes(*T.PRED_CTES) + """
SELECT m.business_id, ROUND(AVG(abs(p.actual_quantity - p.predicted_quantity)), 6) AS mae,
  ROUND(COALESCE(AVG(CASE WHEN p.actual_quantity <> 0
        THEN abs((p.actual_quantity - p.predicted_quantity) / p.actual_quantity) * 100 END), 0), 6) AS mape,
  COUNT(*) AS rows
FROM predictions p JOIN models m USING (model_id) GROUP BY m.business_id""")
def safe_mape(spark, sf_dir):
    daily = T.daily_series(spark, sf_dir)
    from ..util import round_doubles
    p = R.scored(T.predictions(spark, sf_dir, daily), T.models(spark, sf_dir, daily))
    return round_doubles(TR.metrics(p, "actual_quantity", "predicted_quantity", by=["business_id"]))


@query("F18_round_prediction", T.with_ctes(*T.PRED_CTES) + """
SELECT model_id, prediction_date, item_name, predicted_quantity FROM predictions""")
def round_prediction(spark, sf_dir):
    daily = T.daily_series(spark, sf_dir)
    return T.predictions(spark, sf_dir, daily).drop("actual_quantity")


@query("M02_feature_vector", CAL.FEATURES_SQL + """,
""" + LAG_CTES + """
SELECT f.business_id, f.date, f.item_name, l.quantity, unnest(generate_series(0, %d)) AS place,
  unnest([%s]) AS value
FROM feat f JOIN lagged l ON l.business_id = f.business_id AND l.date = f.date AND l.item_name = f.item_name""" % (
    len(FE.FEATURE_COLUMNS), ", ".join(f"ROUND(CAST({c} AS DOUBLE), 6) + 0.0" for c in (
        *(f"f.{c}" if not c.startswith(("lag_", "rolling_")) else f"l.{c}" for c in FE.FEATURE_COLUMNS), "f.business_id"))))
def feature_vector(spark, sf_dir):
    """Every value of every feature vector of the pooled training frame, with its place."""
    frame = _frame(spark, sf_dir)
    names = TR.model_features(frame)
    v = TR.assembler(names).transform(TR.prepare(frame, names))
    return round_doubles(v.select("business_id", "date", "item_name", "quantity", F.posexplode(vector_to_array("features")).alias("place", "value"))
                         .withColumn("place", F.col("place").cast("long")))


@query("M04_M07_train_evaluate")
def train_evaluate(spark, sf_dir):
    return _trained(spark, sf_dir).metrics


def _tuned(spark, sf_dir):
    """The full job once per application: search (5 candidates, 3 folds), evaluation, refit."""
    key = (spark.sparkContext.applicationId, sf_dir, "tuned")
    if key not in _MODELS:
        _MODELS[key] = TR.train(_frame(spark, sf_dir), tune=True, n_iter=5, sales=T.sales(spark, sf_dir, spread_parts=True))
    return _MODELS[key]


@query("M05_M06_random_search")
def random_search(spark, sf_dir):
    res = _tuned(spark, sf_dir).search
    rows = [(i, str(sorted(c.items())), float(score)) for i, (c, score) in enumerate(res.candidates)]
    return spark.createDataFrame(rows, "candidate int, params string, cv_mae double")


@query("M05_M06_search_rows", _DAILY + f""",
q AS (SELECT business_id, quantile_cont({_EPOCH}, [0.25, 0.5, 0.75, 1.0]) AS qs FROM daily GROUP BY business_id),
b AS (
  SELECT business_id, k AS fold, floor(qs[k]) AS lo, floor(qs[k + 1]) + CASE WHEN k = 3 THEN 1 ELSE 0 END AS hi FROM q, range(1, 4) t(k))
SELECT CAST(c AS INTEGER) AS candidate, CAST(b.fold AS INTEGER) AS fold, COUNT(*) FILTER (WHERE {_EPOCH} < b.lo) AS train_rows,
       COUNT(*) FILTER (WHERE {_EPOCH} >= b.lo AND {_EPOCH} < b.hi) AS valid_rows, TRUE AS scored
FROM b JOIN daily d USING (business_id), range(0, 5) t(c) GROUP BY ALL""")
def search_rows(spark, sf_dir):
    """Rows each candidate was trained on and scored on in each fold; whether it has a score."""
    s = _tuned(spark, sf_dir).runs.scores.where(F.col("job").startswith("fold_"))
    rows = lambda role: F.sum(F.when(F.col("role") == role, F.col("rows")))
    return s.groupBy("candidate", F.substring("job", 6, 9).cast("int").alias("fold")).agg(
        rows(TR.B.TRAIN).alias("train_rows"), rows(TR.B.HELD_OUT).alias("valid_rows"),
        F.bool_and(F.col("abs_error") >= 0).alias("scored"))


@query("M07_metrics_recomputed", "SELECT UNNEST(['test', 'train']) AS part, TRUE AS same_mae, TRUE AS same_mape, TRUE AS same_rows")
def metrics_recomputed(spark, sf_dir):
    """MAE, MAPE and rows of the run against the formulas (F-17) over rows scored by the saved trees."""
    res = _trained(spark, sf_dir)
    train, test = TR.chronological_split(TR.prepare(_frame(spark, sf_dir), res.names))
    scored = TR.metrics(res.evaluation.transform(train.withColumn("part", F.lit("train")).unionByName(test.withColumn("part", F.lit("test")))),
                        by=["part"])
    m = res.metrics.select(F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.col(f"{p}_mae").alias("a"), F.col(f"{p}_mape").alias("b"),
                                                        F.col(r).alias("c")) for p, r in (("train", "training_rows"), ("test", "test_rows"))])).alias("m")).select("m.*")
    close = lambda x, y: F.abs(F.col(x) - F.col(y)) <= 1e-9 * F.abs(F.col(y)) + 1e-9
    return scored.join(m, "part").select("part", close("mae", "a").alias("same_mae"), close("mape", "b").alias("same_mape"),
                                         (F.col("rows") == F.col("c")).alias("same_rows"))


@query("M08_feature_importance")
def feature_importance(spark, sf_dir):
    return _trained(spark, sf_dir).importance


@query("T04_top_features")
def top_features(spark, sf_dir):
    return TR.top_features(_trained(spark, sf_dir).importance, 10)


def _wanted(spark, sf_dir):
    """Every item, and beside each a new variant of it and an item like no other."""
    items = cut_lineage(S.daily_item_sales(T.sales(spark, sf_dir, spread_parts=True)).select("business_id", "item_name").distinct(), "items")
    return (items.unionByName(items.withColumn("item_name", F.concat("item_name", F.lit(" large"))))
            .unionByName(items.select("business_id", F.lit("?!").alias("item_name")).distinct()))


@query("M09_forecast")
def forecast(spark, sf_dir):
    return TR.forecast(_trained(spark, sf_dir).artefact, days=7, items=_wanted(spark, sf_dir))


@query("M09_forecast_grid", _DAILY + """,
it AS (SELECT DISTINCT business_id, item_name FROM daily),
al AS (SELECT * FROM it UNION SELECT business_id, item_name || ' large' FROM it UNION SELECT business_id, '?!' FROM it),
mx AS (SELECT business_id, MAX(date) AS m FROM daily GROUP BY business_id)
SELECT business_id, CAST(m + CAST(k AS INTEGER) AS DATE) AS prediction_date, item_name, TRUE AS sound
FROM al JOIN mx USING (business_id), range(1, 9) t(k)""")
def forecast_grid_check(spark, sf_dir):
    return forecast(spark, sf_dir).select(
        "business_id", "prediction_date", "item_name",
        (F.col("predicted_quantity").isNotNull() & (F.col("predicted_quantity") >= 0)).alias("sound"))


def _loaded(spark, sf_dir):
    art = _trained(spark, sf_dir).artefact
    path = scratch_path(spark, "model")
    TR.save_model(art, path)
    return TR.load_model(spark, path)


def _scored_test(spark, sf_dir, art):
    _, test = TR.chronological_split(TR.prepare(_frame(spark, sf_dir), art.names))
    return art.model.transform(test)


@query("M10_save_load_model")
def save_load(spark, sf_dir):
    return _scored_test(spark, sf_dir, _loaded(spark, sf_dir)).select(
        "business_id", "date", "item_name", "quantity", TR.round_prediction("prediction").alias("predicted_quantity"))


@query("M10_loaded_equals_trained", _DAILY + f""",
sp AS (SELECT business_id, CAST(DATE '1970-01-01' + CAST(floor(quantile_cont({_EPOCH}, 0.8)) AS INTEGER) AS DATE)
       AS split_date FROM daily GROUP BY business_id)
SELECT d.business_id, d.date, d.item_name, TRUE AS same
FROM daily d JOIN sp USING (business_id) WHERE d.date >= sp.split_date""")
def loaded_equals_trained(spark, sf_dir):
    """The saved model and its codes, loaded again, give the same predictions."""
    keys = ["business_id", "date", "item_name"]
    loaded = _loaded(spark, sf_dir)
    a = _scored_test(spark, sf_dir, _trained(spark, sf_dir).artefact).select(*keys, F.col("prediction").alias("a"))
    b = _scored_test(spark, sf_dir, loaded).select(*keys, "item_encoded", F.col("prediction").alias("b"))
    code = loaded.codes.withColumnRenamed("item_encoded", "code")
    return a.join(b, keys).join(code, ["business_id", "item_name"]).select(
        *keys, ((F.col("a") == F.col("b")) & (F.col("code") == F.col("item_encoded"))).alias("same"))


_COUNTS = _DAILY + f""",
sp AS (SELECT business_id, CAST(DATE '1970-01-01' + CAST(floor(quantile_cont({_EPOCH}, 0.8)) AS INTEGER) AS DATE)
       AS split_date FROM daily GROUP BY business_id)
SELECT COUNT(*) FILTER (WHERE d.date < sp.split_date) AS training_rows,
       COUNT(*) FILTER (WHERE d.date >= sp.split_date) AS test_rows, TRUE AS beats_last_week
FROM daily d JOIN sp USING (business_id)"""


def _counted(spark, sf_dir, summary):
    _, test = TR.chronological_split(_frame(spark, sf_dir))
    naive = test.agg(F.avg(F.abs(F.col("quantity") - F.col("lag_7"))).alias("naive"))
    return summary.join(naive, F.col("test_mae") <= F.col("naive"), "left").select(
        "training_rows", "test_rows", F.col("naive").isNotNull().alias("beats_last_week"))


@query("M04_row_counts", _COUNTS)
def row_counts(spark, sf_dir):
    """Rows of both parts, and a test error no larger than that of last week's quantity."""
    return _counted(spark, sf_dir, _trained(spark, sf_dir).metrics)


@query("M08_importance_sums", "SELECT TRUE AS sums_to_one, CAST(10 AS BIGINT) AS top")
def importance_sums(spark, sf_dir):
    res = _trained(spark, sf_dir)
    top = TR.top_features(res.importance, 10).agg(F.count("*").alias("top"))
    total = res.importance.agg((F.abs(F.sum("importance") - 1) < 0.01).alias("sums_to_one"))
    return total.join(top, F.col("top") > 0)


def _each(spark, sf_dir):
    key = (spark.sparkContext.applicationId, sf_dir, "each")
    if key not in _MODELS:
        frame = _frame(spark, sf_dir).drop("business_code")
        _MODELS[key] = TR.train_per_business(frame, tune=False, sales=T.sales(spark, sf_dir, spread_parts=True))
    return _MODELS[key]


@query("M13_per_business")
def per_business(spark, sf_dir):
    """One model per business, all in one run: errors on both parts and over the folds."""
    return _each(spark, sf_dir).metrics.drop("candidate")


@query("M13_per_business_rows", _DAILY + f""",
sp AS (SELECT business_id, floor(quantile_cont({_EPOCH}, 0.8)) AS split FROM daily GROUP BY business_id)
SELECT d.business_id, COUNT(*) FILTER (WHERE {_EPOCH} < split) AS training_rows, COUNT(*) FILTER (WHERE {_EPOCH} >= split) AS test_rows,
       COUNT(*) AS served_rows, TRUE AS beats_last_week
FROM daily d JOIN sp USING (business_id) GROUP BY d.business_id""")
def per_business_rows(spark, sf_dir):
    """Rows of each business's model, rows its serving model scores, and a test error no larger than that of last week's quantity."""
    res, frame = _each(spark, sf_dir), _frame(spark, sf_dir)
    _, test = TR.chronological_split(frame)
    naive = test.groupBy("business_id").agg(F.avg(F.abs(F.col("quantity") - F.col("lag_7"))).alias("naive"))
    served = res.model.transform(TR.prepare(frame, res.names)).groupBy("business_id").agg(F.count("prediction").alias("served_rows"))
    return res.metrics.join(naive, "business_id").join(served, "business_id").select(
        "business_id", "training_rows", "test_rows", "served_rows", (F.col("test_mae") <= F.col("naive")).alias("beats_last_week"))


@query("T04_top_features_order", "SELECT UNNEST(range(1, 11)) AS place, TRUE AS named, TRUE AS falling")
def top_features_order(spark, sf_dir):
    """The ten largest importances by a rank over all of them: names shown, percents in falling order."""
    res = _trained(spark, sf_dir)
    known = spark.createDataFrame([(n,) for n in res.names], "feature string").select(display_name("feature").alias("display_name"), "feature")
    rank = Window.orderBy(F.desc("importance"), "feature")  # one row a feature
    ranked = res.importance.withColumn("place", F.row_number().over(rank).cast("long")).withColumn(
        "above", F.lag("importance").over(rank))
    top = TR.top_features(res.importance, 10).join(known, ["feature", "display_name"])
    return top.join(ranked, "feature").select("place", (F.length("display_name") > 0).alias("named"),
                                              F.coalesce(F.col("above") >= F.col("importance"), F.lit(True)).alias("falling"))


@query("M13_training_job")
def training_job(spark, sf_dir):
    """Search (5 candidates, 3 folds) -> evaluate -> refit; one summary row."""
    return _tuned(spark, sf_dir).metrics


@query("M13_row_counts", _COUNTS)
def training_job_counts(spark, sf_dir):
    return _counted(spark, sf_dir, _tuned(spark, sf_dir).metrics)


@query("W07_W08_J24_forecast_lags", _DAILY + """,
mx AS (SELECT business_id, MAX(date) AS last_date FROM daily GROUP BY business_id),
hist AS (SELECT d.business_id, d.item_name, d.date, d.quantity FROM daily d JOIN mx USING (business_id)
         WHERE d.date >= mx.last_date - INTERVAL 60 DAY),
grid AS (SELECT i.business_id, i.item_name,
           CAST(unnest(generate_series(mx.last_date - 9, mx.last_date + 5, INTERVAL 1 DAY)) AS DATE) AS date
         FROM (SELECT DISTINCT business_id, item_name FROM daily) i JOIN mx USING (business_id)),
st AS (SELECT business_id, item_name, AVG(quantity) AS hm, STDDEV_SAMP(quantity) AS hs, COUNT(quantity) AS hn,
              arg_max(quantity, date) AS hl FROM hist GROUP BY ALL),
w7 AS (SELECT g.business_id, g.item_name, g.date, AVG(h.quantity) AS m, STDDEV_SAMP(h.quantity) AS s,
              COUNT(h.quantity) AS n
       FROM grid g JOIN hist h ON h.business_id = g.business_id AND h.item_name = g.item_name
        AND h.date >= g.date - INTERVAL 7 DAY AND h.date < g.date GROUP BY ALL),
w30 AS (SELECT g.business_id, g.item_name, g.date, AVG(h.quantity) AS m, COUNT(h.quantity) AS n
        FROM grid g JOIN hist h ON h.business_id = g.business_id AND h.item_name = g.item_name
         AND h.date >= g.date - INTERVAL 30 DAY AND h.date < g.date GROUP BY ALL),
fb AS (SELECT business_id, item_name, AVG(quantity) AS f FROM daily GROUP BY ALL),
gm AS (SELECT business_id, AVG(quantity) AS g FROM daily GROUP BY business_id),
x AS (
  SELECT g.business_id, g.date, g.item_name, st.hm, st.hs, st.hn, st.hl, COALESCE(st.hn, 0) > 0 AS has,
    COALESCE(h1.quantity, st.hl) AS lag1, COALESCE(h7.quantity, h1.quantity, st.hl) AS lag7,
    w7.m AS m7, w7.s AS s7, COALESCE(w7.n, 0) AS n7, w30.m AS m30, COALESCE(w30.n, 0) AS n30,
    COALESCE(fb.f, gm.g) AS fbv, gm.g AS gv
  FROM grid g LEFT JOIN st USING (business_id, item_name)
  LEFT JOIN hist h1 ON h1.business_id = g.business_id AND h1.item_name = g.item_name AND h1.date = g.date - 1
  LEFT JOIN hist h7 ON h7.business_id = g.business_id AND h7.item_name = g.item_name AND h7.date = g.date - 7
  LEFT JOIN w7 ON w7.business_id = g.business_id AND w7.item_name = g.item_name AND w7.date = g.date
  LEFT JOIN w30 ON w30.business_id = g.business_id AND w30.item_name = g.item_name AND w30.date = g.date
  LEFT JOIN fb ON fb.business_id = g.business_id AND fb.item_name = g.item_name
  LEFT JOIN gm ON gm.business_id = g.business_id
)
SELECT business_id, date, item_name,
  ROUND(COALESCE(CASE WHEN has THEN lag1 ELSE fbv END, gv), 6) AS lag_1,
  ROUND(COALESCE(CASE WHEN has THEN lag7 ELSE fbv END, gv), 6) AS lag_7,
  ROUND(COALESCE(CASE WHEN has THEN (CASE WHEN n7 > 0 THEN m7 ELSE hm END) ELSE fbv END, gv), 6) AS rolling_7_avg,
  ROUND(COALESCE(CASE WHEN has THEN (CASE WHEN n30 > 0 THEN m30 ELSE hm END) ELSE fbv END, gv), 6)
    AS rolling_30_avg,
  ROUND(COALESCE(CASE WHEN has THEN (CASE WHEN n7 > 0 THEN (CASE WHEN n7 > 1 THEN s7 ELSE m7 * 0.2 END)
                                          ELSE (CASE WHEN hn > 1 THEN hs ELSE hm * 0.2 END) END)
                 ELSE fbv * 0.2 END, gv), 6) AS rolling_7_std
FROM x""")
def forecast_lags(spark, sf_dir):
    """Forecast-side lags on a grid from 9 days before to 5 days after each
    business's last date: calendar lags (J-24), calendar windows over the last
    60 days (W-07) and the no-history fallback (W-08)."""
    from ..plans import forecast as FC
    from ..util import round_doubles

    daily = S.daily_item_sales(T.sales(spark, sf_dir))
    grid = FC.forecast_grid(daily, days=14, offset=-9).withColumnRenamed("prediction_date", "date")
    fb = S.avg_daily_quantity(daily).withColumnRenamed("avg_daily_qty", "fallback_qty")
    return round_doubles(FC.forecast_lags(grid, daily, fb))


@query("W11_positional_split", _DAILY + """
SELECT business_id, date, item_name, quantity,
  row_number() OVER (PARTITION BY business_id ORDER BY item_name, date)
    <= floor(COUNT(*) OVER (PARTITION BY business_id) * 0.8) AS is_train
FROM daily""")
def positional_split(spark, sf_dir):
    """The reference's positional 80/20 split in item-major order (Q5)."""
    return TR.positional_split(T.daily_series(spark, sf_dir), 0.2)


@query("W12_positional_folds", _DAILY + """,
p AS (SELECT *, row_number() OVER (PARTITION BY business_id ORDER BY item_name, date) AS pos,
             COUNT(*) OVER (PARTITION BY business_id) AS n FROM daily),
f AS (SELECT p.*, CAST(k AS INTEGER) AS fold, n - (3 - k + 1) * (n // 4) AS st, n // 4 AS sz FROM p, range(1, 4) t(k))
SELECT business_id, date, item_name, quantity, fold,
  CASE WHEN pos <= st THEN 'train' ELSE 'valid' END AS role
FROM f WHERE pos <= st + sz""")
def positional_folds(spark, sf_dir):
    """The reference's expanding positional folds (3 splits) in item-major order."""
    return TR.positional_folds(T.daily_series(spark, sf_dir), 3)
