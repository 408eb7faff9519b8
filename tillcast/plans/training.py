"""Model training, evaluation, search, persistence and forecasting.

M-02..M-10, M-13, W-11, W-12, T-04, F-17, F-18.

* Splits are by date (W-11, deliberate fix of Q5): the cut-off is the exact
  percentile of the row dates per business (Spark's percentile aggregates a
  value -> count map, bounded by the number of distinct days).
* Folds (W-12) are expanding windows cut at the k/(n+1) date quantiles.
* Metrics are computed on a model fitted on the training part only; the
  serving model is fitted on all rows (fix of Q6).
* A whole training job - folds, evaluation and serving of every candidate, one
  model over all businesses or one per business - is one run of
  ``boosting.grow`` over one quantised matrix. There is no loop over
  candidates, folds or businesses.
"""

from __future__ import annotations

import math
import random
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from functools import cached_property, partial

from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.scalars import ape, round_prediction
from ..operators import items as I
from ..operators import series as S
from ..operators.ranking import with_position
from ..session import cut_lineage, replace_file
from ..util import with_business
from . import boosting as B
from .features import Calendars, build_features, feature_names
from .forecast import forecast_grid, forecast_lags

LABEL = "quantity"
KEYS = ["business_id", "date", "item_name"]

# Default boosting settings and the random-search grid. The item code
# is one continuous column, so items share a bin beyond ``maxBins`` of them: pass a
# larger value for a larger catalogue.
DEFAULT_PARAMS = {"maxIter": 100, "maxDepth": 6, "stepSize": 0.1, "maxBins": 64}
SEARCH_GRID = {
    "maxIter": [50, 100, 150, 200, 250],
    "maxDepth": [3, 4, 5, 6, 7, 8],
    "stepSize": [0.01, 0.05, 0.1, 0.15, 0.2],
    "minInstancesPerNode": [1, 3, 5, 7],
    "subsamplingRate": [0.7, 0.8, 0.9, 1.0],
    "featureSubsetStrategy": ["0.7", "0.8", "0.9", "1.0"],
    "minInfoGain": [0.0, 0.1, 0.2, 0.3],
}


def training_frame(sales: DataFrame, cal: Calendars | None = None, pooled: bool = True) -> DataFrame:
    """M-01 + W-01..W-06: one row per (business, date, item) with the label,
    all calendar / date features and the row lags. ``pooled`` adds the
    business id as a feature so one model can serve every business."""
    # the series feeds features, fill statistics, codes, lags and the span:
    # materialise it once in the shared folder
    daily = cut_lineage(S.daily_item_sales(sales))
    cal = cal or Calendars.for_data(daily)
    feats = build_features(daily, cal)
    lags = S.lag_features(daily).drop(LABEL)
    out = feats.join(lags, KEYS)
    if pooled:
        out = out.withColumn("business_code", F.col("business_id").cast("double"))
    return out


def model_features(df: DataFrame) -> list[str]:
    names = feature_names(df)
    if "business_code" in df.columns:
        names.append("business_code")
    return names


def assembler(names: list[str]) -> VectorAssembler:
    return VectorAssembler(inputCols=names, outputCol="features", handleInvalid="keep")


def prepare(df: DataFrame, names: list[str]) -> DataFrame:
    """M-02: missing feature columns -> 0 and NULLs -> 0 before assembling."""
    missing = {n: F.lit(0.0) for n in names if n not in df.columns}
    if missing:
        df = df.withColumns(missing)
    return df.select(*[c for c in df.columns if c not in names],
                     *[F.coalesce(F.col(n).cast("double"), F.lit(0.0)).alias(n) for n in names])


def fit_of(params: dict | None, role: str, seed: int = 42) -> B.Fit:
    """M-04: the parameters of squared-error gradient-boosted trees."""
    p = {**DEFAULT_PARAMS, **(params or {})}
    return B.Fit(role, depth=p["maxDepth"], step=p["stepSize"], trees=(p["maxIter"],), min_rows=p.get("minInstancesPerNode", 1),
                 row_share=p.get("subsamplingRate", 1.0), feature_share=float(p.get("featureSubsetStrategy", 1.0)),
                 min_gain=p.get("minInfoGain", 0.0), bins=p["maxBins"], seed=seed)


@dataclass
class Model:
    """Fitted trees, one forest or one per business (``group``)."""
    trees: DataFrame  # boosting.MODEL_SCHEMA
    names: list[str]
    group: str | None = None

    def transform(self, frame: DataFrame) -> DataFrame:
        """``frame`` with a ``prediction``."""
        return B.predict(frame, self.trees, self.names, self.group)


def item_indexer(df: DataFrame) -> StringIndexer:
    """M-03: alphabetical item codes, unseen items kept as the last index."""
    return StringIndexer(inputCol="item_name", outputCol="item_index", handleInvalid="keep",
                         stringOrderType="alphabetAsc")


# ---------------------------------------------------------------- splits

def split_dates(df: DataFrame, test_size: float = 0.2) -> DataFrame:
    """W-11: per business, the date at the (1 - test_size) percentile of its rows."""
    d, _ = with_business(df)
    q = F.percentile(F.unix_date("date").cast("double"), F.lit(1.0 - test_size))
    return d.groupBy("business_id").agg(F.date_from_unix_date(F.floor(q).cast("int")).alias("split_date"))


def chronological_split(df: DataFrame, test_size: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """W-11: rows before the split date train, the rest test."""
    j = df.join(split_dates(df, test_size), "business_id")
    return (j.where(F.col("date") < F.col("split_date")).drop("split_date"),
            j.where(F.col("date") >= F.col("split_date")).drop("split_date"))


def fold_bounds(df: DataFrame, n_folds: int = 3) -> DataFrame:
    """W-12: per business and fold k (1..n), [start_k, end_k) of the validation
    dates at the k/(n+1) and (k+1)/(n+1) date quantiles; training = dates < start_k."""
    d, _ = with_business(df)
    qs = [k / (n_folds + 1) for k in range(1, n_folds + 2)]
    b = d.groupBy("business_id").agg(
        F.percentile(F.unix_date("date").cast("double"), F.array(*[F.lit(q) for q in qs])).alias("_q"))
    rows = F.explode(F.array(*[F.struct(
        F.lit(k).alias("fold"),
        F.date_from_unix_date(F.floor(F.col("_q")[k - 1]).cast("int")).alias("valid_start"),
        (F.date_from_unix_date(F.floor(F.col("_q")[k]).cast("int")) if k < n_folds
         else F.date_add(F.date_from_unix_date(F.floor(F.col("_q")[k]).cast("int")), 1)).alias("valid_end"))
        for k in range(1, n_folds + 1)])).alias("f")
    return b.select("business_id", rows).select("business_id", "f.*")


# ---------------------------------------------------------------- metrics

def metrics(pred: DataFrame, label: str = LABEL, prediction: str = "prediction", by: Sequence[str] = ()) -> DataFrame:
    """M-07 / F-17: MAE and safe MAPE (actual = 0 skipped; none left -> 0) and rows, per ``by`` group."""
    return pred.groupBy(*by).agg(F.avg(F.abs(F.col(label) - F.col(prediction))).alias("mae"),
                    F.coalesce(F.avg(ape(label, prediction)), F.lit(0.0)).alias("mape"),
                    F.count(F.lit(1)).alias("rows"))


@dataclass
class SearchResult:
    best_params: dict
    fold_maes: list[float]
    candidates: list[tuple[dict, float]] = field(default_factory=list)


def sample_candidates(grid: dict, n_iter: int, seed: int = 42) -> list[dict]:
    """``n_iter`` distinct combinations of the grid (all of them if there are fewer)."""
    sizes = [len(v) for v in grid.values()]
    total = math.prod(sizes)
    out = []
    for code in random.Random(seed).sample(range(total), min(n_iter, total)):
        c = {}
        for (k, values), n in zip(grid.items(), sizes, strict=True):
            code, at = divmod(code, n)
            c[k] = values[at]
        out.append(c)
    return out


def with_roles(df: DataFrame, n_folds: int = 3, test_size: float | None = 0.2) -> tuple[DataFrame, list[str]]:
    """``df`` with a role column (1 trains, 2 is held out, else unused) for each expanding fold, then, with a
    ``test_size``, for the chronological split (``evaluate``) and for all rows (``serve``)."""
    folds = [f"fold_{k}" for k in range(1, n_folds + 1)]
    bounds = fold_bounds(df, n_folds).groupBy("business_id").agg(
        *[F.first(F.when(F.col("fold") == k, F.struct("valid_start", "valid_end")), True).alias(f) for k, f in enumerate(folds, 1)])
    out = df.join(bounds, "business_id").withColumns({
        f: F.when(F.col("date") < F.col(f"{f}.valid_start"), B.TRAIN).when(F.col("date") < F.col(f"{f}.valid_end"), B.HELD_OUT) for f in folds})
    if test_size is None:
        return out, folds
    out = out.join(split_dates(df, test_size), "business_id")
    return out.withColumn("evaluate", F.when(F.col("date") < F.col("split_date"), B.TRAIN).otherwise(B.HELD_OUT)).withColumn(
        "serve", F.lit(B.TRAIN)).drop("split_date"), [*folds, "evaluate", "serve"]


@dataclass
class Runs:
    """What one run of all candidates on all roles gave."""
    candidates: list[dict]
    roles: list[str]
    scores: DataFrame  # grp, candidate, job (role column), role, rows, abs_error, ape, ape_rows
    models: DataFrame  # boosting.MODEL_SCHEMA with candidate and job; the trees of evaluate and serve
    group: str | None


def run_candidates(df: DataFrame, names: list[str], candidates: list[dict], n_folds: int = 3, test_size: float | None = 0.2,
                   group: str | None = None, seed: int = 42) -> Runs:
    """Grow and measure every candidate on every role, in one run. Candidates that differ in ``maxIter`` alone
    share their trees: a smaller one is a prefix of the largest."""
    spark = df.sparkSession
    with_role, roles = with_roles(df, n_folds, test_size)
    fits: dict[B.Fit, int] = {}  # without its tree counts -> its place
    counts: list[set[int]] = []
    jobs = []  # fit, trees, candidate, role column
    for c, params in enumerate(candidates):
        for role in roles:
            fit = fit_of(params, role, seed)
            k = fits.setdefault(replace(fit, trees=()), len(fits))
            if k == len(counts):
                counts.append(set())
            counts[k].add(fit.trees[0])
            jobs.append((k, fit.trees[0], c, role))
    grown = B.grow(with_role, names, LABEL, [replace(f, trees=tuple(sorted(n))) for f, n in zip(fits, counts, strict=True)],
                   keep=[k for f, k in fits.items() if f.role in ("evaluate", "serve")], group=group)
    table = F.broadcast(spark.createDataFrame(jobs, "fit int, n_trees int, candidate int, job string"))  # candidates x roles rows
    scores = grown.scores.withColumnRenamed("trees", "n_trees").join(table, ["fit", "n_trees"]).drop("fit", "n_trees")
    models = grown.models.join(table, "fit").where(F.col("tree") < F.col("n_trees"))
    return Runs(candidates, roles, scores, models, group)


def candidate_scores(runs: Runs) -> DataFrame:
    """M-06: grp, candidate, cv_mae (mean of the folds' MAE; a fold without rows has none and is left out) and the
    folds' MAEs in order."""
    folds = runs.scores.where(F.col("job").startswith("fold_") & (F.col("role") == B.HELD_OUT) & (F.col("rows") > 0))
    mae = F.col("abs_error") / F.col("rows")
    return folds.groupBy("grp", "candidate").agg(
        F.avg(mae).alias("cv_mae"), F.stddev_pop(mae).alias("cv_std"),
        F.transform(F.array_sort(F.collect_list(F.struct("job", mae.alias("mae")))), lambda x: x["mae"]).alias("fold_maes"))


def best_candidates(runs: Runs) -> DataFrame:
    """The candidate with the lowest score in each group, the first of equals."""
    return candidate_scores(runs).groupBy("grp").agg(
        F.min_by(F.struct("candidate", "cv_mae", "cv_std", "fold_maes"), F.struct("cv_mae", "candidate")).alias("b")).select("grp", "b.*")


def _search_result(runs: Runs) -> SearchResult:
    scored = {r.candidate: r for r in candidate_scores(runs).collect()}  # one row a candidate
    if not scored:
        raise ValueError("no fold has training and validation rows")
    best = min(scored.values(), key=lambda r: (r.cv_mae, r.candidate))
    return SearchResult(runs.candidates[best.candidate], list(best.fold_maes),
                        [(c, scored[i].cv_mae if i in scored else math.nan) for i, c in enumerate(runs.candidates)])


def random_search(df: DataFrame, names: list[str], n_iter: int = 20, n_folds: int = 3, seed: int = 42,
                  grid: dict | None = None) -> SearchResult:
    """M-05 / M-06: ``n_iter`` distinct random candidates scored by mean fold MAE
    on expanding folds, all in one run. A fold without rows has no score and is
    left out of the mean; a candidate without any score cannot win."""
    return _search_result(run_candidates(df, names, sample_candidates(grid or SEARCH_GRID, n_iter, seed), n_folds, None))


@dataclass
class Artefact:
    """M-10: everything a forecast needs, saved and loaded as one folder."""
    model: Model
    names: list[str]
    codes: DataFrame          # business_id, item_name, item_encoded: the codes the trees were fitted on
    known: DataFrame          # business_id, item_name, category
    averages: DataFrame       # business_id, item_name, avg_daily_qty
    category_avg: DataFrame   # business_id, category, category_avg
    history: DataFrame        # the last 60 days per business: business_id, date, item_name, quantity
    hourly: DataFrame | None = None    # A-14 / A-15, where the sales have times
    metadata: DataFrame | None = None  # per item: sizes, shares, prices


_TABLES = ("codes", "known", "averages", "category_avg", "history", "hourly", "metadata")


@dataclass
class TrainResult:
    model: Model
    names: list[str]
    tables: Callable[[], Artefact]  # writes the tables beside the model
    metrics: DataFrame
    importance: DataFrame
    search: SearchResult | None
    evaluation: Model | None = None  # the model of the training part, which the metrics are of
    runs: Runs | None = None         # scores of every candidate, fold and role

    @cached_property
    def artefact(self) -> Artefact:
        """The model and its tables, which are written when first asked for."""
        return self.tables()


def feature_importance(model: Model) -> DataFrame:
    """M-08: feature -> importance (rounded to 4), largest first; per business where the model is."""
    trees, by = model.trees, []
    if model.group:
        trees, by = trees.withColumnRenamed("grp", model.group), [model.group]
    return B.importance(trees, model.names, by).select(*by, "feature", F.bround("importance", 4).alias("importance")).orderBy(
        *by, F.col("importance").desc(), "feature")


def top_features(importance: DataFrame, k: int = 10) -> DataFrame:
    """T-04: top k features as percent."""
    from ..functions.scalars import display_name

    return importance.orderBy(F.col("importance").desc(), "feature").limit(k).select(
        "feature", display_name("feature").alias("display_name"), (F.col("importance") * 100).alias("percent"))


def _summary(runs: Runs, best: DataFrame) -> DataFrame:
    """One row per group: errors on the training and test part, their rows, and the best candidate's fold errors."""
    ev = runs.scores.where("job = 'evaluate'").join(best, ["grp", "candidate"])
    part = lambda role, value: F.max(F.when(F.col("role") == role, value))
    mae = F.when(F.col("rows") > 0, F.col("abs_error") / F.col("rows"))
    mape = F.when(F.col("ape_rows") > 0, F.col("ape") / F.col("ape_rows")).otherwise(F.lit(0.0))
    return ev.groupBy("grp").agg(
        part(B.TRAIN, mae).alias("train_mae"), part(B.HELD_OUT, mae).alias("test_mae"),
        part(B.TRAIN, mape).alias("train_mape"), part(B.HELD_OUT, mape).alias("test_mape"),
        part(B.TRAIN, F.col("rows")).alias("training_rows"), part(B.HELD_OUT, F.col("rows")).alias("test_rows"),
        F.max("cv_mae").alias("cv_mae_mean"), F.max("cv_std").alias("cv_mae_std"), F.max("candidate").alias("candidate"))


def _forests(runs: Runs, best: DataFrame, names: list[str], job: str) -> Model:
    trees = runs.models.where(F.col("job") == job).join(best.select("grp", "candidate"), ["grp", "candidate"])
    return Model(cut_lineage(trees.select(*[f.name for f in B.T.StructType.fromDDL(B.MODEL_SCHEMA)]), "forest"), names, runs.group)


def train(frame: DataFrame, test_size: float = 0.2, tune: bool = True, n_folds: int = 3,
          params: dict | None = None, n_iter: int = 20, sales: DataFrame | None = None, group: str | None = None) -> TrainResult:
    """M-13: search (``tune``) or cross-validation of ``params`` -> errors of a
    model fitted on the training split -> serving model on all rows -> codes,
    averages, history and, from ``sales``, categories, item metadata and hourly
    patterns beside the model. ``group``: one model per value of that column."""
    names = model_features(frame)
    # folds, evaluation and the artefact read this frame: cut the long feature lineage
    df = cut_lineage(prepare(frame, names))
    cands = sample_candidates(SEARCH_GRID, n_iter, 42) if tune else [dict(params or {})]
    runs = run_candidates(df, names, cands, n_folds, test_size, group)
    best = cut_lineage(best_candidates(runs), "best")
    if not group and not best.take(1):  # too few days for folds: nothing to choose by
        best = frame.sparkSession.createDataFrame([("", 0, None, None, None)], best.schema)
    elif group:
        lone = df.select(F.coalesce(F.col(group).cast("string"), F.lit("")).alias("grp")).distinct().join(best, "grp", "left")
        best = cut_lineage(lone.withColumn("candidate", F.coalesce("candidate", F.lit(0))), "best")
    summary = _summary(runs, best)
    if group:
        summary = summary.withColumn("grp", F.col("grp").cast(df.schema[group].dataType)).withColumnRenamed("grp", group)
    else:
        summary = summary.drop("grp", "candidate")
    serving = _forests(runs, best, names, "serve")
    result = TrainResult(serving, names, partial(_artefact, serving, names, df, sales), cut_lineage(summary, "summary"), feature_importance(serving),
                         _search_result(runs) if tune and not group else None)
    result.evaluation, result.runs = _forests(runs, best, names, "evaluate"), runs
    return result


def _artefact(model: Model, names: list[str], df: DataFrame, sales: DataFrame | None) -> Artefact:
    """Every table is written once. A forecast reads them in many branches: were they plans over the sales,
    each branch would join the sales again, and the sides it broadcasts would lie at the driver together."""
    daily = df.select(*KEYS, F.col(LABEL).alias("quantity"))
    codes = cut_lineage(df.select("business_id", "item_name", F.col("item_encoded").cast("int").alias("item_encoded")).distinct(), "codes")
    if sales is not None and "type" in sales.columns:
        known = cut_lineage(I.item_category(sales), "known")
    else:
        known = codes.select("business_id", "item_name", F.lit(I.DEFAULT_CATEGORY).alias("category"))
    hourly = metadata = None
    if sales is not None and "time" in sales.columns:
        hourly = cut_lineage(I.hourly_patterns(sales), "hourly")
    if sales is not None and {"size", "unit_price", "type"} <= set(sales.columns):
        stats = cut_lineage(I.item_size_stats(sales), "sizes")
        metadata = cut_lineage(I.item_metadata(sales, daily, stats, known), "metadata")
    return Artefact(
        model, names, codes, known, cut_lineage(S.avg_daily_quantity(daily), "averages"),
        cut_lineage(I.category_average(daily, known), "category"), cut_lineage(S.history_cutoff(daily, 60), "history"), hourly, metadata)


def train_per_business(frame: DataFrame, **kwargs) -> TrainResult:
    """One model per business, as the reference trains them: one job for all
    businesses, each with its own search, errors, importances and trees - the
    same as from training each alone. Metrics and importances have a row per
    business."""
    return train(frame, group="business_id", **kwargs)


def forecast(art: Artefact, days: int = 7, cal: Calendars | None = None, start=None,
             items: DataFrame | None = None) -> DataFrame:
    """M-09: grid (J-13) -> features (M-01) with the codes of the training run
    -> history lags (J-24, W-07, W-08) -> trees -> half-even round, floor 0
    (F-18). ``items``: (business_id, item_name) to forecast, all trained ones by
    default; an item the model has not seen gets the code of a similar item or
    of the best seller (J-21) and the fallback quantities of J-23."""
    # grid, codes and fallbacks read these items in many branches
    wanted = cut_lineage((items if items is not None else art.codes).select("business_id", "item_name").distinct(), "wanted")
    grid = forecast_grid(art.history, days, start, wanted).withColumnRenamed("prediction_date", "date")
    named = wanted.withColumnRenamed("item_name", "name")
    codes = I.item_code_lookup(named, art.codes, art.known, art.averages).withColumnRenamed("name", "item_name")
    fallback = I.fallback_quantity(named, art.averages, art.known, art.category_avg,
                                   S.business_mean(art.history, name="global_avg")).withColumnRenamed("name", "item_name")
    cal = cal or Calendars.for_data(art.history.select("date").unionByName(grid.select("date")))
    feats = build_features(grid, cal, codes=codes)
    frame = feats.join(forecast_lags(grid, art.history, fallback), KEYS)
    if "business_code" in art.names:
        frame = frame.withColumn("business_code", F.col("business_id").cast("double"))
    scored = art.model.transform(prepare(frame, art.names))
    return scored.select("business_id", F.col("date").alias("prediction_date"), "item_name",
                         round_prediction("prediction").alias("predicted_quantity"))


_POINTER = "CURRENT"


def save_model(art: Artefact, path: str) -> None:
    """M-10: trees, feature names and the tables of the training run as one version.

    Everything goes into a new folder under ``path``; the pointer that names it
    is written last and replaces the older one in one step, so a reader always
    loads a whole version: the old one until then, and also if a save breaks off.
    """
    spark = art.codes.sparkSession
    version = f"v-{uuid.uuid4().hex[:12]}"
    at = f"{path}/{version}"
    art.model.trees.write.parquet(f"{at}/trees")
    saved = [t for t in _TABLES if getattr(art, t) is not None]
    rows = [("name", i, n) for i, n in enumerate(art.names)] + [("table", i, t) for i, t in enumerate(saved)]
    rows += [("group", 0, art.model.group)] if art.model.group else []
    spark.createDataFrame(rows, "kind string, place int, value string").coalesce(1).write.parquet(f"{at}/contents")
    for t in saved:
        getattr(art, t).write.parquet(f"{at}/{t}")
    replace_file(spark, f"{path}/{_POINTER}", version.encode())


def load_model(spark: SparkSession, path: str) -> Artefact:
    at = f"{path}/{spark.read.text(f'{path}/{_POINTER}').first()[0]}"
    contents = sorted(map(tuple, spark.read.parquet(f"{at}/contents").collect()))  # a row a feature and table
    of = lambda kind: [value for k, _, value in contents if k == kind]
    model = Model(spark.read.parquet(f"{at}/trees"), of("name"), (of("group") or [None])[0])
    return Artefact(model, of("name"), **{t: spark.read.parquet(f"{at}/{t}") if t in of("table") else None for t in _TABLES})


# ---------------------------------------------------------------- positional (Q5)

def positions(df: DataFrame, order: tuple[str, str] = ("item_name", "date")) -> DataFrame:
    """1-based row position per business in (item, date) order, the reference's
    item-major order (Q5), by a range-partitioned sort (``operators.ranking``):
    no task ranks a whole business or its catalogue. Also adds the business
    row count ``_n``."""
    d, _ = with_business(df)
    return with_position(d, ["business_id"], list(order), "_pos", "_n").withColumn("_pos", F.col("_pos") + 1)


def positional_split(df: DataFrame, test_size: float = 0.2) -> DataFrame:
    """W-11 as the reference does it (Q5): the first int(n x (1 - test_size))
    rows in item-major order train, the rest test. Adds ``is_train``."""
    p = positions(df)
    cut = F.floor(F.col("_n") * (1.0 - test_size))
    return p.withColumn("is_train", F.col("_pos") <= cut).drop("_pos", "_n")


def positional_folds(df: DataFrame, n_splits: int = 3) -> DataFrame:
    """W-12 as the reference's expanding splitter: fold size = n // (n_splits + 1);
    fold k (1-based) validates rows [n - (n_splits - k + 1) x size, + size) and
    trains on every earlier row. One row per (row, fold) where the row is used,
    with ``role`` 'train' or 'valid'."""
    p = positions(df)
    size = F.floor(F.col("_n") / (n_splits + 1))
    folds = F.explode(F.sequence(F.lit(1), F.lit(n_splits))).alias("fold")
    x = p.select("*", folds)
    start = F.col("_n") - (F.lit(n_splits) - F.col("fold") + 1) * size   # 0-based start
    role = (F.when(F.col("_pos") <= start, F.lit("train"))
            .when(F.col("_pos") <= start + size, F.lit("valid")))
    return x.withColumn("role", role).where(F.col("role").isNotNull()).drop("_pos", "_n")
