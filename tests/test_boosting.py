"""Grouped boosting: against plain recursion, and that no way of running it changes a model."""

from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.plans import boosting as B
from tillcast.plans import training as TR
from tillcast.sources import tables as T

NAMES = ["a", "b", "c"]


@pytest.fixture(scope="module")
def rows(spark):
    rng = random.Random(1)
    data = []
    for k in range(1200):
        g = "hot" if k % 3 else "cold"
        a, b = rng.randrange(40), rng.random()
        y = 3.0 * (a > 12) + 2 * b * (g == "hot") + rng.randrange(3)
        data.append((k, g, float(a), b, float(rng.randrange(2)), y, 1 if k % 5 else 2, None if k % 7 == 0 else 1))
    return spark.createDataFrame(data, "id long, g string, a double, b double, c double, y double, early int, late int").cache()


FITS = [B.Fit("early", depth=3, trees=(2, 5)), B.Fit("late", depth=4, step=0.3, trees=(4,), min_rows=5, row_share=0.7, feature_share=0.7, bins=16),
        B.Fit("early", depth=2, trees=(3,), min_gain=0.05)]


def as_dict(grown):
    trees = {(r.grp, r.fit, r.tree): (r.feature, r.threshold, r.value, r.start) for r in grown.models.collect()}
    scores = {(r.grp, r.fit, r.trees, r.role): (r.rows, round(r.abs_error, 6), round(r.ape, 6), r.ape_rows) for r in grown.scores.collect()}
    return trees, scores


def test_levels_equal_tasks(spark, rows, monkeypatch):
    """Grown level by level over dealt blocks or in one task: the same trees, bit by bit."""
    here = as_dict(B.grow(rows, NAMES, "y", FITS, keep=[0, 1, 2], group="g"))
    monkeypatch.setattr(B, "TASK_ROWS", 500)   # "hot" is larger, "cold" is not
    monkeypatch.setattr(B, "BLOCK_ROWS", 64)
    monkeypatch.setattr(B, "CHECKPOINT", 2)
    assert as_dict(B.grow(rows.repartition(7), NAMES, "y", FITS, keep=[0, 1, 2], group="g")) == here
    assert len(here[0]) == 2 * (5 + 4 + 3) and len(here[1]) == 2 * 2 * 4


def test_groups_do_not_touch_each_other(spark, rows):
    both = as_dict(B.grow(rows, NAMES, "y", FITS[:1], keep=[0], group="g"))
    for g in ("hot", "cold"):
        alone = as_dict(B.grow(rows.where(F.col("g") == g), NAMES, "y", FITS[:1], keep=[0], group="g"))
        assert alone[0] == {k: v for k, v in both[0].items() if k[0] == g}
        assert alone[1] == {k: v for k, v in both[1].items() if k[0] == g}


def test_first_tree_is_the_best_one(spark, rows):
    """Root split of the first tree against all possible ones."""
    data = [r for r in rows.collect() if r.early == 1]
    grown = B.grow(rows, NAMES, "y", [B.Fit("early", depth=1, trees=(1,), bins=256)], keep=[0])
    t = grown.models.first()
    y = np.array([r.y for r in data])
    rest = y - y.mean()

    def error(mask):
        return sum(((rest[m] - rest[m].mean()) ** 2).sum() for m in (mask, ~mask) if m.any())
    best = min(error(np.array([r[f] for r in data]) <= cut) for f in ("a", "c") for cut in {r[f] for r in data})
    name = NAMES[t.feature[0]]
    left = np.array([r[name] for r in data]) <= t.threshold[0]
    assert t.start == pytest.approx(y.mean(), abs=1e-6) and error(left) <= best + 1e-6
    assert t.value[1] == pytest.approx(rest[left].mean(), abs=1e-6) and t.value[2] == pytest.approx(rest[~left].mean(), abs=1e-6)


def test_predictions_are_those_of_the_run(spark, rows):
    grown = B.grow(rows, NAMES, "y", FITS, keep=[1], group="g")
    scored = B.predict(rows, grown.models, NAMES, "g")
    assert scored.columns == [*rows.columns, "prediction"] and scored.count() == rows.count()
    got = {r.g: r.e for r in scored.where("late = 1").groupBy("g").agg(F.sum(F.abs(F.col("prediction") - F.col("y"))).alias("e")).collect()}
    want = {r.grp: r.abs_error for r in grown.scores.where("fit = 1 AND role = 1").collect()}
    assert got == pytest.approx(want)
    other = B.predict(rows.withColumn("g", F.lit("new")), grown.models, NAMES, "g")
    assert other.where("prediction IS NOT NULL").count() == 0


def test_prefixes_are_own_fits(spark, rows):
    staged = as_dict(B.grow(rows, NAMES, "y", [B.Fit("early", depth=3, trees=(2, 5))], keep=[0]))
    own = as_dict(B.grow(rows, NAMES, "y", [B.Fit("early", depth=3, trees=(2,))], keep=[0]))
    assert own[1] == {k: v for k, v in staged[1].items() if k[2] == 2}
    assert own[0] == {k: v for k, v in staged[0].items() if k[2] < 2}


def test_importances(spark, rows):
    grown = B.grow(rows, NAMES, "y", FITS[:1], keep=[0], group="g")
    imp = B.importance(grown.models, NAMES, ["grp"]).collect()
    assert len(imp) == 6
    for g in ("hot", "cold"):
        share = {r.feature: r.importance for r in imp if r.grp == g}
        assert sum(share.values()) == pytest.approx(1) and max(share, key=share.get) == "a"


def test_empty_and_constant(spark, rows):
    none = B.grow(rows.limit(0), NAMES, "y", FITS[:1], keep=[0])
    assert none.models.count() == none.scores.count() == 0
    flat = B.grow(rows.withColumn("y", F.lit(4.0)), NAMES, "y", FITS[:1], keep=[0])
    assert {tuple(r.feature) for r in flat.models.collect()} == {(-1,) * 15}
    assert B.predict(rows, flat.models, NAMES).agg(F.min("prediction"), F.max("prediction")).first() == (4.0, 4.0)


def test_all_businesses_in_one_job_equal_the_loop(spark):
    frame = TR.cut_lineage(TR.training_frame(T.sales(spark, "/root/testdata/sf0.001"), pooled=False))
    kwargs = dict(tune=True, n_iter=2, n_folds=2)
    grid, TR.SEARCH_GRID = TR.SEARCH_GRID, {"maxIter": [2, 3], "maxDepth": [2, 3]}
    try:
        every = TR.train_per_business(frame, **kwargs)
        got = {r.business_id: r for r in every.metrics.collect()}
        assert len(got) > 2
        for b in list(got)[:2]:
            alone = TR.train(frame.where(F.col("business_id") == b), **kwargs).metrics.first()
            assert [got[b][c] for c in alone.__fields__] == pytest.approx(list(alone))
        assert every.importance.groupBy("business_id").count().where(F.col("count") != len(every.names)).count() == 0
    finally:
        TR.SEARCH_GRID = grid


def test_a_broken_save_leaves_the_old_model(spark, tmp_path, monkeypatch):
    d0 = dt.date(2024, 1, 1)
    data = [(1, d0 + dt.timedelta(days=k), item, q + k % 5) for k in range(60) for item, q in (("a", 9.0), ("b", 2.0))]
    sales = spark.createDataFrame(data, "business_id long, date date, item_name string, quantity double")
    frame = TR.training_frame(sales, pooled=False)
    old = TR.train(frame, tune=False, params={"maxIter": 2, "maxDepth": 2}, n_folds=2).artefact
    new = TR.train(frame, tune=False, params={"maxIter": 5, "maxDepth": 2}, n_folds=2).artefact
    path = f"{tmp_path}/model"
    TR.save_model(old, path)
    broken = TR.Artefact(new.model, new.names, new.codes, new.known, new.averages,
                         new.category_avg.withColumn("category_avg", F.raise_error(F.lit("lost"))), new.history)
    with pytest.raises(Exception, match="lost"):
        TR.save_model(broken, path)
    assert TR.load_model(spark, path).model.trees.count() == 2
    TR.save_model(new, path)
    assert TR.load_model(spark, path).model.trees.count() == 5


def test_a_large_block_is_small_and_sums_its_own_cells():
    """Bins are as narrow as their numbers, and a feature's sums touch no other feature's cells."""
    rng = np.random.default_rng(4)
    edges = [np.arange(n, dtype=float) for n in (3, 64, 1, 20)]
    cells = np.stack([rng.integers(0, len(e) + 1, 500) for e in edges]).astype(np.min_scalar_type(max(map(len, edges))))
    assert cells.itemsize == 1
    rest, at = rng.integers(-9, 9, 500).astype(float), rng.integers(0, 5, 500)
    first, w = B._cells(edges)
    allowed = np.array([False, True, False, True])
    sums = B._sum_nodes(cells, rest, at, 5, first, w, allowed)
    for f, lo in enumerate(first):
        for node in range(5):
            for c in range(len(edges[f]) + 1):
                here = (at == node) & (cells[f] == c)
                want = [rest[here].sum(), here.sum()] if allowed[f] or f == 0 else [0, 0]
                assert sums[:, node, lo + c].tolist() == want


def test_blocks_hold_a_byte_a_bin(spark, rows):
    import pickle
    flat = rows.select(F.lit("").alias("grp"), *NAMES, F.col("y").alias("label"), F.array("early").alias("__roles"), F.xxhash64("id").alias("__key"))
    edges = B._edges(flat, NAMES, 64)
    held = [pickle.loads(r.payload) for r in B._packed(B._dealt(spark, flat, NAMES, 1), edges, 1).collect()]
    assert {h["cells"].dtype for h in held} == {np.dtype(np.uint8)} and sum(h["cells"].shape[1] for h in held) == rows.count()
