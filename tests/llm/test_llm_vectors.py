"""Hard negatives and nearest neighbours against brute force, over every edge case."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from llm_helpers import SF
from tillcast.llm import negatives, neighbours, vectors

SCHEMA = "vec_id long, embedding array<double>, label int"


def edge_vectors(n: int = 240, dim: int = 8, seed: int = 4):
    rng = random.Random(seed)
    hot = [rng.gauss(0, 1) for _ in range(dim)]
    rows = []
    for k in range(n):
        v = hot if k % 3 == 0 else [rng.gauss(0, 1) + (2 if k % 5 == 0 else 0) for _ in range(dim)]
        rows.append((k * 5, v, rng.choice([0, 1, 1, 1, 2, 9])))
    rows += [(50, hot, 1), rows[10], rows[10], (None, hot, 2), (None, [1.0] * dim, 1)]      # repeated ids and rows, no id
    rows += [(2000, None, 1), (2050, [1.0, None] + [0.0] * (dim - 2), 1), (2100, [float("nan")] * dim, 1), (2150, [float("inf")] * dim, 0),
             (2200, hot, None), (2250, [], 1), (2300, [0.0] * dim, 2), (2350, [0.5, -0.25], 1), (-50, [-x for x in hot], 1),
             (2400, [1e-3 * x for x in hot], 0)]
    rng.shuffle(rows)
    return rows


def valid(rows):
    return [r for r in rows if r[1] is not None and all(x is not None and math.isfinite(x) for x in r[1])]


def mined(rows):
    use = [(i, [math.floor(256 * x) for x in v], label) for i, v, label in valid(rows) if label is not None]
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))  # noqa: E731  shorter ones end in zeros
    order = lambda s, i: (-s, i is None, i or 0)
    out = []
    for a in use:
        if a[0] is None or a[0] % 50:
            continue
        scored = [(dot(a[1], b[1]), b[0], b[2]) for b in use if b is not a]
        positives = sorted((x for x in scored if x[2] == a[2]), key=lambda x: order(*x[:2]))[:5]
        for p, pid, _ in positives:
            fits = sorted((x for x in scored if x[2] != a[2] and 50 * p <= 100 * x[0] <= 95 * p), key=lambda x: order(*x[:2]))
            out += [(a[0], pid, k + 1, x[1], p, x[0]) for k, x in enumerate(fits[:3])]
    return sorted(out, key=repr)


def frame(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("block", "at", "id", "vec", "kind", "rank", "score", "payload", "positives"):
        df = df.withColumn(name, F.lit("clash"))
    return df


@pytest.mark.parametrize("block_rows", [17, 4096])
def test_hard_negatives(spark, monkeypatch, block_rows):
    monkeypatch.setattr(vectors, "MIN_ROWS", block_rows)
    monkeypatch.setattr(vectors, "MAX_ROWS", block_rows)
    monkeypatch.setattr(negatives, "CHUNK", 7)
    monkeypatch.setattr(negatives, "SEGMENT", 5)
    monkeypatch.setattr(negatives, "CLUSTERS", 3)
    rows = edge_vectors()
    got = negatives.mine(frame(spark, rows)).drop("positive_rank").collect()
    want = mined(rows)
    assert len(want) > 60
    assert sorted((tuple(r) for r in got), key=repr) == want


def test_hard_negatives_beyond_doubles(spark):
    """Scores past 2^53 stay exact; past a long they stop there."""
    rng = random.Random(8)
    rows = [(k * 25, [float(rng.randrange(-2**22, 2**22)) for _ in range(4)], k % 2) for k in range(20)]
    got = negatives.mine(spark.createDataFrame(rows, SCHEMA)).drop("positive_rank").collect()
    want = mined(rows)
    assert max(w[4] for w in want) > 2**53 and sorted((tuple(r) for r in got), key=repr) == want
    huge = negatives.mine(spark.createDataFrame([(0, [1e200], 1), (1, [1e200], 1), (2, [1e190], 0)], SCHEMA)).collect()
    assert huge == []  # the negative's score is no lower: both are the largest long


def test_list_bounds_hold():
    rng = np.random.default_rng(0)
    v = rng.normal(size=(500, 6)) + 1
    anchors = rng.normal(size=(40, 6)) + 1
    centres = negatives.fit_centroids(anchors, 3)
    off = negatives.angles(anchors, centres)
    own = off.argmin(axis=1)
    for c in range(len(centres)):
        members = anchors[own == c]
        if len(members):
            b = negatives.bounds(v, centres[c], off[own == c, c].max())
            assert (members @ v.T <= negatives.unit(members)[1][:, None] * b + 1e-9).all()


def test_walk_stops_early():
    """A member that is certified reads no further segment."""
    v = np.vstack([np.full((600, 2), 100.0), np.full((5000, 2), -3.0)])
    block = {"ids": np.arange(len(v)), "labels": np.zeros(len(v), int), "vecs": v}
    b = negatives.bounds(v, np.array([1.0, 1.0]) / math.sqrt(2), 0.0)
    order = np.argsort(-b, kind="stable")
    block["lists"] = {0: (order, b[order])}
    chunk = {"cluster": 0, "block": np.array([9]), "at": np.array([0]), "ids": np.array([0]), "labels": np.array([0]),
             "vecs": np.array([[1.0, 1.0]]), "norms": np.array([math.sqrt(2)])}
    top, seen = vectors.Top(1, 5, np.full(1, -2**62)), []
    negatives.walk(block, chunk, top, 1, lambda m, places, s, j: seen.append(len(places)) or np.ones(s.shape, bool))
    assert top.id.tolist() == [0, 1, 2, 3, 4] and sum(seen) == 2 * negatives.SEGMENT


def cosines(rows):
    use = [(i, v) for i, v, _ in valid(rows) if any(v)]
    dim = max(len(v) for _, v in use)
    m = np.array([v + [0.0] * (dim - len(v)) for _, v in use])
    m /= np.abs(m).max(axis=1)[:, None]
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    return [i for i, _ in use], m


@pytest.mark.parametrize("block_rows", [17, 4096])
def test_neighbours(spark, monkeypatch, block_rows):
    monkeypatch.setattr(vectors, "MIN_ROWS", block_rows)
    monkeypatch.setattr(vectors, "MAX_ROWS", block_rows)
    monkeypatch.setattr(neighbours, "CHUNK", 7)
    rows = edge_vectors()
    got = neighbours.nearest(frame(spark, rows)).collect()
    ids, m = cosines(rows)
    want, hit = 0, 0
    per: dict[int, list] = {}
    for r in got:
        per.setdefault(r.query_id, []).append(r)
    for k, i in enumerate(ids):
        if i is None or i % 50:
            continue
        s = m @ m[k]
        rest = sorted((x for x in range(len(ids)) if x != k), key=lambda x: (-round(s[x], 12), ids[x] is None, ids[x] or 0))[:5]
        near = [round(s[x], 9) for x in rest]
        mine = [round(r.score, 9) for r in per[i]]
        want += 5
        hit += 5 if set(near) <= set(mine) else len([x for x in near if x in mine])
        if sum(1 for j in ids if j == i) == 1:
            assert [r.rank for r in sorted(per[i], key=lambda r: r.rank)] == [1, 2, 3, 4, 5]
            if near == mine:
                assert [r.vec_id for r in sorted(per[i], key=lambda r: r.rank)] == [ids[x] for x in rest]
    assert hit >= 0.95 * want > 0


def test_recall_on_the_given_vectors(spark):
    t = spark.read.parquet(f"{SF}/embeddings.parquet").toPandas()
    m = np.stack(t.embedding).astype(float)
    m /= np.sqrt((m * m).sum(axis=1))[:, None]
    got: dict[int, set] = {}
    for r in neighbours.op13(spark, SF).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    hit = [len(got[i] & set(t.vec_id[np.argsort(-(m @ m[k]) + 9 * (np.arange(len(t)) == k), kind="stable")[:5]]))
           for k, i in enumerate(t.vec_id) if i % 50 == 0]
    assert sum(hit) >= 0.95 * 5 * len(hit)


def test_threshold_is_a_quantile():
    p, m = math.erf(neighbours.WIDTH / 2 / math.sqrt(2)), neighbours.PROJECTIONS
    tail = lambda k: sum(math.comb(m, c) * p**c * (1 - p)**(m - c) for c in range(k, m + 1))
    assert tail(neighbours.threshold()) >= 1 - neighbours.MISS > tail(neighbours.threshold() + 1)


@pytest.mark.parametrize("rows", [[], [(50, [1.0, 2.0], 1)], [(50, [1.0, 2.0], 1), (3, [1.0, 0.0], 2), (4, None, 1)]])
def test_small_vector_tables(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    assert negatives.mine(df).count() == 0
    got = neighbours.nearest(df).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == ([(50, 1, 3)] if len(rows) == 3 else [])
    if got:
        assert got[0].score == pytest.approx(1 / math.sqrt(5), abs=1e-15)


def test_copies_tie_by_id(spark):
    rng = random.Random(2)
    v = [rng.gauss(0, 1) for _ in range(64)]
    df = spark.createDataFrame([(k, v if k != 7 else [2 * x for x in v], 0) for k in range(200)], SCHEMA)
    got = neighbours.nearest(df).where("query_id = 150").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4] and len({r.score for r in got}) == 1


def test_other_blocks_count_one_window(monkeypatch):
    """Where a query knows its reach, a block counts one window or what lies outside it, and misses next to nothing nearer."""
    rng = np.random.default_rng(4)
    v, q = rng.normal(size=(3000, 16)), rng.normal(size=(40, 16))
    block = {"ids": np.arange(3000), "vecs": v, **neighbours.index(v)}
    cos = (q / np.linalg.norm(q, axis=1)[:, None]) @ (v / np.linalg.norm(v, axis=1)[:, None]).T
    counted = []
    bincount = np.bincount
    monkeypatch.setattr(neighbours, "radii", lambda: pytest.fail("widened"))
    monkeypatch.setattr(neighbours.np, "bincount", lambda x, **k: counted.append(len(x)) or bincount(x, **k))
    for reach in (0.6, 1.3):
        counted.clear()
        got = neighbours.search(block, q, np.full(40, -1), np.full(40, reach))
        assert len(counted) == 40 and max(counted) <= 3000 * neighbours.PROJECTIONS // 2
        want = [set([x for x in np.argsort(-c)[:5] if c[x] >= 1 - reach * reach / 2]) for c in cos]
        hit = sum(len(w & set(place.tolist())) for w, (place, _) in zip(want, got))
        assert hit >= 0.95 * sum(map(len, want)) > 0
        for i, (place, score) in enumerate(got):
            assert np.allclose(score, cos[i][place]) and (np.diff(score) <= 0).all()
