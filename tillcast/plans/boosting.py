"""Gradient-boosted trees for many businesses and many fits in one run (M-04, M-05, M-13).

The training matrix is quantised once: every feature becomes a bin number
against the quantiles of its business, and the rows are kept as packed blocks
in the shared folder. One run grows all models - every (business, fit):

* A business of at most ``TASK_ROWS`` rows is grown where it lies: one Spark task
  per (business, fit) reads its blocks and grows the whole model.
* A larger business is grown level by level: each task sums residuals by
  (fit, node, feature, bin) over its blocks, the sums meet by (business, fit),
  and one split a node comes back to the driver. Predictions so far travel with
  the blocks as a persisted data set that is checkpointed to the shared folder
  every ``CHECKPOINT`` trees.

Both ways share the code that sums, picks and applies splits, and give the same
trees: residuals are summed as whole numbers (a fixed scale per business keeps
sums below 2^52), so a model depends neither on the order of the rows, nor on
how Spark deals them, nor on the other businesses in the run.

Fits are prefixes in time: a role column says which rows train (1) and which
are held out (2), so folds, evaluation and serving fits share the matrix.
Candidates that differ in the number of trees alone are one fit, measured at
each of their tree counts on the way.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, scratch_path, shared_dir, ship_package

TRAIN, HELD_OUT = 1, 2
BLOCK_ROWS = 16_384
TASK_ROWS = 1 << 19  # of a business that one task holds (bins of 28 features: about 15 MB)
MODELS = 4_096       # (business, fit) pairs whose splits are at the driver together
CHECKPOINT = 25
SALTS = 8  # a business's rows are scored in as many parts at least

MODEL_SCHEMA = ("grp string, fit int, tree int, feature array<int>, threshold array<double>, value array<double>, "
                "gain array<double>, start double, step double")
SCORE_SCHEMA = "grp string, fit int, trees int, role int, rows long, abs_error double, ape double, ape_rows long"


@dataclass(frozen=True)
class Fit:
    """One model to grow in every group: its parameters, the role column, and the tree counts to measure it at."""
    role: str
    depth: int = 6
    step: float = 0.1
    trees: tuple[int, ...] = (100,)
    min_rows: int = 1
    row_share: float = 1.0
    feature_share: float = 1.0
    min_gain: float = 0.0
    bins: int = 64
    seed: int = 42


@dataclass
class Grown:
    models: DataFrame  # MODEL_SCHEMA, of the fits to keep
    scores: DataFrame  # SCORE_SCHEMA, of all fits


# ------------------------------------------------------------------ blocks

def _edges(df: DataFrame, names: Sequence[str], bins: int) -> dict[str, dict]:
    """Per group: rows, scale of the label, and the split candidates of every feature."""
    q = [k / bins for k in range(1, bins)]
    got = df.groupBy("grp").agg(
        F.count("*").alias("rows"), F.max(F.abs("label")).alias("top"),
        *[F.array_union(F.array(F.min(n)), F.percentile_approx(n, q, 10_000)).alias(f"e{i}") for i, n in enumerate(names)]).collect()
    out = {}
    for r in got:
        top = max(1.0, 2.0 * (r["top"] or 0.0)) * max(r["rows"], 1)
        out[r["grp"]] = {"rows": r["rows"], "edges": [np.unique(np.array(r[f"e{i}"], float)) for i in range(len(names))],
                         "scale": 2.0 ** math.floor(math.log2(2.0 ** 51 / top)) if top < 2.0 ** 51 else 1.0}
    return out


def _cells(edges: list[np.ndarray]) -> tuple[np.ndarray, int]:
    """First cell of each feature and the number of cells: a feature has one more bin than edges."""
    start = np.concatenate([[0], np.cumsum([len(e) + 1 for e in edges])])
    return start[:-1], int(start[-1])


def _packed(rows: DataFrame, edges: dict[str, dict], n_roles: int):
    """Blocks (grp, part, payload) of at most BLOCK_ROWS rows of one group."""
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, []

        def block() -> pa.RecordBatch:
            x = np.concatenate([h[0] for h in held])
            e = edges[at]["edges"]
            kind = np.min_scalar_type(max(map(len, e)))  # a bin's number is at most the number of edges
            cells = np.stack([np.searchsorted(edge, x[:, f], "left").astype(kind) for f, edge in enumerate(e)])
            packed = {"cells": cells,  # a row per feature: the bin in it
                      "y": np.concatenate([h[1] for h in held]), "roles": np.concatenate([h[2] for h in held]),
                      "key": np.concatenate([h[3] for h in held])}
            return pa.RecordBatch.from_pydict({"grp": [at], "part": pa.array([int(packed["key"][0]) >> 1], pa.int64()),
                                               "payload": pa.array([pickle.dumps(packed, 5)], pa.binary())})
        for batch in batches:
            grp = batch.column(0).to_pylist()
            flat = lambda k, kind: batch.column(k).flatten().to_numpy(zero_copy_only=False).astype(kind)
            x = flat(1, float).reshape(len(grp), -1)
            y = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
            roles = flat(3, np.uint8).reshape(len(grp), n_roles)
            key = batch.column(4).to_numpy(zero_copy_only=False).astype(np.uint64)
            lo = 0
            while lo < len(grp):
                hi = lo
                while hi < len(grp) and grp[hi] == grp[lo]:
                    hi += 1
                room = BLOCK_ROWS - sum(len(h[1]) for h in held)
                if held and (grp[lo] != at or room <= 0):
                    yield block()
                    held, room = [], BLOCK_ROWS
                hi = min(hi, lo + room)
                at = grp[lo]
                held.append((x[lo:hi], y[lo:hi], roles[lo:hi], key[lo:hi]))
                lo = hi
        if held:
            yield block()
    return rows.mapInArrow(pack, "grp string, part long, payload binary")


_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def _drawn(key: np.ndarray, share: float, seed: int, tree: int) -> np.ndarray:
    """Whether a tree sees a row: a function of the row, the seed and the tree."""
    if share >= 1.0:
        return np.ones(len(key), bool)
    with np.errstate(over="ignore"):
        x = key + np.uint64(seed * 1_000_003 + tree + 1) * _MIX[0]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
    return (x ^ (x >> np.uint64(31))) < np.uint64(int(share * (2 ** 64 - 1)))


def _descend(cells: np.ndarray, node: np.ndarray, tree: dict) -> np.ndarray:
    """The heap nodes one level further down (rows stay where a tree has no split)."""
    f = tree["feature"][node]
    right = cells[np.maximum(f, 0), np.arange(len(node))] > tree["cell"][node]
    return np.where(f >= 0, 2 * node + 1 + right, node)


def _walk(cells: np.ndarray, tree: dict, depth: int) -> np.ndarray:
    node = np.zeros(cells.shape[1], np.int64)
    for _ in range(depth):
        node = _descend(cells, node, tree)
    return node


# ------------------------------------------------------------------ one level

def _sum_nodes(cells: np.ndarray, rest: np.ndarray, at: np.ndarray, nodes: int, first: np.ndarray, w: int, allowed: np.ndarray) -> np.ndarray:
    """[2, nodes, w]: residuals and rows by node and cell; ``at`` is a row's place among the nodes. Features that may
    not be split on stay 0, but for the first, which gives the nodes' totals."""
    out = np.zeros((2, nodes, w))
    ends = np.append(first[1:], w)
    base = {}
    for f in np.flatnonzero(allowed | (np.arange(len(first)) == 0)):
        n = int(ends[f] - first[f])
        if n not in base:
            base[n] = at * n
        index = base[n] + cells[f]  # of a feature's own cells alone: they are few, and no other's are touched
        out[0, :, first[f]:ends[f]] = np.bincount(index, rest, nodes * n).reshape(nodes, n)
        out[1, :, first[f]:ends[f]] = np.bincount(index, minlength=nodes * n).reshape(nodes, n)
    return out


def _open_places(tree: dict, level: int) -> np.ndarray:
    place = np.full(2 ** (level + 1) - 1, -1)
    place[tree["open"]] = np.arange(len(tree["open"]))
    return place


def _rest(block: dict, use: np.ndarray, so_far: np.ndarray, scale: float) -> np.ndarray:
    return np.rint((block["y"][use] - so_far[use]) * scale)


def _sums(blocks, fits: list[Fit], roles: dict[str, int], trees: dict, level: int, number: int, scale: dict, first: dict,
          width: dict, allowed: dict[int, np.ndarray]):
    """Partial sums of one partition: ((grp, fit), [2, open nodes, cells])."""
    out: dict = {}
    for grp, b in blocks:
        for k, fit in enumerate(fits):
            tree = trees.get((grp, k))
            if tree is None or not len(tree["open"]):
                continue
            use = np.flatnonzero((b["roles"][:, roles[fit.role]] == TRAIN) & _drawn(b["key"], fit.row_share, fit.seed, number))
            cells = b["cells"][:, use]
            at = _open_places(tree, level)[_walk(cells, tree, level)]
            inside = at >= 0
            if inside.any():
                sums = _sum_nodes(cells[:, inside], _rest(b, use[inside], b["so_far"][k], scale[grp]), at[inside],
                                  len(tree["open"]), first[grp], width[grp], allowed[k])
                key = grp, k
                out[key] = out[key] + sums if key in out else sums
    return iter(out.items())


def _best(sums: np.ndarray, fit: Fit, first: np.ndarray, scale: float, allowed: np.ndarray) -> dict:
    """The best split of each open node: by the reduction of squared error, the first of equals."""
    total, rows = (s[:, first[0]:first[1] if len(first) > 1 else None].sum(axis=1) for s in sums)
    n = len(total)
    best = {"gain": np.full(n, -1.0), "feature": np.full(n, -1), "cell": np.zeros(n, np.int64),
            "left": np.zeros(n), "left_rows": np.zeros(n), "total": total, "rows": rows}
    ends = np.append(first[1:], sums.shape[2])
    base = total * total / np.maximum(rows, 1)
    for f in np.flatnonzero(allowed):
        left, left_rows = (s[:, first[f]:ends[f]].cumsum(axis=1)[:, :-1] for s in sums)
        if not left.shape[1]:
            continue
        right, right_rows = total[:, None] - left, rows[:, None] - left_rows
        fits = (left_rows >= fit.min_rows) & (right_rows >= fit.min_rows)
        gain = np.where(fits, left * left / np.maximum(left_rows, 1) + right * right / np.maximum(right_rows, 1) - base[:, None], -1.0)
        at = gain.argmax(axis=1)
        row = np.arange(n)
        better = gain[row, at] > best["gain"]
        for name, value in (("gain", gain[row, at]), ("feature", np.full(n, f)), ("cell", at),
                            ("left", left[row, at]), ("left_rows", left_rows[row, at])):
            best[name] = np.where(better, value, best[name])
    enough = best["gain"] > np.maximum(fit.min_gain * rows * scale * scale, 1e-9 * np.abs(base))
    best["feature"] = np.where(enough, best["feature"], -1)
    return best


def _new_tree(depth: int) -> dict:
    size = 2 ** (depth + 1) - 1
    return {"feature": np.full(size, -1, np.int32), "cell": np.zeros(size, np.int64), "value": np.zeros(size),
            "gain": np.zeros(size), "open": np.zeros(1, np.int64)}


def _take(tree: dict, best: dict, fit: Fit, scale: float, level: int) -> None:
    """Write a level's splits into the tree; its open nodes become those of the next level."""
    node = tree["open"]
    if level == 0:
        tree["value"][0] = best["total"][0] / max(best["rows"][0], 1) / scale
    split = best["feature"] >= 0
    node, left, right = node[split], 2 * node[split] + 1, 2 * node[split] + 2
    tree["feature"][node], tree["cell"][node] = best["feature"][split], best["cell"][split]
    tree["gain"][node] = best["gain"][split] / (scale * scale)
    lr, rr = best["left_rows"][split], (best["rows"] - best["left_rows"])[split]
    tree["value"][left] = best["left"][split] / lr / scale
    tree["value"][right] = (best["total"] - best["left"])[split] / rr / scale
    if level + 1 < fit.depth:
        both, rows = np.concatenate([left, right]), np.concatenate([lr, rr])
        tree["open"] = np.sort(both[rows >= 2 * fit.min_rows])
    else:
        tree["open"] = np.zeros(0, np.int64)


# ------------------------------------------------------------------ whole fits

def _error(block: dict, so_far: np.ndarray, role: np.ndarray) -> np.ndarray:
    """Rows, sum of absolute errors, sum of absolute percentage errors and their rows (labels other than 0)."""
    use = block["roles"][:, role[0]] == role[1]
    y, off = block["y"][use], np.abs(block["y"][use] - so_far[use])
    some = y != 0
    return np.array([use.sum(), off.sum(), (off[some] / np.abs(y[some]) * 100).sum(), some.sum()])


def _errors(blocks, fits: list[Fit], roles: dict[str, int], which: list[int]):
    out: dict = {}
    for grp, b in blocks:
        for k in which:
            for r in (TRAIN, HELD_OUT):
                v = _error(b, b["so_far"][k], (roles[fits[k].role], r))
                out[grp, k, r] = out[grp, k, r] + v if (grp, k, r) in out else v
    return iter(out.items())


def _score_rows(found) -> list[tuple]:
    return [(g, k, trees, r, int(v[0]), float(v[1]), float(v[2]), int(v[3])) for (g, k, trees, r), v in found]


def _model_row(grp: str, k: int, number: int, tree: dict, edges: list[np.ndarray], start: float, step: float) -> tuple:
    cut = [float(edges[f][c]) if f >= 0 else 0.0 for f, c in zip(tree["feature"], tree["cell"])]
    return grp, k, number, tree["feature"].tolist(), cut, tree["value"].tolist(), tree["gain"].tolist(), start, step


def _columns(fit: Fit, n: int, number: int) -> np.ndarray:
    """The features a tree may split on."""
    ok = np.ones(n, bool)
    if fit.feature_share < 1.0:
        ok[np.random.default_rng([fit.seed, number]).permutation(n)[max(1, round(fit.feature_share * n)):]] = False
    return ok


def _grow_here(grp: str, k: int, fit: Fit, role: int, block: dict, edges: list[np.ndarray], scale: float):
    """One (business, fit) in one task: its model rows and its scores."""
    first, w = _cells(edges)
    train = np.flatnonzero(block["roles"][:, role] == TRAIN)
    if not len(train):
        return [], []
    total = np.rint(block["y"][train] * scale).sum()
    start = float(total / len(train) / scale)
    so_far = np.full(len(block["y"]), start)
    models, scores = [], []
    for number in range(max(fit.trees)):
        drawn = train[_drawn(block["key"][train], fit.row_share, fit.seed, number)]
        cells, rest = block["cells"][:, drawn], _rest(block, drawn, so_far, scale)
        tree, allowed, above = _new_tree(fit.depth), _columns(fit, len(edges), number), None
        node = np.zeros(len(drawn), np.int64)
        for level in range(fit.depth if len(drawn) else 0):
            at = _open_places(tree, level)[node]
            if above is None:
                sums = _sum_nodes(cells, rest, at, 1, first, w, allowed)
            else:
                sums = _sum_children(cells, rest, at, tree["open"], above, first, w, allowed)
            before = tree["open"]
            _take(tree, _best(sums, fit, first, scale, allowed), fit, scale, level)
            if not len(tree["open"]):
                break
            above = {"sums": sums, "place": dict(zip(before.tolist(), range(len(before))))}
            node = _descend(cells, node, tree)
            inside = np.isin(node, tree["open"])
            if not inside.all():
                cells, rest, node = cells[:, inside], rest[inside], node[inside]
        so_far = so_far + fit.step * tree["value"][_walk(block["cells"], tree, fit.depth)]
        models.append(_model_row(grp, k, number, tree, edges, start, fit.step))
        if number + 1 in fit.trees:
            scores += [((grp, k, number + 1, r), _error(block, so_far, (role, r))) for r in (TRAIN, HELD_OUT)]
    return models, _score_rows(scores)


def _sum_children(cells: np.ndarray, rest: np.ndarray, at: np.ndarray, nodes: np.ndarray, above: dict, first: np.ndarray, w: int,
                  allowed: np.ndarray) -> np.ndarray:
    """Sums of a level's nodes: of two siblings the smaller is summed, the other is what its parent has more (exact)."""
    n = len(nodes)
    rows = np.bincount(at, minlength=n)
    parent = (nodes - 1) // 2
    sibling = np.full(n, -1)
    pair = np.flatnonzero(parent[1:] == parent[:-1])  # nodes are sorted, siblings are neighbours
    sibling[pair], sibling[pair + 1] = pair + 1, pair
    derived = (sibling >= 0) & ((rows > rows[sibling]) | ((rows == rows[sibling]) & (np.arange(n) > sibling)))
    use = ~derived[at]
    sums = _sum_nodes(cells[:, use], rest[use], at[use], n, first, w, allowed) if use.any() else np.zeros((2, n, w))
    for i in np.flatnonzero(derived):
        sums[:, i] = above["sums"][:, above["place"][int(parent[i])]] - sums[:, sibling[i]]
    return sums


BOTH_SCHEMA = f"{MODEL_SCHEMA}, trees int, role int, rows long, abs_error double, ape double, ape_rows long"


def _grow_small(blocks: DataFrame, fits: list[Fit], roles: dict[str, int], edges: dict, keep: set[int]) -> DataFrame:
    """Model and score rows of businesses that fit a task: one task per (business, fit)."""
    groups = {g: i for i, g in enumerate(sorted(edges))}
    n = len(groups) * len(fits)
    schema = T.StructType.fromDDL(BOTH_SCHEMA)
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema
        arrow = to_arrow_schema(schema)
        at, held = None, []

        def finished() -> Iterator[pa.RecordBatch]:
            if not held:
                return
            grp, k = at
            block = {c: np.concatenate([h.pop(c) for h in held], axis=1 if c == "cells" else 0) for c in list(held[0])}
            models, scores = _grow_here(grp, k, fits[k], roles[fits[k].role], block, edges[grp]["edges"], edges[grp]["scale"])
            rows = [dict(zip(names[:9], m)) for m in models if k in keep]
            rows += [dict(zip(("grp", "fit", "trees", "role", "rows", "abs_error", "ape", "ape_rows"), x)) for x in scores]
            yield pa.RecordBatch.from_pylist([{c: r.get(c) for c in names} for r in rows], arrow)
        for batch in batches:
            for i in range(batch.num_rows):
                grp, k, payload = (batch.column(c)[i] for c in range(3))
                if (grp.as_py(), k.as_py()) != at:
                    yield from finished()
                    at, held = (grp.as_py(), k.as_py()), []
                held.append(pickle.loads(payload.as_buffer()))
        yield from finished()
    # The longest fits begin first: of equal ones those of later roles, which hold more rows.
    longest = sorted(range(len(fits)), key=lambda k: (-max(fits[k].trees) * fits[k].depth, -roles[fits[k].role]))
    place = F.array(*[F.lit(longest.index(k)) for k in range(len(fits))])[F.col("fit")]
    number = place * len(groups) + F.create_map(*[F.lit(x) for g, i in groups.items() for x in (g, i)])[F.col("grp")]
    every = blocks.select("grp", F.explode(F.array(*[F.lit(k) for k in range(len(fits))])).alias("fit"), "part", "payload")
    return (every.withColumn("task", number).repartitionByRange(n, "task").sortWithinPartitions("task", "part")
            .select("grp", "fit", "payload").mapInArrow(run, schema))


def grow(df: DataFrame, names: Sequence[str], label: str, fits: Sequence[Fit], keep: Sequence[int], group: str | None = None) -> Grown:
    """Grow every fit in every group; the models of the fits in ``keep`` are written, all are measured.

    ``df`` holds the features, the label and the fits' role columns (1 trains, 2 is
    held out, else unused). ``group`` NULL or absent: one model over all rows.
    """
    spark = df.sparkSession
    ship_package(spark)
    shared_dir(spark)  # sets the checkpoint folder
    fits = list(fits)
    role_names = list(dict.fromkeys(f.role for f in fits))
    roles = {r: i for i, r in enumerate(role_names)}
    grp = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    flat = df.select(grp.alias("grp"), F.col(label).cast("double").alias("label"), *[F.col(n).cast("double").alias(n) for n in names],
                     F.array(*[F.coalesce(F.col(r).cast("int"), F.lit(0)) for r in role_names]).alias("__roles"),
                     F.xxhash64(*[F.col(c) for c in df.columns]).alias("__key")).where(F.col("label").isNotNull())
    flat = cut_lineage(flat, "matrix")
    edges = _edges(flat, names, max(f.bins for f in fits))
    path = scratch_path(spark, "trees")
    spark.createDataFrame([], BOTH_SCHEMA).write.parquet(path)
    small = {g: e for g, e in edges.items() if e["rows"] <= TASK_ROWS}
    large = sorted(edges.keys() - small.keys())
    for part in _parts(sorted(small), len(fits)):
        held = {g: edges[g] for g in part}
        blocks = cut_lineage(_packed(_dealt(spark, _of(flat, part, edges), names, 1), held, len(roles)), "blocks")
        _grow_small(blocks, fits, roles, held, set(keep)).write.mode("append").parquet(path)
    for part in _parts(large, len(fits)):
        models, scores = _grow_levels(spark, _of(flat, part, edges), names, fits, roles, {g: edges[g] for g in part}, set(keep))
        spark.createDataFrame(models, MODEL_SCHEMA).write.mode("append").parquet(path)
        spark.createDataFrame(scores, SCORE_SCHEMA).write.mode("append").parquet(path)
    out = spark.read.schema(BOTH_SCHEMA).parquet(path)
    columns = lambda schema: T.StructType.fromDDL(schema).fieldNames()
    return Grown(out.where("tree IS NOT NULL").select(*columns(MODEL_SCHEMA)), out.where("role IS NOT NULL").select(*columns(SCORE_SCHEMA)))


def _parts(groups: list[str], n_fits: int) -> Iterator[list[str]]:
    together = max(1, MODELS // max(1, n_fits))
    for lo in range(0, len(groups), together):
        yield groups[lo:lo + together]


def _of(flat: DataFrame, part: list[str], edges: dict) -> DataFrame:
    return flat if len(part) == len(edges) else flat.where(F.col("grp").isin(*part))


def _dealt(spark: SparkSession, flat: DataFrame, names: Sequence[str], salts: int) -> DataFrame:
    return flat.select("grp", F.array(*names).alias("x"), "label", "__roles", "__key").repartition(
        int(spark.conf.get("spark.sql.shuffle.partitions")), "grp", F.pmod("__key", F.lit(salts))).sortWithinPartitions("grp", "__key")


def _grow_levels(spark: SparkSession, flat: DataFrame, names: Sequence[str], fits: list[Fit], roles: dict[str, int], edges: dict, keep: set[int]):
    partitions = max(1, min(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism))
    first = {g: _cells(e["edges"])[0] for g, e in edges.items()}
    width = {g: _cells(e["edges"])[1] for g, e in edges.items()}
    scale = {g: e["scale"] for g, e in edges.items()}
    written = cut_lineage(_packed(_dealt(spark, flat, names, partitions), edges, len(roles)), "blocks").select("grp", "payload").rdd
    if written.getNumPartitions() != partitions:
        written = written.repartition(partitions)
    blocks = written.map(lambda r: (r[0], pickle.loads(r[1])))

    def starts(part):
        sums: dict = {}
        for g, b in part:
            for k, fit in enumerate(fits):
                use = b["roles"][:, roles[fit.role]] == TRAIN
                v = np.array([np.rint(b["y"][use] * scale[g]).sum(), use.sum()])
                sums[g, k] = sums[g, k] + v if (g, k) in sums else v
        return iter(sums.items())
    begun = dict(blocks.mapPartitions(starts).reduceByKey(np.add, partitions).collect())
    start = {key: s / max(n, 1) / scale[key[0]] for key, (s, n) in begun.items()}
    trained = {key for key, (_, n) in begun.items() if n}

    def begin(row):
        g, b = row
        return g, b | {"so_far": [np.full(len(b["y"]), start[g, k]) for k in range(len(fits))]}
    state = blocks.map(begin).persist(StorageLevel.MEMORY_AND_DISK)
    older, models, scores = [], [], []
    most = [max(f.trees) for f in fits]
    for number in range(max(most)):
        live = [k for k in range(len(fits)) if number < most[k]]
        trees = {(g, k): _new_tree(fits[k].depth) for g, k in sorted(trained) if k in live}
        allowed = {k: _columns(fits[k], len(names), number) for k in live}
        for level in range(max(fits[k].depth for k in live)):
            growing = {key: {n: t[n] for n in ("feature", "cell", "open")} for key, t in trees.items() if len(t["open"])}
            if not growing:
                break
            found = (state.mapPartitions(lambda part, t=growing, at=level, no=number, ok=allowed: _sums(
                part, fits, roles, t, at, no, scale, first, width, ok))
                     .reduceByKey(np.add, partitions)
                     .map(lambda kv, ok=allowed: (kv[0], _best(kv[1], fits[kv[0][1]], first[kv[0][0]], scale[kv[0][0]], ok[kv[0][1]])))
                     .collect())
            done = set()
            for (g, k), best in found:
                _take(trees[g, k], best, fits[k], scale[g], level)
                done.add((g, k))
            for key in growing.keys() - done:  # no row of the sample came here
                trees[key]["open"] = np.zeros(0, np.int64)
        if number:
            for old in older:
                old.unpersist()
        older = [state]

        def add(row, trees=trees):
            g, b = row
            so_far = list(b["so_far"])
            for k, fit in enumerate(fits):
                if (g, k) in trees:
                    t = trees[g, k]
                    so_far[k] = so_far[k] + fit.step * t["value"][_walk(b["cells"], t, fit.depth)]
            return g, b | {"so_far": so_far}
        state = state.map(add).persist(StorageLevel.MEMORY_AND_DISK)
        if (number + 1) % CHECKPOINT == 0:
            state.checkpoint()
        models += [_model_row(g, k, number, t, edges[g]["edges"], float(start[g, k]), fits[k].step)
                   for (g, k), t in trees.items() if k in keep]
        measured = [k for k in live if number + 1 in fits[k].trees]
        if measured:
            found = state.mapPartitions(lambda part, w=measured: _errors(part, fits, roles, w)).reduceByKey(np.add, partitions).collect()
            scores += _score_rows(((g, k, number + 1, r), v) for (g, k, r), v in found)
    for old in [*older, state]:
        old.unpersist()
    return models, scores


# ------------------------------------------------------------------ scoring

def predict(frame: DataFrame, models: DataFrame, names: Sequence[str], group: str | None = None,
            prediction: str = "prediction") -> DataFrame:
    """``frame`` with the prediction of its group's model (NULL where the group has none).

    ``models``: one fit's rows of MODEL_SCHEMA. Every group's trees go ahead of its
    rows, in ``SALTS`` parts, so neither a large group nor many groups meet in one task.
    """
    spark = frame.sparkSession
    ship_package(spark)
    grp = F.coalesce(F.col(group).cast("string"), F.lit("")) if group else F.lit("")
    kept = frame.columns
    tree = F.struct(*[models[c] for c in ("tree", "feature", "threshold", "value", "start", "step")])
    rows = frame.select(grp.alias("g"), F.pmod(F.xxhash64(*kept), F.lit(SALTS)).cast("int").alias("salt"), F.lit(1).alias("kind"),
                        F.array(*[F.col(n).cast("double") for n in names]).alias("x"), F.struct(*kept).alias("row"))
    rows = rows.withColumn("t", F.lit(None).cast(T.StructType(models.select(tree.alias("t")).schema["t"].dataType.fields)))
    trees = models.select(F.col("grp").alias("g"), F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"),
                          F.lit(0).alias("kind"), F.lit(None).cast("array<double>").alias("x"),
                          F.lit(None).cast(rows.schema["row"].dataType).alias("row"), tree.alias("t"))
    out = T.StructType([*frame.schema.fields, T.StructField(prediction, T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, forest, packed = None, [], None
        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            kinds = batch.column(2).to_numpy()
            lo = 0
            while lo < len(keys):
                hi = lo
                while hi < len(keys) and keys[hi] == keys[lo] and kinds[hi] == kinds[lo]:
                    hi += 1
                if keys[lo] != at:
                    at, forest, packed = keys[lo], [], None
                part = batch.slice(lo, hi - lo)
                if kinds[lo] == 0:
                    forest += part.column(5).to_pylist()
                else:
                    if packed is None and forest:
                        packed = _stack(forest)
                    x = np.array(part.column(3).to_pylist(), float).reshape(hi - lo, -1)
                    value = pa.array(_score(x, packed), pa.float64()) if packed else pa.nulls(hi - lo, pa.float64())
                    yield pa.RecordBatch.from_arrays([*part.column(4).flatten(), value], names=[*kept, prediction])
                lo = hi
    return (rows.unionByName(trees.select(*rows.columns)).repartition("g", "salt").sortWithinPartitions("g", "salt", "kind")
            .mapInArrow(run, out))


def _stack(forest: list[dict]) -> dict:
    forest = sorted(forest, key=lambda t: t["tree"])
    return {"start": forest[0]["start"], "step": forest[0]["step"],
            **{n: [np.array(t[n]) for t in forest] for n in ("feature", "threshold", "value")}}


def _score(x: np.ndarray, forest: dict) -> np.ndarray:
    out = np.full(len(x), forest["start"])
    row = np.arange(len(x))
    for feature, threshold, value in zip(forest["feature"], forest["threshold"], forest["value"]):
        node = np.zeros(len(x), np.int64)
        for _ in range((len(feature) + 1).bit_length() - 2):
            f = feature[node]
            # As in the bins, what compares with nothing (NaN) lies right of every edge.
            right = ~(x[row, np.maximum(f, 0)] <= threshold[node])
            node = np.where(f >= 0, 2 * node + 1 + right, node)
        out = out + forest["step"] * value[node]
    return out


def importance(models: DataFrame, names: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """Share of each feature in the reduction of squared error (every feature has a row, sums are 1)."""
    pair = F.explode(F.arrays_zip("feature", "gain")).alias("s")
    used = models.select(*by, pair).where("s.feature >= 0").groupBy(*by, F.col("s.feature").alias("f")).agg(F.sum("s.gain").alias("g"))
    every = (models.select(*by).distinct() if by else models.limit(1).select()).select(
        *by, F.posexplode(F.array(*[F.lit(n) for n in names])).alias("f", "feature"))
    whole = used.groupBy(*by).agg(F.sum("g").alias("all"))
    joined = every.join(used, [*by, "f"], "left")
    joined = joined.join(whole, list(by)) if by else joined.join(whole, F.lit(True), "left")
    return joined.select(*by, "feature", F.coalesce(F.col("g") / F.col("all"), F.lit(0.0)).alias("importance"))
