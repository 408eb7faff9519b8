"""Approximate nearest neighbours by collision counting (operator 13).

``PROJECTIONS`` random directions each give a sorted array of the (unit)
vectors' projections. For a query a window is centred on the query's own
projection in every array; a vector inside the window collides in that array.
Windows are widened by virtual rehashing: radius R grows by ``GROWTH`` a step,
the window's half width is R * WIDTH / 2, and only the newly covered stretches
of the arrays are counted. A vector with at least ``threshold()`` collisions is
verified: its exact cosine to the query is computed. The search ends when k
verified vectors lie within distance R of the query.

Two unit vectors at distance s <= R differ by N(0, s^2) in a projection, so
they collide in each array with probability at least p = 2 * Phi(WIDTH / 2) - 1.
The threshold is the ``MISS`` quantile of Binomial(PROJECTIONS, p): when a
search ends, a true neighbour has been verified with probability 1 - MISS or
more, whatever the data. At R = 2 windows have met all there is; should fewer
than k vectors have been verified then, all others are (the exact way for the
rest), so no result is short.

The arrays are kept per block of vectors, written once beside them. A query
searches its own block so. The distance R of its k-th there bounds that of its
k nearest in the whole table, so in every other block the window of this one
radius is counted, or what lies outside it, if that is less. A ranking merges
the blocks' k best. As one vector in 50 is a query and every query meets every
block, the number of windows grows with the square of the vectors; a task holds
one block and ``CHUNK`` queries.
Hot vectors are spread over the blocks; ties have bit-equal scores, as a row's
cosine does not depend on its neighbours in memory.

Edge cases: vectors that are NULL, zero (or empty) or hold a NULL or
non-finite component take no part. Shorter vectors count as filled with zeros.
Repeated rows are rows of their own; a query skips only its own row. A NULL id
is no query and comes last among ties. Fewer than k candidates are all
returned; an empty table gives an empty result. Other columns are not read, so
their names cannot clash.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.session import cut_lineage

from . import vectors
from .common import prepare, table

# Fixed values of the contract.
QUERY_EVERY = 50
NEIGHBOURS = 5

PROJECTIONS = 64
WIDTH = 2.0
MISS = 0.01
START, GROWTH = 0.125, 1.2
SEED = 20_13
CHUNK = 256
CHUNKED = 4_096
SLACK = 1e-9  # of cosines, for the order of additions

HOME = "block long, at long, id long, vec binary, reach double, near_id array<long>, near array<double>"
FOUND = "block long, at long, query_id long, vec_id long, score double"


def threshold(m: int = PROJECTIONS, width: float = WIDTH, miss: float = MISS) -> int:
    """The most collisions that a vector within the radius has with probability 1 - miss."""
    p, below = math.erf(width / 2 / math.sqrt(2)), 0.0
    for count in range(m + 1):
        below += math.comb(m, count) * p ** count * (1 - p) ** (m - count)
        if below > miss:
            return count
    return m


def radii() -> list[float]:
    steps = math.ceil(math.log(2 / START) / math.log(GROWTH))
    return [min(2.0, START * GROWTH ** i) for i in range(steps + 1)]


def directions(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED).standard_normal((dim, PROJECTIONS))


def scaled(v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows times a power of two (their cosines do not change), so that squares neither overflow nor vanish; norms."""
    _, exponent = np.frexp(np.abs(v).max(axis=1, initial=0.0))
    v = np.ldexp(v, -exponent[:, None])
    return v, np.sqrt((v * v).sum(axis=1))


def index(v: np.ndarray) -> dict:
    """The sorted arrays of a block."""
    v, norm = scaled(v)
    projected = (v / norm[:, None]) @ directions(v.shape[1])
    order = np.argsort(projected, axis=0, kind="stable").T.astype(np.int32)
    return {"order": order, "sorted": np.take_along_axis(projected, order.T, 0).T.copy()}


def _windows(block: dict, centre: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Window ends (array, query, radius) around every query's projections; ``half``: the radii's half widths, query by query."""
    return tuple(np.stack([np.searchsorted(s, c[:, None] + sign * half, side) for s, c in zip(block["sorted"], centre.T)])
                 for sign, side in ((-1, "left"), (1, "right")))


def search(block: dict, vecs: np.ndarray, own: np.ndarray, reach: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """The best NEIGHBOURS (places, cosines) of each query among the block's vectors that collide often enough.

    ``own``: the query's place in the block, or -1. ``reach``: a distance within
    which the query has NEIGHBOURS already, so that one radius will do; NaN: none yet.
    """
    v, norm = scaled(block["vecs"])
    q, q_norm = scaled(vecs)
    n, need = len(v), threshold()
    centre = (q / q_norm[:, None]) @ directions(q.shape[1])

    def first(i: int, place: np.ndarray, cosine: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if len(found) > NEIGHBOURS:  # a quick product tells which can be among the first; those get the score that ties rely on
            near = (v.take(found, axis=0) @ q[i]) / (norm[found] * q_norm[i])
            floor = max(np.partition(near, -NEIGHBOURS)[-NEIGHBOURS], cosine[-1] if len(cosine) == NEIGHBOURS else -2.0,
                        -2.0 if np.isnan(reach[i]) else 1 - reach[i] * reach[i] / 2)
            found = found[near >= floor - SLACK]
        c = (v[found] * q[i]).sum(axis=1) / (norm[found] * q_norm[i])
        return _first(np.concatenate([place, found]), np.concatenate([cosine, c]), block["ids"])

    def widened(i: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        wanted = min(NEIGHBOURS, n - (own[i] >= 0))
        count = np.zeros(n, np.int64)
        fresh = np.ones(n, bool)
        if own[i] >= 0:
            fresh[own[i]] = False
        place, cosine = np.zeros(0, np.int64), np.zeros(0)
        for step, radius in enumerate(radii()):
            inner, outer = (start[:, step - 1], end[:, step - 1]) if step else (end[:, 0], end[:, 0])
            met = [o[a:b] for o, a, b in zip(block["order"], start[:, step], inner)]
            met += [o[a:b] for o, a, b in zip(block["order"], outer, end[:, step])]
            count += np.bincount(np.concatenate(met), minlength=n)
            found = np.flatnonzero((count >= need) & fresh)
            if len(found):
                fresh[found] = False
                place, cosine = first(i, place, cosine, found)
            if len(place) >= wanted and (not wanted or cosine[-1] >= 1 - radius * radius / 2):
                break
        if len(place) < wanted:
            place, cosine = first(i, place, cosine, np.flatnonzero(fresh))
        return place, cosine

    def within(i: int, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        # The smaller of a window and what lies outside it is counted.
        if 2 * int((end - start).sum()) <= n * PROJECTIONS:
            count = np.bincount(np.concatenate([o[a:b] for o, a, b in zip(block["order"], start, end)]), minlength=n)
        else:
            out = [o[:a] for o, a in zip(block["order"], start)] + [o[b:] for o, b in zip(block["order"], end)]
            count = PROJECTIONS - np.bincount(np.concatenate(out), minlength=n)
        count[own[i]:own[i] + 1] = 0  # its own row, if it is here
        return first(i, np.zeros(0, np.int64), np.zeros(0), np.flatnonzero(count >= need))

    out: list = [None] * len(q)
    for some, work in ((np.flatnonzero(np.isnan(reach)), widened), (np.flatnonzero(~np.isnan(reach)), within)):
        if not len(some):
            continue
        half = np.array([radii()] * len(some)) if work is widened else reach[some, None]
        lo, hi = _windows(block, centre[some], half * WIDTH / 2)
        for j, i in enumerate(some.tolist()):
            ends = (lo[:, j], hi[:, j]) if work is widened else (lo[:, j, 0], hi[:, j, 0])
            out[i] = work(i, *ends)
    return out


def _home(blocks: DataFrame) -> DataFrame:
    """The queries, each with its nearest in its own block, and their reach."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, p in vectors.payloads(batches, "block"):
            every = np.flatnonzero((p["ids"] % QUERY_EVERY == 0) & (p["ids"] != vectors.NO_ID))
            for lo in range(0, len(every), CHUNK):
                at = every[lo:lo + CHUNK]
                got = search(p, p["vecs"][at], at, np.full(len(at), np.nan))
                # The last one's distance, with room for rounding; NaN where there are fewer.
                reach = [math.sqrt(max(0.0, 2 - 2 * c[-1])) + 1e-7 if len(c) == NEIGHBOURS else math.nan for _, c in got]
                edge = pa.array(np.cumsum([0, *(len(x) for x, _ in got)]), pa.int32())
                yield pa.RecordBatch.from_pydict({
                    "block": pa.array(np.full(len(at), block)), "at": pa.array(at), "id": pa.array(p["ids"][at]),
                    "vec": pa.array([x.tobytes() for x in p["vecs"][at]], pa.binary()), "reach": pa.array(reach, pa.float64()),
                    "near_id": pa.ListArray.from_arrays(edge, vectors.id_array(p["ids"][np.concatenate([x for x, _ in got])])),
                    "near": pa.ListArray.from_arrays(edge, pa.array(np.concatenate([c for _, c in got])))})
    return blocks.mapInArrow(run, HOME)


def _away(number: int, block: dict, chunk: dict) -> pa.RecordBatch | None:
    """The best of the block for the queries of other blocks."""
    some = np.flatnonzero(chunk["block"] != number)
    if not len(some):
        return None
    got = search(block, chunk["vecs"][some], np.full(len(some), -1), chunk["reach"][some])
    i, place = np.repeat(some, [len(x) for x, _ in got]), np.concatenate([x for x, _ in got])
    return pa.RecordBatch.from_pydict({
        "block": chunk["block"][i], "at": chunk["at"][i], "query_id": chunk["ids"][i],
        "vec_id": vectors.id_array(block["ids"][place]), "score": np.concatenate([c for _, c in got])})


def _first(place: np.ndarray, cosine: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.lexsort((ids[place], -cosine))[:NEIGHBOURS]
    return place[order], cosine[order]


def _chunks(queries: DataFrame, count: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, CHUNK):
                part = batch.slice(lo, CHUNK)
                of = lambda name: part.column(part.schema.get_field_index(name))
                yield pa.RecordBatch.from_pydict({"payload": pa.array([vectors.dump(
                    block=of("block").to_numpy(), at=of("at").to_numpy(), ids=of("id").to_numpy(), vecs=vectors.matrix(of("vec")),
                    reach=of("reach").to_numpy())],
                    pa.binary())})
    return queries.repartition(max(1, count // CHUNKED)).mapInArrow(run, "payload binary")


def nearest(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the neighbours found of every row whose id is divisible by QUERY_EVERY."""
    prepare(df.sparkSession)
    vec = F.col(vec_col)
    rows = df.where(vectors.finite(vec) & F.exists(vec, lambda x: x != 0)).select(
        F.col(id_col).cast("long").alias("id"), F.lit(0).cast("long").alias("label"), vec.cast("array<double>").alias("vec"))
    blocks, n_blocks = vectors.pack(rows, index)
    blocks = cut_lineage(blocks, "vectors")
    queries = cut_lineage(_home(blocks), "queries")
    away = vectors.meet(blocks, n_blocks, _chunks(queries.drop("near_id", "near"), queries.count()), _away, FOUND)
    home = queries.select("block", "at", F.col("id").alias("query_id"), F.explode(F.arrays_zip("near_id", "near")).alias("x"))
    found = away.unionByName(home.select("block", "at", "query_id", F.col("x.near_id").alias("vec_id"), F.col("x.near").alias("score")))
    return vectors.best(found, ["block", "at"], "score", "vec_id", NEIGHBOURS, "rank").select("query_id", "rank", "vec_id", "score")


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
