"""Mixing sources to target weights by pivotal dependent rounding (operator 10).

A source's target divided by its words is the expected number of copies of
each of its documents. The whole part is taken outright; the fraction is
rounded by the pivotal method: two documents of a source exchange mass at
random, keeping the number of words (fraction x size) of the pair, until one
fraction is 0 or 1. Every document's expected number of copies is kept, and a
source's taken words can miss its target only by the last unpaired document.

Spark deals the documents by a hash of their content into buckets of about
``BUCKET_ROWS`` rows; each bucket settles all but one document per source, and
the unsettled ones are paired again in a reduction tree of ``FANIN`` buckets a
node (a node holds at most FANIN x sources rows). A hot source is spread over
all buckets. Pairs and draws depend only on document values and the seed, not
on how Spark splits the rows: reruns agree.

Target rule: sources in code-point order (NULL last) weigh 3, 1, 2, repeating,
and share ``share`` of all words; a source stops at ``most`` times its own
words, its excess is shared again by weight until none is above.

Edge cases: NULL or empty texts have size 0 and are never taken; an all-empty
source has target 0; repeated documents are rounded one by one; NULL doc_ids
are kept; an empty table gives an empty mix.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.session import cut_lineage

from .common import prepare, table

# Fixed values of the contract.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0

BUCKET_ROWS = 20_000
FANIN = 16
MAX_SOURCES = 1_000_000  # one row per source goes through the driver for the target rule


def targets(sizes: list[tuple[str | None, int]], share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Target words of each source."""
    order = sorted(sizes, key=lambda x: (x[0] is None, x[0] or ""))
    weight = {name: WEIGHTS[i % len(WEIGHTS)] for i, (name, _) in enumerate(order)}
    size, out = dict(order), {}
    left, free = share * sum(size.values()), [name for name, _ in order]
    while free:
        unit = left / sum(weight[n] for n in free)
        full = [n for n in free if unit * weight[n] > most * size[n]]
        if not full:
            return out | {n: unit * weight[n] for n in free}
        for n in full:
            out[n] = most * size[n]
            left -= out[n]
        free = [n for n in free if n not in out]
    return out


def _settle(mass: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> int | None:
    """Pivotal rounding in place, in row order; the index of the row left over, if any."""
    draws = rng.random(len(mass))
    i = None
    for j in range(len(mass)):
        if not 0.0 < mass[j] < 1.0:
            continue
        if i is None:
            i = j
            continue
        a, b, x, y = size[i], size[j], mass[i], mass[j]
        up, down = min(a * (1 - x), b * y), min(a * x, b * (1 - y))  # words that may move to or from i
        if draws[j] * (up + down) < down:
            if a * (1 - x) <= b * y:
                mass[i], mass[j] = 1.0, y - up / b
            else:
                mass[i], mass[j] = x + up / a, 0.0
        elif a * x <= b * (1 - y):
            mass[i], mass[j] = 0.0, y + down / b
        else:
            mass[i], mass[j] = x - down / a, 1.0
        for k in (i, j):  # rounding noise next to 0 or 1 is settled
            if mass[k] < 1e-12 or mass[k] > 1 - 1e-12:
                mass[k] = round(mass[k])
        i = i if 0.0 < mass[i] < 1.0 else j if 0.0 < mass[j] < 1.0 else None
    return i


def _settle_sources(rows: pd.DataFrame, seed: str) -> pd.DataFrame:
    """One bucket or tree node: every source of it on its own."""
    mass, size = rows["mass"].to_numpy(copy=True), rows["size"].to_numpy(float)
    for source, at in rows.groupby("source", dropna=False, sort=True).indices.items():
        key = hashlib.blake2b(f"{seed}|{source}".encode(), digest_size=8).digest()
        part = mass[at]
        _settle(part, size[at], np.random.default_rng(int.from_bytes(key, "little")))
        mass[at] = part
    return rows.assign(mass=mass)


def _combiner(seed: int, level: int, last: bool):
    def combine(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["bucket", "place"], kind="stable").reset_index(drop=True)
        out = _settle_sources(part, f"{seed}|{level}|{key[0]}")
        return out.assign(mass=out["mass"].round()) if last else out  # nothing is left to pair the last one with
    return combine


def mix(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
        share: float = SHARE, most: float = MOST, seed: int = 0, keep: list[str] | None = None) -> DataFrame:
    """doc_id, size, source_size, target, copies, taken of every document; ``keep``: further columns to carry."""
    spark = docs.sparkSession
    prepare(spark)
    keep = keep or []
    rows = cut_lineage(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), *keep,
        F.coalesce(F.regexp_count(text_col, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
        F.xxhash64(text_col, id_col).alias("deal")), "mix-sizes")
    per_source = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    if per_source.count() > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} sources")
    totals = [(r.source, r.source_size, r.n) for r in per_source.collect()]
    goal = targets([(s, n) for s, n, _ in totals], share, most)
    plan = spark.createDataFrame([(s, n, float(goal[s])) for s, n, _ in totals],
                                 "s string, source_size long, target double")
    buckets = max(1, -(-sum(n for _, _, n in totals) // BUCKET_ROWS))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    dealt = (rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("s"))).drop("s")  # at most MAX_SOURCES rows
             .withColumn("whole", F.floor(rate)).withColumn("mass", F.when(F.col("size") > 0, rate - F.floor(rate)).otherwise(0.0))
             .withColumn("bucket", F.pmod("deal", F.lit(buckets))))
    level0 = T.StructType([*dealt.schema.fields, T.StructField("place", T.LongType())])

    def first(key, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["deal", "doc_id", "size"], kind="stable").reset_index(drop=True)
        return _settle_sources(part, f"{seed}|0|{key[0]}").assign(place=np.arange(len(part)))

    settled = cut_lineage(dealt.groupBy("bucket").applyInPandas(first, level0), "mix-level0")
    open_rows = (F.col("mass") > 0) & (F.col("mass") < 1)
    node_schema = "bucket long, place long, source string, size long, mass double, node long"
    left = settled.where(open_rows).select("bucket", "place", "source", "size", "mass", F.col("bucket").alias("node"))
    decided, nodes, level = None, buckets, 0
    while True:
        nodes, level = -(-nodes // FANIN), level + 1
        last = nodes == 1

        left = left.withColumn("node", F.floor(F.col("node") / FANIN))
        done = cut_lineage(left.groupBy("node").applyInPandas(_combiner(seed, level, last), node_schema), f"mix-level{level}")
        fixed = done.where(~open_rows).select("bucket", "place", F.col("mass").alias("settled"))
        decided = fixed if decided is None else decided.unionByName(fixed)
        if last:
            break
        left = done.where(open_rows)
    copies = (F.col("whole") + F.coalesce("settled", "mass")).cast("long")
    return (settled.join(decided, ["bucket", "place"], "left")
            .select("doc_id", "source", *keep, "size", "source_size", "target", copies.alias("copies"),
                    (copies * F.col("size")).alias("taken")))


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")
