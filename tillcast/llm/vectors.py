"""Vectors in blocks, and a stated set of queries held against all of them.

``pack`` deals the rows round robin into blocks of at most ``MAX_ROWS`` rows (a
hot vector or label is spread like any other) and turns each into one row of
arrays; a row is named by its block and place, so repeated rows stay apart.
``meet`` sends every chunk of queries to every block and lets a function work
on one (block, chunk) at a time: a task holds one block and one chunk, whatever
the number of rows, and returns what is worth merging.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MIN_ROWS = 4_096     # a block has this many rows, unless the table has fewer
MAX_ROWS = 1 << 18
BLOCKS = 64          # from MIN_ROWS on the blocks grow with the table, until MAX_ROWS
NO_ID = np.iinfo(np.int64).max  # NULL ids come after all others

PACKED = "block long, payload binary"
QUERY = "block long, at long, id long, label long, vec binary"


def finite(vec: Column) -> Column:
    """The vector is there and has finite components only."""
    return vec.isNotNull() & F.forall(vec, lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False)))


def dump(**arrays) -> bytes:
    return pickle.dumps(arrays, protocol=5)


def stacked(batches: list[pa.RecordBatch], dim: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids (NULL: ``NO_ID``), labels and vectors (shorter ones are filled with zeros)."""
    rows = pa.Table.from_batches(batches)
    ids = rows["id"].combine_chunks().fill_null(int(NO_ID)).to_numpy(zero_copy_only=False)
    labels = rows["label"].combine_chunks().fill_null(0).to_numpy(zero_copy_only=False)
    vec = rows["vec"].combine_chunks()
    lengths = vec.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(ids), dim))
    out[np.arange(dim) < lengths[:, None]] = vec.flatten().to_numpy(zero_copy_only=False)
    return ids, labels, out


def pack(df: DataFrame, index: Callable[[np.ndarray], dict]) -> tuple[DataFrame, int]:
    """One row per block of ``df`` (id, label, vec) and the number of blocks.

    The payload holds ids, labels, vecs and what ``index`` makes of the vectors.
    """
    rows, dim = df.agg(F.count("*"), F.max(F.size("vec"))).first()
    size = min(max(-(-rows // BLOCKS), MIN_ROWS), MAX_ROWS)
    n_blocks, dim = max(1, -(-rows // size)), dim or 0

    def one_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext
        got = [b for b in batches if b.num_rows]
        if got:
            ids, labels, vecs = stacked(got, dim)
            yield pa.RecordBatch.from_pydict({
                "block": pa.array([TaskContext.get().partitionId()], pa.int64()),
                "payload": pa.array([dump(ids=ids, labels=labels, vecs=vecs, **index(vecs))], pa.binary())})
    return df.repartition(n_blocks).mapInArrow(one_block, PACKED), n_blocks


def payloads(batches: Iterator[pa.RecordBatch], *others: str) -> Iterator[tuple]:
    """Row by row: the other columns' values, the payload's arrays."""
    for batch in batches:
        columns = [batch.column(batch.schema.get_field_index(c)) for c in (*others, "payload")]
        for i in range(batch.num_rows):
            *values, packed = [c[i].as_py() for c in columns]
            yield *values, pickle.loads(packed)


def every(blocks: DataFrame, nth: int) -> DataFrame:
    """The rows of the blocks whose id is divisible by ``nth``."""
    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block, p in payloads(batches, "block"):
            at = np.flatnonzero((p["ids"] % nth == 0) & (p["ids"] != NO_ID))
            yield pa.RecordBatch.from_pydict({
                "block": pa.array(np.full(len(at), block)), "at": pa.array(at), "id": pa.array(p["ids"][at]),
                "label": pa.array(p["labels"][at]), "vec": pa.array([v.tobytes() for v in p["vecs"][at]], pa.binary())})
    return blocks.mapInArrow(pick, QUERY)


def matrix(column: pa.Array) -> np.ndarray:
    n = len(column)
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(n, -1) if n else np.zeros((0, 0))


def meet(blocks: DataFrame, n_blocks: int, chunks: DataFrame, work: Callable[[int, dict, dict], pa.RecordBatch | None],
         schema: str) -> DataFrame:
    """``work(block number, block, chunk)`` for every chunk (payload) and every block."""
    rows = blocks.select("block", F.lit(0).alias("kind"), "payload").unionByName(
        chunks.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n_blocks - 1).cast("long"))).alias("block"),
                      F.lit(1).alias("kind"), "payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, held = None, None
        for block, kind, p in payloads(batches, "block", "kind"):
            if kind == 0:
                at, held = block, p
            elif at == block:  # else the block has no rows
                out = work(block, held, p)
                if out is not None and out.num_rows:
                    yield out
    return rows.repartition(n_blocks, "block").sortWithinPartitions("block", "kind").mapInArrow(run, schema)


def best(found: DataFrame, per: list[str], score: str, id_col: str, k: int, rank: str) -> DataFrame:
    """The first k rows of each group: higher scores first, then smaller ids, NULL ids last."""
    w = Window.partitionBy(*per).orderBy(F.desc(score), F.asc_nulls_last(id_col))
    return found.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def id_array(ids: np.ndarray) -> pa.Array:
    return pa.array(ids, pa.int64(), mask=ids == NO_ID)


class Top:
    """The first k (score, id) of each of n rows, kept over any number of additions."""

    def __init__(self, n: int, k: int, floor: np.ndarray):
        self.k, self.limit = k, floor  # limit: lower scores cannot get in
        self.row, self.score, self.id = np.zeros(0, np.int64), np.zeros(0, floor.dtype), np.zeros(0, np.int64)

    def add(self, row: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        row, score, ids = np.concatenate([self.row, row]), np.concatenate([self.score, score]), np.concatenate([self.id, ids])
        order = np.lexsort((ids, -score, row))
        row, score, ids = row[order], score[order], ids[order]
        place = np.arange(len(row)) - np.searchsorted(row, row)
        kept = place < self.k
        self.row, self.score, self.id = row[kept], score[kept], ids[kept]
        full = place[kept] == self.k - 1
        self.limit[self.row[full]] = np.maximum(self.limit[self.row[full]], self.score[full])
