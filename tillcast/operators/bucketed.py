"""Stored tables that a merge does not rewrite (J-14, J-16, J-18, J-19).

Rows are dealt into buckets by a hash of their key. A manifest names the
folders of every bucket; it is one small file that is replaced in one step, so
a reader always sees a whole version of the table and a merge that breaks off
leaves the old one. One writer at a time.

* ``merge`` reads, joins and writes the buckets that the incoming keys fall in;
  the files of all other buckets stay as they are, by name.
* ``insert_absent`` keeps a Bloom filter of the stored keys per bucket. Incoming
  rows that no filter knows are new without a look at the table. What a filter
  takes for known is verified against the stored keys of its buckets: they are
  streamed past the few possible matches and are not shuffled.

A hot key value is one row of a keyed table, so buckets are even. ``buckets`` is
chosen once, for the size the table will have (a bucket of some 100 MB).
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import cut_lineage, replace_file, ship_package

MANIFEST = "manifest.json"
BITS = 12            # of a filter per stored key when it is built: about 0.5 % false hits
PROBES = 5
FULL = 2.0           # a filter that holds this many times the keys it was built for is built anew
BROADCAST_KEYS = 1_000_000  # possible matches that go to the stored keys; beyond it both sides are shuffled

FILTER = "bucket int, keys long, room long, bits binary"


def _bucket(key: Sequence[str], types: dict[str, T.DataType], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*[F.col(c).cast(types[c]) for c in key]), F.lit(buckets)).cast("int")


def _key_hash(key: Sequence[str], types: dict[str, T.DataType]) -> Column:
    """Another hash than the bucket's, as all keys of a bucket share a remainder of that one."""
    return F.xxhash64(F.lit(1), *[F.col(c).cast(types[c]) for c in key])


class Table:
    """A stored table at ``path``; ``key`` names the columns of its key."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        rows = spark.read.text(f"{path}/{MANIFEST}", wholetext=True).collect()
        held = json.loads(rows[0][0])
        self.key, self.buckets, self.folders = held["key"], held["buckets"], {int(b): f for b, f in held["folders"].items()}
        self.filters = {int(b): f for b, f in held["filters"].items()}
        self.schema = T.StructType.fromJson(held["schema"])

    @classmethod
    def create(cls, df: DataFrame, path: str, key: Sequence[str], buckets: int = 64, filtered: bool = False) -> Table:
        """Store ``df``; ``filtered`` keeps Bloom filters for ``insert_absent``."""
        spark = df.sparkSession
        held = {"key": list(key), "buckets": buckets, "folders": {}, "filters": {}, "schema": df.schema.jsonValue()}
        replace_file(spark, f"{path}/{MANIFEST}", json.dumps(held).encode())
        table = cls(spark, path)
        folders = table._write(df.withColumn("bucket", table._of()))
        table._publish(folders, table._built(folders) if filtered else {})
        return cls(spark, path)

    def _types(self) -> dict[str, T.DataType]:
        return {f.name: f.dataType for f in self.schema}

    def _of(self) -> Column:
        return _bucket(self.key, self._types(), self.buckets)

    def _publish(self, folders: dict[int, list[str]], filters: dict[int, str]) -> None:
        held = {"key": self.key, "buckets": self.buckets, "folders": {**self.folders, **folders},
                "filters": {**self.filters, **filters}, "schema": self.schema.jsonValue()}
        replace_file(self.spark, f"{self.path}/{MANIFEST}", json.dumps(held).encode())
        self.__init__(self.spark, self.path)

    def _write(self, df: DataFrame) -> dict[int, list[str]]:
        """Write rows with ``bucket`` as a new part, once; the folder of each bucket that has rows, as the part names them."""
        part = f"part-{uuid.uuid4().hex[:12]}"
        df.select("bucket", *[F.col(f.name).cast(f.dataType) for f in self.schema]).hint("rebalance", "bucket").write.partitionBy("bucket").parquet(f"{self.path}/{part}")
        written = self.spark.read.schema(T.StructType([*self.schema, T.StructField("bucket", T.IntegerType())])).parquet(f"{self.path}/{part}")
        there = {r.bucket for r in written.select("bucket").distinct().collect()}  # at most as many as buckets
        return {b: [f"{part}/bucket={b}"] for b in sorted(there)}

    def read(self, buckets: Sequence[int] | None = None) -> DataFrame:
        """The table, or some of its buckets."""
        wanted = sorted(self.folders if buckets is None else set(buckets) & self.folders.keys())
        return self._at({b: self.folders[b] for b in wanted})

    def _at(self, folders: dict[int, list[str]]) -> DataFrame:
        at = [f"{self.path}/{f}" for fs in folders.values() for f in fs]
        return self.spark.read.schema(self.schema).parquet(*at) if at else self.spark.createDataFrame([], self.schema)

    def merge(self, incoming: DataFrame, how: Callable[[DataFrame, DataFrame], DataFrame]) -> DataFrame:
        """``how(stored rows of the touched buckets, incoming)`` gives their new rows, which replace them.

        Returns what ``how`` gave (its further columns, such as a change mark, are not stored)."""
        incoming = cut_lineage(incoming, "incoming")
        touched = sorted(r.b for r in incoming.select(self._of().alias("b")).distinct().collect())
        merged = cut_lineage(how(self.read(touched), incoming).withColumn("bucket", self._of()), "merged")
        folders = self._write(merged)
        self._publish({b: folders.get(b, []) for b in touched}, {})
        return merged.drop("bucket")

    # ------------------------------------------------------------ insert if absent

    def _hashes(self, df: DataFrame) -> DataFrame:
        return df.select(self._of().alias("bucket"), _key_hash(self.key, self._types()).alias("h"))

    def _built(self, folders: dict[int, list[str]]) -> dict[int, str]:
        """Filters over all stored keys of the buckets in ``folders``."""
        at = [f"{self.path}/{f}" for fs in folders.values() for f in fs]
        if not at:
            return {}
        stored = self.spark.read.schema(self.schema).parquet(*at)
        return self._filters(self._hashes(stored), None)

    def _filters(self, hashes: DataFrame, older: DataFrame | None) -> dict[int, str]:
        """One filter a bucket over ``hashes`` (and ``older`` filters of the same buckets); where each was written."""
        ship_package(self.spark)
        rows = hashes.select("bucket", F.lit(1).alias("kind"), "h", F.lit(None).cast("long").alias("keys"),
                             F.lit(None).cast("long").alias("room"), F.lit(None).cast("binary").alias("bits"))
        if older is None:
            older = hashes.groupBy("bucket").agg(F.lit(0).cast("long").alias("keys"), F.count("*").alias("room"),
                                                 F.lit(None).cast("binary").alias("bits"))
        rows = rows.unionByName(older.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("h"), "keys", "room", "bits"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = None
            for bucket, kind, part in _runs(batches):
                if kind == 0:
                    if held:
                        yield _row(*held)
                    keys, room, bits = (part.column(i)[0].as_py() for i in (3, 4, 5))
                    held = [bucket, keys, room, np.frombuffer(bits, np.uint8).copy() if bits else _empty(room)]
                elif held and held[0] == bucket:
                    h = part.column(2).to_numpy()
                    held[1] += len(h)
                    _set(held[3], h)
            if held:
                yield _row(*held)
        part = f"filters-{uuid.uuid4().hex[:12]}"
        (rows.repartition(min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
         .sortWithinPartitions("bucket", "kind").mapInArrow(run, FILTER).write.partitionBy("bucket").parquet(f"{self.path}/{part}"))
        made = self.spark.read.schema(FILTER).parquet(f"{self.path}/{part}").select("bucket").distinct().collect()
        return {r.bucket: f"{part}/bucket={r.bucket}" for r in made}

    def _held_filters(self, buckets: Sequence[int]) -> DataFrame:
        at = [f"{self.path}/{self.filters[b]}" for b in buckets if b in self.filters]
        if not at:
            return self.spark.createDataFrame([], FILTER)
        return _with_bucket(self.spark, at)

    def insert_absent(self, incoming: DataFrame, first: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Store the incoming rows whose key is not stored yet, one per key by ``first``; returns them."""
        ship_package(self.spark)
        tagged = cut_lineage(incoming.withColumns({"bucket": self._of(), "h": _key_hash(self.key, self._types())}), "incoming")
        touched = sorted(r.bucket for r in tagged.select("bucket").distinct().collect())
        filters = self._held_filters(touched)
        known = tagged.select("bucket", "h").distinct()
        rows = known.select("bucket", F.lit(1).alias("kind"), "h", F.lit(None).cast("binary").alias("bits")).unionByName(
            filters.select("bucket", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("h"), "bits"))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            at, bits = None, None
            for bucket, kind, part in _runs(batches):
                if kind == 0:
                    at, bits = bucket, np.frombuffer(part.column(3)[0].as_py(), np.uint8)
                elif at == bucket:
                    h = part.column(2).to_numpy()
                    h = h[_hit(bits, h)]
                    yield pa.RecordBatch.from_pydict({"bucket": pa.array(np.full(len(h), bucket, np.int32)), "h": pa.array(h)})
        possible = cut_lineage(rows.repartition(min(self.buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions"))), "bucket")
                               .sortWithinPartitions("bucket", "kind").mapInArrow(run, "bucket int, h long"), "possible")
        # Exact: a possible match counts only if its key is stored.
        maybe = tagged.join(possible.select("h"), "h", "left_semi").select(*[F.col(c).alias(f"_k_{c}") for c in self.key], "h").distinct()
        n = possible.limit(BROADCAST_KEYS + 1).count()
        stored = self.read([r.bucket for r in possible.select("bucket").distinct().collect()]).select(
            *self.key, _key_hash(self.key, self._types()).alias("h"))
        same = F.col("h") == F.col("_h")
        for c in self.key:
            same = same & F.col(c).eqNullSafe(F.col(f"_k_{c}"))
        maybe = maybe.withColumnRenamed("h", "_h")
        stored_keys = stored.join(F.broadcast(maybe) if n <= BROADCAST_KEYS else maybe, same).select(*[f"_k_{c}" for c in self.key], "_h").distinct()
        unseen = first(tagged.join(stored_keys, same, "left_anti").select(*self.schema.fieldNames()))
        added = self._write(unseen.withColumn("bucket", self._of()))
        new = self._at(added)
        folders = {b: [*self.folders.get(b, []), *f] for b, f in added.items()}
        self._publish(folders, self._grown(self._hashes(new), added, folders) if self.filters or not self.folders else {})
        return new

    def _grown(self, new: DataFrame, added: dict[int, list[str]], folders: dict[int, list[str]]) -> dict[int, str]:
        """Filters of the buckets with new rows: extended, or built anew where they are missing or too full."""
        if not added:
            return {}
        counts = {r.bucket: r.n for r in new.groupBy("bucket").agg(F.count("*").alias("n")).collect()}
        held = {r.bucket: r for r in self._held_filters(list(added)).select("bucket", "keys", "room").collect()}
        extend = [b for b in added if b in held and held[b].keys + counts[b] <= FULL * held[b].room]
        out = self._filters(new.where(F.col("bucket").isin(*extend)), self._held_filters(extend)) if extend else {}
        return {**out, **self._built({b: folders[b] for b in added if b not in extend})}


def _with_bucket(spark: SparkSession, at: list[str]) -> DataFrame:
    """Filter rows with the bucket that their folder names."""
    rows = spark.read.schema("keys long, room long, bits binary").parquet(*at)
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"/bucket=(\d+)/", 1).cast("int").alias("bucket"), "keys", "room", "bits")


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, int, pa.RecordBatch]]:
    for batch in batches:
        buckets, kinds = batch.column(0).to_numpy(), batch.column(1).to_numpy()
        cuts = np.flatnonzero((np.diff(buckets) != 0) | (np.diff(kinds) != 0)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            if hi > lo:
                yield int(buckets[lo]), int(kinds[lo]), batch.slice(lo, hi - lo)


def _empty(room: int) -> np.ndarray:
    return np.zeros(max(64, room * BITS // 8), np.uint8)


def _places(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """PROBES bit numbers of each key, by double hashing."""
    u = h.astype(np.uint64)
    a, b = u & np.uint64(0xFFFFFFFF), (u >> np.uint64(32)) | np.uint64(1)
    return (a[:, None] + np.arange(PROBES, dtype=np.uint64) * b[:, None]) % np.uint64(len(bits) * 8)


def _set(bits: np.ndarray, h: np.ndarray) -> None:
    at = _places(bits, h).ravel()
    np.bitwise_or.at(bits, at >> np.uint64(3), (np.uint64(1) << (at & np.uint64(7))).astype(np.uint8))


def _hit(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = _places(bits, h)
    return ((bits[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1).all(axis=1)


def _row(bucket: int, keys: int, room: int, bits: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"bucket": pa.array([bucket], pa.int32()), "keys": pa.array([keys], pa.int64()),
                                       "room": pa.array([room], pa.int64()), "bits": pa.array([bits.tobytes()], pa.binary())})
