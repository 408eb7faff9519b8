"""URL filters over a sorted digest array (operator 1).

The rule list becomes sorted shards of (64-bit xxhash, rule string, verdict).
Each shard is one binary file in the shared folder; Spark's file distribution
brings it to every executor once, and all tasks of that executor memory-map
the same pages. A url is expanded into the rule strings that could judge it
(each parent domain x each path-prefix length that occurs in the list); the
digests of a whole Arrow batch are probed by one vectorised binary search, and
a hit counts only if the stored string is equal, so digest collisions cannot
change a verdict. The longest rule wins; urls that no rule fits get
``default``, the verdict of a list that does not hold them.

A list of any size works: the driver streams it shard by shard
(``SHARD_RULES`` rules at a time) and the tasks probe the shards in turn.

Edge cases: NULL urls and urls without ``://`` have an empty host and path and
get the default; an empty list gives the default everywhere; of repeated rules
with different verdicts ``block`` counts; equally long rules: the longer host
wins; repeated pages are judged one by one; only the id and url columns are
read, so other columns cannot clash.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.session import shared_dir, write_shared

from .blocks import column
from .common import ascii_lower, prepare, table

SHARD_RULES = 1_000_000

# The rules of the registered query.
RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
         ("net", "/es/", "block"), ("net", "/fr/", "block")]


class Index(NamedTuple):
    files: list[str]           # names known to SparkFiles
    path_lengths: list[int]    # distinct lengths of the rules' paths, in bytes


def _pack(rules: list[tuple[str, str]]) -> bytes:
    """Header, sorted digests, string offsets, verdicts, strings."""
    keyed = sorted((xxhash.xxh64_intdigest(r), r.encode(), v) for r, v in rules)
    blob = b"".join(r for _, r, _ in keyed)
    offs = np.cumsum([0] + [len(r) for _, r, _ in keyed]).astype("<i8")
    keys = np.array([k for k, _, _ in keyed], "<u8")
    verdicts = np.array([v == "block" for _, _, v in keyed], "u1")
    return struct.pack("<q", len(keyed)) + keys.tobytes() + offs.tobytes() + verdicts.tobytes() + blob


class Shard:
    """A memory-mapped shard."""

    def __init__(self, path: str):
        raw = np.memmap(path, np.uint8, "r")
        n = struct.unpack("<q", raw[:8].tobytes())[0]
        self.keys = raw[8:8 + 8 * n].view("<u8")
        self.offs = raw[8 + 8 * n:16 + 16 * n].view("<i8")
        self.block = raw[16 + 16 * n:16 + 17 * n]
        self.blob = raw[16 + 17 * n:]

    def probe(self, digests: np.ndarray, names: list[bytes]) -> Iterator[tuple[int, bool]]:
        """(candidate, blocks?) of every candidate whose string is stored."""
        if not len(self.keys):
            return
        at = np.searchsorted(self.keys, digests)
        hit = np.flatnonzero(self.keys[np.minimum(at, len(self.keys) - 1)] == digests)
        for c in hit.tolist():
            i, found = int(at[c]), None
            while i < len(self.keys) and self.keys[i] == digests[c]:  # equal digests lie side by side
                if self.blob[self.offs[i]:self.offs[i + 1]].tobytes() == names[c]:
                    found = bool(self.block[i]) or bool(found)
                i += 1
            if found is not None:
                yield c, found


def build_index(spark: SparkSession, rules: DataFrame) -> Index:
    """``rules``: host, path, verdict (allow or block), any number of rows."""
    strings = (rules.where(F.col("verdict").isin("allow", "block") & F.col("host").isNotNull() & F.col("path").startswith("/"))
               .select(F.concat(ascii_lower(F.col("host")), "path").alias("rule"),
                       F.octet_length("path").alias("path_bytes"), "verdict"))
    lengths = [r[0] for r in strings.select("path_bytes").distinct().orderBy("path_bytes").collect()]
    files: list[str] = []
    part: list[tuple[str, str]] = []

    def flush() -> None:
        name = f"urls-{uuid.uuid4().hex}.digests"
        path = f"{shared_dir(spark)}/{name}"
        write_shared(spark, path, _pack(part))
        spark.sparkContext.addFile(path)
        files.append(name)
        part.clear()

    for r in strings.select("rule", "verdict").toLocalIterator():
        part.append((r.rule, r.verdict))
        if len(part) == SHARD_RULES:
            flush()
    if part:
        flush()
    return Index(files, lengths)


def with_host_and_path(pages: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    rest = F.when(F.instr("u", "://") > 0, F.expr("substring(u, instr(u, '://') + 3)")).otherwise(F.lit(""))
    return (pages.select(F.col(id_col).alias("page_id"), F.coalesce(F.col(url_col), F.lit("")).alias("u"))
            .select("page_id", rest.alias("rest"))
            .select("page_id", "rest", F.regexp_extract("rest", r"^[^/?#]*", 0).alias("host"))
            .select("page_id", ascii_lower(F.col("host")).alias("host"),
                    F.regexp_extract(F.expr("substring(rest, length(host) + 1)"), r"^[^?#]*", 0).alias("path")))


def judge_urls(pages: DataFrame, index: Index, default: str = "allow",
               id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """page_id, host, path, rule, verdict of every page."""
    prepare(pages.sparkSession)
    source = with_host_and_path(pages, id_col, url_col)
    schema = T.StructType([*source.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType())])
    files, lengths = index

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = [Shard(SparkFiles.get(name)) for name in files]
        for batch in batches:
            names: list[bytes] = []
            owner: list[int] = []
            rank: list[tuple[int, int]] = []
            for i, (host, path) in enumerate(zip(column(batch, "host").to_pylist(), column(batch, "path").to_pylist(), strict=True)):
                if not host or not path:
                    continue
                raw = path.encode()
                prefixes = [raw[:n] for n in lengths if n <= len(raw)]
                while True:
                    tail = host.encode()
                    for p in prefixes:
                        names.append(tail + p)
                        owner.append(i)
                        rank.append((len(host) + len(p.decode(errors="ignore")), len(host)))
                    dot = host.find(".")
                    if dot < 0:
                        break
                    host = host[dot + 1:]
            digests = np.fromiter((xxhash.xxh64_intdigest(x) for x in names), np.uint64, len(names))
            best: dict[int, tuple[tuple[int, int], bool, bytes]] = {}
            for shard in shards:
                for c, blocks in shard.probe(digests, names):
                    mine = (rank[c], blocks, names[c])
                    if owner[c] not in best or mine > best[owner[c]]:
                        best[owner[c]] = mine
            rows = range(batch.num_rows)
            yield pa.record_batch({
                **{f: column(batch, f) for f in ("page_id", "host", "path")},
                "rule": pa.array([best[i][2].decode() if i in best else None for i in rows], pa.string()),
                "verdict": pa.array([("block" if best[i][1] else "allow") if i in best else default for i in rows], pa.string())})

    return source.mapInArrow(judge, schema)


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(RULES, "host string, path string, verdict string")
    return judge_urls(table(spark, sf_dir, "pages"), build_index(spark, rules))


SQL = r"""
WITH u AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (
  SELECT page_id, regexp_extract(rest, '^[^/?#]*') AS h0, rest FROM u),
p AS (
  SELECT page_id, translate(h0, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h0) + 1), '^[^?#]*') AS path FROM h),
r(rhost, rpath, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
                              ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
m AS (
  SELECT page_id, max_by(rhost || rpath, length(rhost || rpath)) AS rule, max_by(v, length(rhost || rpath)) AS verdict
  FROM p JOIN r ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
  GROUP BY page_id)
SELECT p.page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN m USING (page_id)
"""
