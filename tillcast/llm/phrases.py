"""Suffix-array deduplication by prefix-free parsing (operator 7).

A rolling hash over ``TRIGGER`` bytes picks trigger positions: in every stretch
of ``WIDTH`` bytes the trigger word with the least hash cuts a phrase. The
choice depends on the stretch alone, so equal stretches are cut alike in all
documents, and no phrase suffix of window length is a proper prefix of another
phrase's (the prefix-free property). The parse of the corpus is the phrases in
text order; its dictionary is the distinct phrases, each with the first
document that holds it.

Spark deals phrases by trigger word. A trigger word leaves at once where no
other text has it with the bytes around it that a window holds as well (33 or
34 in all), so short strings that texts share by chance are not dealt; a text
that a smaller id has too is one span. Equal phrases meet in one dictionary entry, so highly repetitive text
is settled per entry and not per byte. Entries that share a trigger word but
differ go into the sparse suffix array of the dictionary: their suffixes of at
least 50 bytes are sorted in byte order (big-endian words, exact bytes, no
hashing), and neighbours whose common prefix reaches 50 bytes are repeats.
With the dealing by trigger word, which orders the parse, this is the corpus
suffix order cut at 50 bytes, and only where repeats are possible.

Edge cases: NULL, empty and short texts have no window and lose nothing;
documents with a NULL id are kept whole; rows that repeat an id never remove
from each other; runs of one byte tie all triggers, the leftmost one counts;
an empty table gives an empty result; matches never cross documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import SECOND, Block, Prefix, blocks, byte_values, column, mix, owners, window_starts
from .common import table
from .repeats import Parsed, Units, identified, removed_spans
from .substrings import kept_mask

WIDTH = 50
TRIGGER = 16

_LOW = np.uint64((1 << 24) - 1)
_STRETCH = 1 << 23     # positions ranked together; with their overlap they fit in _LOW


def _least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    have = 1
    while 2 * have <= width:
        values = np.minimum(values[:-have], values[have:])
        have *= 2
    rest = width - have
    return np.minimum(values[:-rest], values[rest:]) if rest else values


def _cuts(h: np.ndarray, width: int) -> np.ndarray:
    """Position of the least hash of every ``width`` neighbours, the leftmost of equal ones."""
    parts = []
    for lo in range(0, len(h) - width + 1, _STRETCH):
        part = h[lo:lo + _STRETCH + width - 1]
        rank = (mix(part) | _LOW) ^ _LOW | np.arange(len(part), dtype=np.uint64)
        parts.append((_least(rank, width) & _LOW).astype(np.int64) + lo)
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def _parser(width: int, trigger: int):
    half = (width - trigger) // 2

    def parse(b: Block) -> Parsed:
        at = window_starts(b.offsets, width)
        if not len(at):
            z = np.zeros(0, np.uint64)
            i = np.zeros(0, np.int64)
            return Parsed(z, i, i, i, lambda seg: (z, z), z, i)
        values = byte_values(b.data)
        rolling = Prefix(values)
        h = rolling.windows(trigger)
        cut = _cuts(h, width - trigger + 1)[at]
        new = np.ones(len(at), bool)
        new[1:] = (cut[1:] != cut[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(at)))
        a = at[head]
        z = a + n + width - 1
        own = np.searchsorted(b.offsets, a, side="right") - 1
        def prints(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return rolling.spans(a[seg], z[seg]), Prefix(values, SECOND).spans(a[seg], z[seg])

        # windows that begin up to ``half`` bytes before the trigger word all hold the bytes after it, the others those before it
        after = cut - at <= half
        first = new.copy()
        first[1:] |= after[1:] != after[:-1]
        part = np.flatnonzero(first)
        c, right = cut[part], after[part]
        probe = rolling.spans(np.where(right, c, c - half - 1), np.where(right, c + width - half, c + trigger))
        return Parsed(h[cut[head]], own, a - b.offsets[own], n, prints, probe, (np.cumsum(new) - 1)[part])
    return parse


def _packer(width: int):
    def pack(b: Block, own: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[bytes]:
        a = b.offsets[own] + start
        return [b.data[i:j].tobytes() for i, j in zip(a.tolist(), (a + n + width - 1).tolist(), strict=True)]
    return pack


def _unfolder(width: int):
    def unfold(packs: list[bytes], n: np.ndarray) -> np.ndarray:
        """Every suffix of at least ``width`` bytes, cut there, as big-endian words: their order is byte order."""
        data = np.frombuffer(b"".join(packs) + bytes(8), np.uint8)
        word = np.zeros(len(data) - 7, np.uint64)
        for k in range(8):
            word |= data[k:len(data) - 7 + k].astype(np.uint64) << np.uint64(56 - 8 * k)
        size = n + width - 1
        at = np.repeat(np.cumsum(size) - size - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        steps = [*range(0, width - 8, 8), width - 8]
        return np.stack([word[at + k] for k in steps], axis=1)
    return unfold


def units(width: int = WIDTH, trigger: int = TRIGGER) -> Units:
    return Units(width, _parser(width, trigger), _packer(width), _unfolder(width), lambda pack, j: pack[j:j + width])


def _kept(b: Block, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Kept bytes, and the starts of maximal removed runs."""
    keep = kept_mask(b, column(b.rows, "spans"), b.offsets, width)
    begin = ~keep
    if len(keep):
        edge = np.zeros(len(keep) + 1, bool)
        edge[b.offsets] = True
        begin[1:] &= keep[:-1] | edge[1:-1]
    return keep, begin


def repeated_bytes(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 of every document."""
    source = identified(docs, id_col, text_col)
    spans = removed_spans(source, units(width))
    schema = T.StructType([source.schema["doc_id"], *[T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")],
                           T.StructField("kept_sha256", T.StringType())])

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            keep, begin = _kept(b, width)
            own = owners(b.offsets)
            sums = [hashlib.sha256(b.data[x:y][keep[x:y]].tobytes()).hexdigest()
                    for x, y in zip(b.offsets[:-1].tolist(), b.offsets[1:].tolist(), strict=True)]
            yield pa.record_batch({
                "doc_id": column(b.rows, "doc_id"), "n_bytes": np.diff(b.offsets),
                "n_removed": np.bincount(own[~keep], minlength=b.n).astype(np.int64),
                "n_spans": np.bincount(own[begin], minlength=b.n).astype(np.int64), "kept_sha256": pa.array(sums, pa.string())})

    return source.join(spans, ["doc_id", "th"], "left").mapInArrow(clean, schema)


def remove_repeats(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their repeated bytes, in the columns they came with.

    Spans shrink to whole UTF-8 characters, so the text stays valid. A document
    of which only white space is left is dropped; documents without a repeat
    come back unchanged (NULL and empty texts included).
    """
    spans = removed_spans(identified(docs, id_col, text_col), units(width))
    spans = spans.select(F.col("doc_id").alias("__d"), F.col("th").alias("__h"), F.col("spans").alias("__spans"))
    joined = docs.join(spans, (F.col(id_col) == F.col("__d")) & (F.xxhash64(text_col) == F.col("__h")), "left").drop("__d", "__h")
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            small = batch.select([text_col, "__spans"]).rename_columns([text_col, "spans"])
            for b in blocks([small], text_col):
                part = batch.slice(at, b.n)
                at += b.n
                keep, _ = _kept(b, width)
                tail = (b.data & 0xC0) == 0x80                      # a character's later bytes
                start = np.maximum.accumulate(np.where(tail, 0, np.arange(len(tail))))
                whole = np.bincount(start[keep], minlength=len(keep) + 1)[:len(keep)] > 0
                keep = whole[start]                                 # a character with a kept byte stays whole
                texts = column(part, text_col).to_pylist()
                alive = np.ones(b.n, bool)
                hit = np.unique(owners(b.offsets)[~keep])
                for i in hit.tolist():
                    x, y = int(b.offsets[i]), int(b.offsets[i + 1])
                    raw = b.data[x:y][keep[x:y]].tobytes()
                    alive[i] = bool(raw.split())
                    texts[i] = raw.decode()
                cols = [pa.array(texts, column(part, c).type) if c == text_col else column(part, c) for c in names]
                yield pa.record_batch(cols, names=names).filter(pa.array(alive))

    return joined.mapInArrow(clean, docs.schema)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_bytes(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, 2 * i + 1, 100)) AS g
        FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 49)) AS i FROM d WHERE length(h) >= 100)),
f AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
hit AS (SELECT win.doc_id, i FROM win JOIN f USING (g) WHERE f.m < win.doc_id),
run AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM (
          SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
            SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS fresh FROM hit))
        GROUP BY doc_id, k),
gap AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS before FROM run),
agg AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans, max(z) AS tail FROM run GROUP BY doc_id),
kept AS (SELECT gap.doc_id, string_agg(substr(h, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS k
         FROM gap JOIN d USING (doc_id) GROUP BY gap.doc_id)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN tail IS NULL THEN h ELSE k || substr(h, 2 * tail + 1) END)) AS kept_sha256
FROM d LEFT JOIN agg USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
