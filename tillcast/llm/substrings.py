"""Substring deduplication by recompression (operator 3).

Documents are recompressed (``recompress``): rounds name token runs and pairs
by content, so equal substrings get equal interior symbols in all documents.
The highest-level symbol that a 50-word window determines on its own is the
window's anchor; symbols that several documents share reveal candidate
repeats, and ``repeats`` verifies them by 128-bit fingerprints of the words and
settles the rims of repeats window by window.

Edge cases: NULL, empty and short texts have no window and lose nothing;
documents with a NULL id are kept whole; rows that repeat an id never remove
from each other; repeated rows (same id and text) get the same result each;
periodic texts (one word over and over) fall back to lower symbol levels; an
empty table gives an empty result. Only id and text are read, so further
columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .blocks import SECOND, Block, Prefix, blocks, column, covered, list_sizes, mix, owners, window_starts, word_hashes, words
from .common import table
from .recompress import anchors, levels
from .repeats import Parsed, Units, identified, removed_spans

WIDTH = 50


def _parser(width: int):
    def parse(b: Block) -> Parsed:
        s, e, first = words(b.data, b.offsets)
        h = word_hashes(b.data, s, e)
        at = window_starts(first, width)
        if not len(at):
            z = np.zeros(0, np.uint64)
            i = np.zeros(0, np.int64)
            return Parsed(z, i, i, i, lambda seg: (z, z), z, i)
        own = owners(first)
        level, symbol, lo, hi = anchors(levels(h, first, own), at, width)
        new = np.ones(len(at), bool)
        new[1:] = (level[1:] != level[:-1]) | (symbol[1:] != symbol[:-1]) | (at[1:] != at[:-1] + 1)
        head = np.flatnonzero(new)
        n = np.diff(np.append(head, len(at)))
        one = Prefix(h)
        key = mix(one.spans(lo[head], hi[head]) + level[head].astype(np.uint64))
        a, z = at[head], at[head] + n + width - 1

        def prints(seg: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            return one.spans(a[seg], z[seg]), Prefix(h, SECOND).spans(a[seg], z[seg])

        return Parsed(key, own[a], a - first[own[a]], n, prints, key, np.arange(len(key)))
    return parse


def _packer(width: int):
    def pack(b: Block, own: np.ndarray, start: np.ndarray, n: np.ndarray) -> list[bytes]:
        s, e, first = words(b.data, b.offsets)
        h = word_hashes(b.data, s, e)
        w = np.stack([Prefix(h).windows(width), Prefix(h, SECOND).windows(width)], axis=1)
        a = first[own] + start
        return [w[i:j].tobytes() for i, j in zip(a.tolist(), (a + n).tolist(), strict=True)]
    return pack


def _unfold(packs: list[bytes], n: np.ndarray) -> np.ndarray:
    return np.frombuffer(b"".join(packs), np.uint64).reshape(-1, 2)


def units(width: int = WIDTH) -> Units:
    return Units(width, _parser(width), _packer(width), _unfold, lambda pack, j: pack[16 * j:16 * j + 16])


def kept_mask(b: Block, spans: pa.Array, first: np.ndarray, width: int) -> np.ndarray:
    """Units of the block that no span covers; an end of -1 is that of a document with a window."""
    flat = spans.flatten()
    sizes = list_sizes(spans)
    base, length = np.repeat(first[:-1], sizes), np.repeat(np.diff(first), sizes)
    if not len(flat):
        return np.ones(int(first[-1]), bool)
    end = flat.field("e").to_numpy()
    end = np.where(end < 0, np.where(length >= width, length, 0), end)
    return ~covered(base + flat.field("s").to_numpy(), base + end, int(first[-1]))


def deduplicate(docs: DataFrame, width: int = WIDTH, id_col: str = "doc_id", text_col: str = "text",
                with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256 (and kept_text) of every document."""
    source = identified(docs, id_col, text_col)
    spans = removed_spans(source, units(width))
    fields = [source.schema["doc_id"], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()),
              T.StructField("kept_sha256", T.StringType())]
    schema = T.StructType(fields + [T.StructField("kept_text", T.StringType())] * with_text)

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            s, _, first = words(b.data, b.offsets)
            keep = kept_mask(b, column(b.rows, "spans"), first, width)
            texts = []
            for i in range(b.n):
                tokens = b.text(i).split()
                mask = keep[first[i]:first[i + 1]]
                texts.append(b" ".join(tokens if mask.all() else [t for t, k in zip(tokens, mask.tolist(), strict=True) if k]))
            out = {"doc_id": column(b.rows, "doc_id"), "n_words": np.diff(first),
                   "n_removed": np.bincount(owners(first)[~keep], minlength=b.n).astype(np.int64),
                   "kept_sha256": pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string())}
            if with_text:
                out["kept_text"] = pa.array([t.decode() for t in texts], pa.string())
            yield pa.record_batch(out)

    return source.join(spans, ["doc_id", "th"], "left").mapInArrow(clean, schema)


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return deduplicate(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) AS g
        FROM (SELECT doc_id, w, unnest(range(1, len(w) - 48)) AS i FROM d WHERE len(w) >= 50)),
f AS (SELECT g, min(doc_id) AS m FROM win GROUP BY g),
rep AS (SELECT DISTINCT doc_id, p FROM (
          SELECT win.doc_id, unnest(range(i, i + 50)) AS p FROM win JOIN f USING (g) WHERE f.m < win.doc_id)),
gone AS (SELECT doc_id, count(*) AS n FROM rep GROUP BY doc_id),
kept AS (
  SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS k
  FROM (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d) AS x
  WHERE NOT EXISTS (SELECT 1 FROM rep WHERE rep.doc_id = x.doc_id AND rep.p = x.p)
  GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM d LEFT JOIN gone USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
