"""Benchmark decontamination with a generalised suffix automaton (operator 6).

The normalised test items are joined into one generalised suffix automaton over
words. Documents stream their words through it; at every word the automaton
holds the longest suffix of the document that occurs in some item. A window
(``window`` consecutive item words, or a whole shorter item) occurs exactly
when that matching length reaches it, so spans, item hits and coverage all
follow from the tracked lengths in one pass, without a shuffle.

The automaton has at most two states per item word. Test sets do not grow with
the corpus; ``MAX_ITEM_WORDS`` is the checked bound of what is broadcast, and a
larger set raises an error instead of being cut.

Edge cases: NULL or empty texts have no words and no hits; items without words
give no window; items of the same id count as one item, and all items without
an id as one more, which ``n_items`` counts and ``items_sha256`` cannot name
(their windows mark words like any other's); repeated documents are judged one
by one; very long texts are read whole, one block each; extra columns, whatever
their names, are ignored by ``contamination`` and kept by ``remove_spans``; empty
tables give empty results or no hits.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import Prefix, blocks, byte_values, column, covered, owners, words
from .common import prepare, table

WINDOW = 10                  # item words that make a window
MAX_ITEM_WORDS = 5_000_000   # bound of the broadcast automaton
MAX_COVERAGE = 0.5           # a document with a larger share of hit words is dropped by the filter

# Word bytes of the contract after A-Z became a-z.
WORD = np.zeros(256, bool)
WORD[0x30:0x3A] = True
WORD[0x41:0x5B] = True
WORD[0x61:0x7B] = True
WORD[0x80:] = True


class Automaton:
    """Generalised suffix automaton over integer words."""

    def __init__(self, items: list[tuple[str | None, np.ndarray]], window: int = WINDOW):
        self.window = window
        self.vocab = np.unique(np.concatenate([h for _, h in items])) if items else np.zeros(0, np.uint64)
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        ends: list[set[int]] = [set()]       # items whose prefixes end here
        self.names = [name for name, _ in items]
        whole: list[tuple[int, int]] = []    # (item, its word count) of short items
        self.shortest = window
        runs = []
        for k, (_, hashes) in enumerate(items):
            run = np.searchsorted(self.vocab, hashes).tolist()
            runs.append(run)
            last = 0
            for w in run:
                last = self._extend(last, w, ends)
                ends[last].add(k)
            if 0 < len(run) < window:
                whole.append((k, len(run)))
                self.shortest = min(self.shortest, len(run))
        order = sorted(range(1, len(self.length)), key=self.length.__getitem__, reverse=True)
        for v in order:                      # a longer string's items also hold its suffixes
            if self.length[self.link[v]] >= window:
                ends[self.link[v]] |= ends[v]
        self.items: list[tuple[int, ...]] = [tuple(sorted(e)) for e in ends]
        self.short: list[list[tuple[int, int]]] = [[] for _ in self.length]
        for k, m in whole:
            v = 0
            for w in runs[k]:
                v = self.next[v][w]
            self.short[v].append((m, k))
        self.has_short = [False] * len(self.length)
        for v in reversed(order):            # shortest first: inherit from the link
            self.has_short[v] = bool(self.short[v]) or self.has_short[self.link[v]]

    def _extend(self, last: int, w: int, ends: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        if w in nxt[last]:
            q = nxt[last][w]
            if length[q] == length[last] + 1:
                return q
            return self._split(last, w, q, ends)
        cur = len(nxt)
        nxt.append({})
        link.append(0)
        length.append(length[last] + 1)
        ends.append(set())
        p = last
        while p != -1 and w not in nxt[p]:
            nxt[p][w] = cur
            p = link[p]
        if p != -1:
            q = nxt[p][w]
            link[cur] = q if length[q] == length[p] + 1 else self._split(p, w, q, ends)
        return cur

    def _split(self, p: int, w: int, q: int, ends: list[set[int]]) -> int:
        nxt, link, length = self.next, self.link, self.length
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        link.append(link[q])
        length.append(length[p] + 1)
        ends.append(set(ends[q]) if length[p] + 1 >= self.window else set())
        link[q] = clone
        while p != -1 and nxt[p].get(w) == q:
            nxt[p][w] = clone
            p = link[p]
        return clone

    def scan(self, run: list[int], base: int, found: set[int], spans: list[tuple[int, int]]) -> None:
        """Stream one run of known words; ``base`` is the position of its first word."""
        nxt, link, length, window = self.next, self.link, self.length, self.window
        v = n = 0
        for i, w in enumerate(run):
            while v and w not in nxt[v]:
                v = link[v]
                n = length[v]
            if w in nxt[v]:
                v = nxt[v][w]
                n += 1
            if n >= window:
                u = v
                while length[link[u]] >= window:
                    u = link[u]
                found.update(self.items[u])
                spans.append((base + i - n + 1, base + i + 1))
            if self.has_short[v]:
                u = v
                while u > 0 and self.has_short[u]:
                    for m, k in self.short[u]:
                        if m <= n:
                            found.add(k)
                            spans.append((base + i - m + 1, base + i + 1))
                    u = link[u]


def item_words(texts: list[str | None]) -> list[np.ndarray]:
    batch = pa.record_batch({"text": pa.array(texts, pa.string())})
    out: list[np.ndarray] = []
    for b in blocks([batch]):
        s, e, first = words(b.data, b.offsets, WORD)
        h = Prefix(byte_values(b.data, fold=True)).spans(s, e)
        out += [h[first[i]:first[i + 1]] for i in range(b.n)]
    return out


def build_automaton(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text",
                    window: int = WINDOW) -> Automaton:
    """The automaton of all items; the size bound is checked before anything is read to the driver."""
    pattern = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    total = benchmark.agg(F.sum(F.regexp_count(F.lower(text_col), F.lit(pattern)))).first()[0] or 0
    if total > MAX_ITEM_WORDS:
        raise ValueError(f"{total} item words; the automaton is bounded at {MAX_ITEM_WORDS}")
    rows = benchmark.select(F.col(item_col).cast("string").alias("i"), F.col(text_col).alias("t")).collect()
    return Automaton(list(zip([r.i for r in rows], item_words([r.t for r in rows]), strict=True)), window)


def _matches(b, auto: Automaton):
    """Per block: word starts and ends, first words, hit mask, items found by document."""
    s, e, first = words(b.data, b.offsets, WORD)
    h = Prefix(byte_values(b.data, fold=True)).spans(s, e)
    found: dict[int, set[int]] = {}
    spans: list[tuple[int, int]] = []
    if len(auto.vocab) and len(h):
        at = np.minimum(np.searchsorted(auto.vocab, h), len(auto.vocab) - 1)
        known = auto.vocab[at] == h
        a, z, _ = words(known.view(np.uint8), first, np.arange(256) == 1)  # runs of known words, by document
        ok = z - a >= auto.shortest
        own = owners(first)
        for lo, hi in zip(a[ok].tolist(), z[ok].tolist(), strict=True):
            auto.scan(at[lo:hi].tolist(), lo, found.setdefault(int(own[lo]), set()), spans)
    sp = np.array(spans, np.int64).reshape(-1, 2)
    return s, e, first, covered(sp[:, 0], sp[:, 1], len(s)), found


def contamination(docs: DataFrame, automaton: Automaton, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_words, n_hit, n_items, items_sha256, contaminated."""
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_words", T.LongType()),
                           T.StructField("n_hit", T.LongType()), T.StructField("n_items", T.LongType()),
                           T.StructField("items_sha256", T.StringType()), T.StructField("contaminated", T.BooleanType())])

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for b in blocks(batches):
            _, _, first, hit, found = _matches(b, auto)
            sums = np.concatenate([[0], np.cumsum(hit)])
            n_hit = sums[first[1:]] - sums[first[:-1]]
            held = [{auto.names[k] for k in found.get(i, ())} for i in range(b.n)]
            names = [sorted(x - {None}) for x in held]
            yield pa.record_batch({
                "doc_id": column(b.rows, "doc_id"),
                "n_words": np.diff(first), "n_hit": n_hit.astype(np.int64),
                "n_items": pa.array([len(x) for x in held], pa.int64()),
                "items_sha256": pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in names], pa.string()),
                "contaminated": n_hit > 0})

    return source.mapInArrow(judge, schema)


def remove_spans(docs: DataFrame, automaton: Automaton, max_coverage: float = MAX_COVERAGE,
                 text_col: str = "text") -> DataFrame:
    """The documents without their hit spans.

    Every hit word is cut out with the separators inside its span; a document
    whose hit words exceed ``max_coverage`` of its words is dropped. Documents
    without a hit come back unchanged, byte for byte (NULL text included).
    """
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(automaton)
    names = docs.columns

    def clean(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = shared.value
        for batch in batches:
            at = 0
            for b in blocks([batch]):
                s, e, first, hit, _ = _matches(b, auto)
                part = batch.slice(at, b.n)
                at += b.n
                own = owners(first)
                n_hit = np.bincount(own[hit], minlength=b.n)
                keep = n_hit <= max_coverage * np.diff(first)
                texts = column(part, text_col).to_pylist()
                for i in np.flatnonzero((n_hit > 0) & keep):
                    lo, hi = int(first[i]), int(first[i + 1])
                    mask = hit[lo:hi].view(np.int8)
                    edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
                    base, kept, pos = int(b.offsets[i]), [], 0
                    raw = b.text(i)
                    for x, y in zip(edge[::2] + lo, edge[1::2] + lo, strict=True):
                        kept.append(raw[pos:int(s[x]) - base])
                        pos = int(e[y - 1]) - base
                    kept.append(raw[pos:])
                    texts[i] = b"".join(kept).decode()
                cols = [pa.array(texts, column(part, c).type) if c == text_col else column(part, c) for c in names]
                yield pa.record_batch(cols, names=names).filter(pa.array(keep))

    return docs.mapInArrow(clean, docs.schema)


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), build_automaton(table(spark, sf_dir, "benchmark")))


SQL = r"""
WITH it AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM it WHERE len(w) > 0)),
d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
dw AS (
  SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
  FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, (SELECT DISTINCT m FROM win) WHERE len(w) >= m)),
occ AS (SELECT doc_id, item_id, i, win.m FROM dw JOIN win ON dw.g = win.g AND dw.m = win.m),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS s
        FROM (SELECT DISTINCT doc_id, item_id FROM occ) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
