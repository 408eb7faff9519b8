"""Toxicity scores from nearest labelled examples (operator 4).

A text is a TF-IDF vector over all terms (folded words, their first 4 bytes, and
pairs of neighbouring words) of at least ``MIN_DF`` labelled examples, whichever
class they lean to; a term's inverse document frequency is scaled by how unevenly
the two classes use it (the absolute log odds ratio over the examples, to the
power ``LEAN``; chosen by four-fold cross-validation on training rows). The
labelled examples form an inverted index. A posting is an example's place and the
term's count, from which its weight follows exactly; the postings of a frequent
term lie in blocks of ``BLOCK`` examples, each with its largest weight. The tail
is the frequent terms of least weight that make up ``TAIL`` of the examples'
squared length together; it holds many postings. For it a block keeps the longest
tail among its examples, as the product of two tails is at most that of their
lengths. A query adds these maxima (and the largest sum of its rarer terms) to a
bound for every block, opens blocks in falling order of bound, sums their
postings, and completes an example by its own tail where that can still reach the
k-th best cosine; it ends where no block can. So the k nearest examples are exact
over all terms. Their votes, weighted by cosine and shrunk towards the base rate,
are calibrated by a logistic curve fitted on leave-one-out votes of the examples;
the nearest examples are the evidence.

Fitting uses at most ``MAX_EXAMPLES`` labelled rows (by a hash of the id, so
the sample is the same on reruns), the documented bound of the broadcast index.
Labels of held-out documents are never read. Everything else covers all data:
every whole text is scored.

Edge cases: NULL and empty texts, and texts without any indexed term, have no
neighbours and get the calibrated base rate; a NULL doc_id is never held out;
labels with a NULL id or label are ignored, of repeated labels the toxic one
counts; without labelled rows of both classes every score is 0.5 or the share
of toxic labels; an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, replace
from functools import cached_property
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.session import cut_lineage

from .blocks import Block, Prefix, blocks, byte_values, column, keep, mix, owners, window_starts, words
from .common import prepare, table
from .decontaminate import WORD

MAX_EXAMPLES = 20_000
MIN_DF = 3            # examples a term must occur in
OPEN = 32             # blocks opened at first; twice as many each further time
NEIGHBOURS = 16
BLOCK = 64
FREQUENT = 512        # postings from which on a term keeps block maxima
TAIL = 0.003          # share of the examples' squared length in the tail
COMPLETED = 32        # examples completed by their tails at a time
SLACK = 1e-9          # of bounds, for the order of additions
SHRINK = 0.5          # cosine mass of the base rate in a vote
THRESHOLD = 0.3       # fixed value of the contract
EVIDENCE = 3
BEGINNING = 4         # bytes
LEAN = 1.5            # power of the log odds in a term's weight


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(False))


def _terms(b: Block) -> tuple[np.ndarray, np.ndarray]:
    """(term, document) of every word, word beginning and pair of neighbouring words of the block."""
    s, e, first = words(b.data, b.offsets, WORD)
    p = Prefix(byte_values(b.data, fold=True))
    own = owners(first)
    word = p.spans(s, e)
    long = e - s >= BEGINNING
    begin = mix(p.spans(s[long], s[long] + BEGINNING) + np.uint64(BEGINNING))
    at = window_starts(first, 2)
    pair = Prefix(word).windows(2)[at]
    return np.concatenate([word, begin, pair]), np.concatenate([own, own[long], own[at]])


def _sieve(terms: np.ndarray) -> np.ndarray:
    """Whether any of the terms begins with these 22 bits."""
    out = np.zeros(1 << 22, bool)
    out[(terms >> np.uint64(42)).astype(np.int64)] = True
    return out


def _counts(b: Block, chosen: np.ndarray, sieve: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, index of a chosen term, count), sorted by document."""
    term, own = _terms(b)
    maybe = np.flatnonzero(sieve[term >> np.uint64(42)])
    maybe = maybe[np.argsort(term[maybe])]  # neighbouring lookups share cache lines
    term, own = term[maybe], own[maybe]
    at = np.minimum(np.searchsorted(chosen, term), max(len(chosen) - 1, 0))
    hit = chosen[at] == term if len(chosen) else np.zeros(len(term), bool)
    pair, count = np.unique(own[hit] * np.int64(max(len(chosen), 1)) + at[hit], return_counts=True)
    return pair // max(len(chosen), 1), pair % max(len(chosen), 1), count


class Lists:
    """Many arrays in one: list t is ``flat[edge[t]:edge[t + 1]]``."""

    def __init__(self, flat: np.ndarray, edge: np.ndarray):
        self.flat, self.edge = flat, edge

    def __getitem__(self, t: int) -> np.ndarray:
        return self.flat[self.edge[t]:self.edge[t + 1]]


def _ranges(lo: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The numbers lo .. lo + size - 1 of every range, one after another."""
    return np.repeat(lo - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))


PART = 1 << 20        # postings worked on at a time
BATCH_BYTES = 8 << 20  # of texts that go to a worker at a time
SENT = 1_000          # documents that come back at a time


def _parts(n: int, size: int | None = None) -> Iterator[tuple[int, int]]:
    size = size or PART
    return ((lo, min(lo + size, n)) for lo in range(0, n, size))


def _terms_of(edge: np.ndarray, lo: int, hi: int) -> np.ndarray:
    """The term of each of the postings lo .. hi - 1, where term t has edge[t] .. edge[t + 1] - 1."""
    first, last = np.searchsorted(edge, lo, side="right") - 1, np.searchsorted(edge, hi, side="left")
    return np.repeat(np.arange(first, last), np.diff(np.clip(edge[first:last + 1], lo, hi)))


class Search(NamedTuple):
    """What a worker derives from an index: weights of the terms before the tail by term, tails by example."""
    light: Lists           # per term before the tail: example positions
    weight: np.ndarray     # per posting of ``light``
    cuts: np.ndarray       # per entry of the blocks: its first posting in ``light``
    number: np.ndarray     # per term: its number in the tail
    far: Lists             # per example: the numbers of its tail terms
    count: np.ndarray      # per posting of ``far``: which of the distinct counts
    rest: np.ndarray       # per example: length of its tail
    block_rest: np.ndarray  # per block: the longest of them


@dataclass
class Index:
    terms: np.ndarray      # sorted terms
    idf: np.ndarray        # scaled by class
    ids: np.ndarray        # examples' doc ids, in block order
    toxic: np.ndarray
    inverse: np.ndarray    # 1 / length of each example's vector
    grown: np.ndarray      # 1 + log of each distinct count
    where: Lists           # per term: example positions
    count: np.ndarray      # per posting: which of the distinct counts of a term in an example
    tail: np.ndarray       # per term: whether it is of the tail
    block: Lists           # per other frequent term: the blocks that hold it
    top: np.ndarray        # per entry of ``block``: its largest weight
    cuts: np.ndarray       # per entry: its first posting
    size: np.ndarray       # per entry: its postings
    base: float

    @cached_property
    def search(self) -> Search:
        edge, sizes = self.where.edge, np.diff(self.where.edge)
        far = np.repeat(self.tail, sizes)
        light = np.concatenate([[0], np.cumsum(np.where(self.tail, 0, sizes))])
        number, numbered = np.cumsum(self.tail) - 1, np.flatnonzero(self.tail)
        # A worker holds each posting once, in small types, and makes one part at a time: the tail, then the rest.
        held, done = len(far) - int(light[-1]), 0
        owner, late, count = (np.empty(held, x) for x in (self.where.flat.dtype, _small(number[-1:]).dtype, self.count.dtype))
        for lo, hi in _parts(len(far), PART // 8):
            of = np.flatnonzero(far[lo:hi])
            part = slice(done, done := done + len(of))
            owner[part], late[part], count[part] = (x.take(of) for x in (self.where.flat[lo:hi], number[_terms_of(edge, lo, hi)], self.count[lo:hi]))
        at = np.argsort(owner, kind="stable")
        owner, late, count = owner[at], late[at], count[at]
        del at
        rest = np.zeros(len(self.ids))
        for lo, hi in _parts(held):
            rest += np.bincount(owner[lo:hi], (self.grown[count[lo:hi]] * self.idf[numbered[late[lo:hi]]]) ** 2, minlength=len(rest))
        begin = np.searchsorted(owner, np.arange(len(rest) + 1))
        del owner
        place, weight, done = np.empty(int(light[-1]), self.where.flat.dtype), np.empty(int(light[-1])), 0
        for lo, hi in _parts(len(far), PART // 8):
            of = np.flatnonzero(~far[lo:hi])
            part = slice(done, done := done + len(of))
            place[part] = self.where.flat[lo:hi].take(of)
            weight[part] = self.grown[self.count[lo:hi].take(of)] * self.idf[_terms_of(edge, lo, hi).take(of)] * self.inverse[place[part]]
        rest = np.sqrt(rest) * self.inverse
        firsts = np.arange(0, len(rest), BLOCK)
        cuts = self.cuts - np.repeat(edge[:-1] - light[:-1], np.diff(self.block.edge))
        return Search(Lists(place, light), weight, cuts, number,
                      Lists(late, begin), count,
                      rest, np.maximum.reduceat(rest, firsts) if len(rest) else rest)

    def sieve(self) -> np.ndarray:
        return _sieve(self.terms)

    def vector(self, term: np.ndarray, count: np.ndarray) -> np.ndarray:
        w = (1 + np.log(count)) * self.idf[term]
        return w / max(np.sqrt((w * w).sum()), 1e-12)

    def nearest(self, term: np.ndarray, weight: np.ndarray, k: int, skip: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The k most similar examples (position, cosine), exact; those of the id ``skip`` are left out."""
        s, n = self.search, len(self.ids)
        best_at, best = np.zeros(0, np.int64), np.zeros(0)
        if n == 0:
            return best_at, best
        late = self.tail[term]
        query = np.zeros(int(s.number[-1]) + 1)  # over the tail
        query[s.number[term[late]]] = weight[late] * self.idf[term[late]]
        reach = np.sqrt((weight[late] ** 2).sum())
        term, weight = term[~late], weight[~late]
        entries = self.block.edge[term + 1] - self.block.edge[term]
        entry = _ranges(self.block.edge[term], entries)
        block, q = self.block.flat.take(entry), np.repeat(weight, entries)
        held = np.where(entries == 0, s.light.edge[term + 1] - s.light.edge[term], 0)  # rare terms: one by one
        post = _ranges(s.light.edge[term], held)
        rare = np.bincount(s.light.flat.take(post), s.weight.take(post) * np.repeat(weight, held), minlength=n)
        bound = (np.maximum.reduceat(rare, np.arange(0, n, BLOCK)) + np.bincount(block, q * self.top.take(entry), minlength=len(s.block_rest))
                 + reach * s.block_rest)
        order = np.argsort(-bound, kind="stable")
        lo, step = 0, OPEN
        while lo < len(order) and bound[order[lo]] > 0 and not (len(best) == k and bound[order[lo]] < best[-1] - SLACK):
            opened = np.zeros(len(order), bool)
            opened[order[lo:lo + step]] = True
            lo, step = lo + step, 2 * step
            sel = np.flatnonzero(opened.take(block))
            some = entry.take(sel)
            size = self.size.take(some).astype(np.int64)
            post = _ranges(s.cuts.take(some), size)
            sums = rare + np.bincount(s.light.flat.take(post), s.weight.take(post) * np.repeat(q[sel], size), minlength=n)
            at = np.flatnonzero(opened)[:, None] * BLOCK + np.arange(BLOCK)
            at = at[at < n]
            if skip is not None:
                at = at[self.ids[at] != skip]
            floor = best[-1] if len(best) == k else 0.0
            if len(at) >= k:  # a sum without its tail is a cosine's lower bound
                floor = max(floor, np.partition(sums[at], -k)[-k])
            upper = sums[at] + reach * s.rest[at]
            sel = (upper > 0) & (upper >= floor - SLACK)
            at, upper = at[sel], upper[sel]
            rank = np.argsort(-upper, kind="stable")
            at, upper = at[rank], upper[rank]
            first = 0
            while first < len(at) and not (len(best) == k and upper[first] < best[-1] - SLACK):
                some = at[first:first + COMPLETED]
                first += COMPLETED
                cosine = sums[some]
                if reach:
                    own = s.far.edge[some + 1] - s.far.edge[some]
                    post = _ranges(s.far.edge[some], own)
                    parts = np.append(query.take(s.far.flat.take(post)) * self.grown.take(s.count.take(post)), 0)
                    parts = np.add.reduceat(parts, np.cumsum(own) - own)
                    cosine = cosine + self.inverse[some] * np.where(own > 0, parts, 0)
                best_at, best = np.concatenate([best_at, some[cosine > 0]]), np.concatenate([best, cosine[cosine > 0]])
                rank = np.lexsort((best_at, -best))[:k]  # of equal cosines the smallest positions
                best_at, best = best_at[rank], best[rank]
        return best_at, best

    def vote(self, at: np.ndarray, cosine: np.ndarray) -> float:
        return float(((cosine * self.toxic[at]).sum() + SHRINK * self.base) / (cosine.sum() + SHRINK))


Curve = tuple[float, float]

def packed(index: Index) -> bytes:
    """The index as it travels: places as steps from posting to posting, then compressed (every executor keeps a copy on disk)."""
    where = index.where.flat
    steps = np.diff(where, prepend=where.dtype.type(0)) if len(where) else where
    return zlib.compress(pickle.dumps(replace(index, where=Lists(steps, index.where.edge)), 5), 1)


def unpacked(data: bytes) -> Index:
    index = pickle.loads(zlib.decompress(data))
    steps = index.where.flat
    np.cumsum(steps, dtype=steps.dtype, out=steps)
    return index


def opened(shared: Broadcast, name: str) -> Index:
    def make() -> Index:
        index = unpacked(shared.value)
        index.search  # holds the postings from now on  # noqa: B018
        index.where, index.count = Lists(index.where.flat[:0].copy(), index.where.edge), index.count[:0].copy()
        return index
    return keep(name, make)


def calibrated(vote: float, curve: Curve) -> float:
    a, b = curve
    return float(1 / (1 + np.exp(-np.clip(a * np.log(vote / (1 - vote)) + b, -35, 35))))


class Fitted(NamedTuple):
    """An index, sent to the executors once, and the curve of its votes."""
    index: Index
    shared: Broadcast  # of ``packed(index)``
    name: str
    curve: Curve


def _calibrate(votes: np.ndarray, toxic: np.ndarray) -> tuple[float, float]:
    """Logistic curve over the log odds of the votes, by Newton steps with a weak prior on (1, 0)."""
    x = np.stack([np.log(votes / (1 - votes)), np.ones(len(votes))], axis=1)
    c = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ c, -35, 35)))
        grad = x.T @ (toxic - p) - 0.1 * (c - [1.0, 0.0])
        hess = (x * (p * (1 - p))[:, None]).T @ x + 0.1 * np.eye(2)
        step = np.linalg.solve(hess, grad)
        c = c + np.clip(step, -1, 1)
        if np.abs(step).max() < 1e-9:
            break
    return float(max(c[0], 0.0)), float(c[1])


def examples(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text",
             label_col: str = "toxic") -> DataFrame:
    """doc_id, text, toxic of the bounded training sample."""
    chosen = (labels.where(F.col(id_col).isNotNull() & F.col(label_col).isNotNull() & ~held_out(id_col))
              .groupBy(F.col(id_col).alias("l_id")).agg(F.max(label_col).cast("int").alias("toxic"))
              .orderBy(F.xxhash64("l_id"), "l_id").limit(MAX_EXAMPLES))
    return (docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
            .join(F.broadcast(chosen), F.col("doc_id") == F.col("l_id"))  # at most MAX_EXAMPLES rows
            .select("doc_id", "text", "toxic"))


def choose_terms(sample: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(terms, sorted, and their weights) of the terms in at least ``MIN_DF`` examples; none without both classes."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches, max_bytes=1 << 20):
            term, own = _terms(b)
            order = np.lexsort((own, term))
            term, own = term[order], own[order]
            new = np.ones(len(term), bool)
            new[1:] = (term[1:] != term[:-1]) | (own[1:] != own[:-1])
            term, own = term[new], own[new]
            toxic = column(b.rows, "toxic").to_numpy(zero_copy_only=False)[own]
            term, at, n = np.unique(term, return_inverse=True, return_counts=True)
            yield pa.record_batch({"term": term.view(np.int64), "n": n.astype(np.int64),
                                   "p": np.bincount(at, toxic, len(term)).astype(np.int64)})

    sizes = sample.agg(F.sum("toxic").alias("p"), F.count("*").alias("n")).first()
    toxic, size = int(sizes.p or 0), int(sizes.n)
    if not 0 < toxic < size:
        return np.zeros(0, np.uint64), np.zeros(0)
    rows = (sample.mapInArrow(count, "term long, n long, p long").groupBy("term").agg(F.sum("n").alias("n"), F.sum("p").alias("p"))
            .where(F.col("n") >= MIN_DF).select("term", F.col("n").cast("int"), F.col("p").cast("int")).toArrow())  # bounded by the sample's words
    term, n, p = rows["term"].to_numpy().view(np.uint64), rows["n"].to_numpy(), rows["p"].to_numpy()
    odds = np.log((p + 0.5) / (toxic - p + 0.5)) - np.log((n - p + 0.5) / (size - toxic - (n - p) + 0.5))
    order = np.argsort(term)
    return term[order], ((np.log((1 + size) / (1 + n)) + 0.1) * np.abs(odds) ** LEAN)[order]


def _small(a: np.ndarray) -> np.ndarray:
    """The same whole numbers in the smallest unsigned type that holds them."""
    return a.astype(np.min_scalar_type(int(a.max(initial=0))))


def _sent(term: np.ndarray, count: np.ndarray) -> bytes:
    """Postings as they travel: steps from term to term, byte by byte, and counts, compressed."""
    steps = np.diff(term, prepend=0).astype("<i4").view(np.uint8).reshape(-1, 4)
    return zlib.compress(steps.T.tobytes() + count.astype("<i4").view(np.uint8).reshape(-1, 4).T.tobytes(), 1)


def _received(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(term, count) of every posting that was sent."""
    columns = np.frombuffer(zlib.decompress(data), np.uint8).reshape(2, 4, -1)
    steps, count = (np.ascontiguousarray(x.T).view("<i4").ravel() for x in columns)
    return np.cumsum(steps, dtype=np.int32), count


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Fitted:
    prepare(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    sample = cut_lineage(examples(docs, labels, id_col, text_col, label_col), "toxic-examples")
    terms, idf = choose_terms(sample)
    size = sample.count()
    chosen = docs.sparkSession.sparkContext.broadcast(terms)

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sieve = _sieve(chosen.value)
        for b in blocks(batches):
            own, term, n = _counts(b, chosen.value, sieve)
            ids, toxic = (column(b.rows, x).to_numpy(zero_copy_only=False) for x in ("doc_id", "toxic"))
            yield pa.record_batch({
                "ids": pa.array([ids], pa.list_(pa.int64())), "toxic": pa.array([toxic], pa.list_(pa.int32())),
                "sizes": pa.array([np.bincount(own, minlength=b.n)], pa.list_(pa.int32())),
                "most": pa.array([int(n.max(initial=0))], pa.int64()), "postings": pa.array([_sent(term, n)], pa.binary())})

    rows = sample.mapInArrow(vectors, "ids array<long>, toxic array<int>, sizes array<int>, most long, postings binary").toArrow()  # bounded sample
    chosen.destroy()
    ids, toxic, sizes = (np.concatenate([np.zeros(0, kind), *[c.flatten().to_numpy() for c in rows[x].chunks]])
                         for x, kind in (("ids", np.int64), ("toxic", np.int32), ("sizes", np.int32)))
    base = min(max(float(toxic.mean()), 1e-6), 1 - 1e-6) if len(toxic) else 0.5
    sizes = sizes.astype(np.int64)
    most = max(rows["most"].to_pylist(), default=0)
    term, count = np.empty(int(sizes.sum()), np.int32), np.empty(int(sizes.sum()), np.min_scalar_type(most))
    done = 0
    for sent in (x for c in rows["postings"].chunks for x in c):  # postings are many: a block's are unpacked at a time
        some, n = _received(sent.as_py())
        term[done:done + len(some)], count[done:done + len(some)] = some, n
        done += len(some)
    del rows
    index = _index(terms, idf, ids, toxic, sizes, term, count, base)
    del term, count
    shared, name = docs.sparkSession.sparkContext.broadcast(packed(index)), uuid.uuid4().hex
    if not 0 < toxic.sum() < len(toxic):
        return Fitted(index, shared, name, (1.0, 0.0))

    def leave_one_out(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = opened(shared, name)
        sieve = ix.sieve()
        for b in blocks(batches):
            own, term, n = _counts(b, ix.terms, sieve)
            edge = np.searchsorted(own, np.arange(b.n + 1))
            votes = np.full(b.n, ix.base)
            for i, doc in enumerate(column(b.rows, "doc_id").to_pylist()):
                t = term[edge[i]:edge[i + 1]]
                if len(t):
                    votes[i] = ix.vote(*ix.nearest(t, ix.vector(t, n[edge[i]:edge[i + 1]]), NEIGHBOURS, skip=doc))
            yield pa.record_batch({"doc_id": column(b.rows, "doc_id"), "vote": votes, "toxic": column(b.rows, "toxic")})

    # One small row an example; sorted here, as a sort in Spark would compute the votes twice to sample them.
    votes = sample.repartition(-(-size // 256)).mapInArrow(leave_one_out, "doc_id long, vote double, toxic int").toArrow()
    votes = votes.sort_by([("doc_id", "ascending"), ("vote", "ascending")])
    return Fitted(index, shared, name, _calibrate(votes["vote"].to_numpy(), votes["toxic"].to_numpy()))


def _index(terms: np.ndarray, idf: np.ndarray, ids: np.ndarray, toxic: np.ndarray, sizes: np.ndarray, term: np.ndarray,
           count: np.ndarray, base: float) -> Index:
    """The index of examples with ``sizes`` postings each."""
    first = np.concatenate([[0], np.cumsum(sizes)])
    idf32 = idf.astype(np.float32)
    # examples with the same leading term share blocks, which keeps the block maxima tight
    mass, lead, most = np.zeros(len(sizes)), np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.float32)
    counts: list[np.ndarray] = [np.zeros(0, count.dtype)]
    starts = np.searchsorted(first, np.arange(0, first[-1], PART // 8), side="right") - 1
    for a, z in zip(starts, np.append(starts[1:], len(sizes))[:len(starts)], strict=True):  # whole examples
        part = slice(first[a], first[z])
        own, weight = np.repeat(np.arange(a, z), sizes[a:z]), (1 + np.log(count[part], dtype=np.float32)) * idf32[term[part]]
        mass[a:z] = np.bincount(own - a, weight, minlength=z - a)
        np.maximum.at(most, own, weight)
        is_most = np.flatnonzero(weight == most[own])
        some = a + np.flatnonzero(sizes[a:z])
        lead[some] = term[part][is_most[np.searchsorted(is_most, first[some] - first[a])]]
        if mass[a:z].any():
            counts.append(np.unique(count[part][mass[own] > 0]))
    full = np.flatnonzero(mass > 0)  # examples with a vector
    order = full[np.lexsort((ids[full], -most[full], lead[full]))]
    place = np.full(len(sizes), -1, np.int32)
    place[order] = np.arange(len(order))
    distinct = np.unique(np.concatenate(counts))
    # Postings by term, then place: examples come in the order of their places, and a term's go on where its last ended.
    held = np.zeros(len(terms), np.int64)
    for lo, hi in _parts(len(term), PART // 8):
        held += np.bincount(term[lo:hi][place[_terms_of(first, lo, hi)] >= 0], minlength=len(terms))
    edge = np.concatenate([[0], np.cumsum(held)])
    where, code = np.empty(edge[-1], np.min_scalar_type(max(len(order) - 1, 0))), np.empty(edge[-1], np.min_scalar_type(max(len(distinct), 1) - 1))
    free = edge[:-1].copy()
    ends = np.cumsum(sizes[order])
    starts = np.searchsorted(ends, np.arange(0, edge[-1], PART // 8), side="right")
    for a, z in zip(starts, np.append(starts[1:], len(order))[:len(starts)], strict=True):  # whole examples
        own = sizes[order[a:z]]
        at = _ranges(first[order[a:z]], own)
        by = np.argsort(term[at], kind="stable")
        at = at[by]
        of = term[at]
        new = np.flatnonzero(np.diff(of, prepend=-1))
        run = np.diff(np.append(new, len(of)))
        to = np.arange(len(of)) + np.repeat(free[of[new]] - new, run)
        where[to], code[to] = np.repeat(np.arange(a, z), own)[by], np.searchsorted(distinct, count[at])
        free[of[new]] += run
    # Lengths and weights in double precision, as queries recompute them.
    grown = 1 + np.log(distinct, dtype=float)
    norm, mass = np.zeros(len(order)), np.zeros(len(terms))
    for lo, hi in _parts(len(where)):
        norm += np.bincount(where[lo:hi], (grown[code[lo:hi]] * idf[_terms_of(edge, lo, hi)]) ** 2, minlength=len(order))
    norm = np.sqrt(norm)
    for lo, hi in _parts(len(where)):
        of = _terms_of(edge, lo, hi)
        mass += np.bincount(of, (grown[code[lo:hi]] * idf[of] / norm[where[lo:hi]]) ** 2, minlength=len(terms))
    often = np.diff(edge) >= FREQUENT
    light = np.flatnonzero(often)[np.argsort(idf[often], kind="stable")]
    tail = np.zeros(len(terms), bool)
    tail[light[np.cumsum(mass[light]) <= TAIL * len(order)]] = True
    frequent = np.repeat(often & ~tail, np.diff(edge))
    new = np.ones(len(where), bool)
    new[1:] = where[1:] // BLOCK != where[:-1] // BLOCK
    new[edge[:-1][np.diff(edge) > 0]] = True
    cuts = np.flatnonzero(new & frequent)
    del new
    of = np.searchsorted(edge, cuts, side="right") - 1
    stop = np.minimum(np.append(cuts[1:], len(where)), edge[of + 1]) if len(cuts) else cuts
    top = np.zeros(len(cuts), np.float32)
    for lo, hi in _parts(len(cuts), max(PART // (8 * BLOCK), 1)):
        size = stop[lo:hi] - cuts[lo:hi]
        post = _ranges(cuts[lo:hi], size)
        weight = grown[code[post]] * idf[np.repeat(of[lo:hi], size)] / norm[where[post]]
        top[lo:hi] = np.nextafter(np.maximum.reduceat(weight, np.cumsum(size) - size).astype(np.float32), np.float32(np.inf))
    return Index(terms, idf, ids[order], toxic[order].astype(float), 1 / norm,
                 grown, Lists(where, edge), code, tail,
                 Lists(_small(where[cuts] // BLOCK), np.searchsorted(of, np.arange(len(terms) + 1))), top,
                 cuts.astype(np.int32 if len(where) < 1 << 31 else np.int64), _small(stop - cuts), base)


def score(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, score, predicted and evidence (nearest examples' ids) of every document."""
    shared, name, curve = fitted.shared, fitted.name, fitted.curve
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), held_out(id_col).alias("held_out"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType()), T.StructField("evidence", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = opened(shared, name)
        sieve = ix.sieve()
        bare = calibrated(ix.base, curve)
        for b in blocks(batches):
            own, term, n = _counts(b, ix.terms, sieve)
            edge = np.searchsorted(own, np.arange(b.n + 1))
            scores = np.full(b.n, bare)
            evidence: list[list[int]] = [[] for _ in range(b.n)]
            for i in np.flatnonzero(np.diff(edge)).tolist():
                t = term[edge[i]:edge[i + 1]]
                at, cosine = ix.nearest(t, ix.vector(t, n[edge[i]:edge[i + 1]]), NEIGHBOURS)
                scores[i] = calibrated(ix.vote(at, cosine), curve)
                evidence[i] = ix.ids[at[:EVIDENCE]].tolist()
            yield pa.record_batch({"doc_id": column(b.rows, "doc_id"), "held_out": column(b.rows, "held_out"), "score": scores,
                                   "predicted": (scores >= THRESHOLD).astype(np.int32),
                                   "evidence": pa.array(evidence, pa.list_(pa.int64()))})

    return source.mapInArrow(run, schema)


def drop_toxic(docs: DataFrame, fitted: Fitted, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents that are not predicted toxic, in the columns they came with.

    A document without neighbours has no evidence against it and stays, whatever
    the base rate; so all stay where the labels are not of both classes.
    """
    shared, name, curve = fitted.shared, fitted.name, fitted.curve
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ix = opened(shared, name)
        sieve = ix.sieve()
        for batch in batches:
            kept = np.ones(batch.num_rows, bool)
            done = 0
            for b in blocks([batch.select([text_col])], text_col):
                own, term, n = _counts(b, ix.terms, sieve)
                edge = np.searchsorted(own, np.arange(b.n + 1))
                for i in np.flatnonzero(np.diff(edge)).tolist():
                    t = term[edge[i]:edge[i + 1]]
                    at, cosine = ix.nearest(t, ix.vector(t, n[edge[i]:edge[i + 1]]), NEIGHBOURS)
                    kept[done + i] = not len(at) or calibrated(ix.vote(at, cosine), curve) < THRESHOLD
                done += b.n
            for lo in range(0, batch.num_rows, SENT):
                yield batch.slice(lo, SENT).select(names).filter(pa.array(kept[lo:lo + SENT]))

    return docs.mapInArrow(run, docs.schema)


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
