"""Removing repeated windows exactly: the Spark plan shared by operators 3 and 7.

Both operators ask the same question of different units (words, bytes): which
windows of ``width`` units also start in a document with a smaller id? They
differ in how a document is *parsed*: a parser cuts every document into
segments, runs of consecutive windows governed by one anchor that is chosen
from the window's content alone, so equal windows always have equal anchor
keys. A segment's *probes* are hashes of more content around its anchor; equal
windows share one of them, and chance rarely does. The plan then never handles
all windows:

0. ``_contents``: a text that a smaller id also has, whole (128 bits of it are
   compared), is one span. Only the first holder goes through steps 2 and 3.
1. ``_shared_keys``: (probe, content) pairs are dealt by probe; a probe seen in
   one content only needs no more work. Most text ends here. Pairs travel
   packed, ten bytes each, in one row for each bucket of probes and flush.
2. ``_segments``: documents that hold shared probes are parsed again, and only
   segments with a shared probe are dealt by key. Equal segments (128-bit content
   fingerprints) meet: all windows of a later document's copy are repeats, in
   one row. What remains open is a first copy whose key also stands in
   *different* segments - the rims of shared passages.
3. ``_open_windows``: only those rims are compared window by window.
4. ``removed_spans`` collects each document's spans.

A probe is told apart by 44 of its bits and one held by a content by 32: two
taken for one cost work in step 2 and change no result. Contents are told apart
by 48 bits in step 1. Buckets are met one at a time, other dealt groups are
streamed in sorted order with constant state, and equal rows
are merged per task before they are dealt. A key with many different segments
in one task (the rim of a passage that a third of all documents holds) is dealt
by segment instead, and one marker row tells the key's other rows that it has
several; rims of keys with more than ``HOT`` open segments are dealt by window.
All stages end in tables in the shared folder, so a lost executor costs a stage
at most.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tillcast.session import cut_lineage

from .blocks import Block, blocks, column, list_sizes, mix
from .common import prepare

FLUSH_ROWS = 1 << 18   # rows merged in a task before they are dealt
PACK_ROWS = 1 << 20    # pairs merged in a task before they are dealt packed; their numbers fit in _AT
BUCKETS = 12           # bits: packed pairs are dealt in 4,096 buckets, by their probe or by their content
HOT = 4096             # open segments of one key that are still compared in one task
RIMS = 32              # different segments of one key in one flush from which on they are dealt one by one


class Parsed(NamedTuple):
    """Segments of a block, in text order."""
    key: np.ndarray    # uint64 anchor key
    own: np.ndarray    # document of the block
    start: np.ndarray  # first unit, counted in the document
    n: np.ndarray      # windows
    prints: Callable[[np.ndarray], tuple[np.ndarray, np.ndarray]]  # segments -> two uint64 fingerprints of the covered units
    probe: np.ndarray  # uint64 hashes of content that some windows of a segment hold, and all windows equal to them
    of: np.ndarray     # their segments; every window has its probe


class Units(NamedTuple):
    """How documents are parsed, and how segments are packed and unfold into windows."""
    width: int
    parse: Callable[[Block], Parsed]
    pack: Callable[[Block, np.ndarray, np.ndarray, np.ndarray], list[bytes]]  # document, start, windows -> what tells the windows apart
    unfold: Callable[[list[bytes], np.ndarray], np.ndarray]  # packs and window counts -> one row of uint64 a window
    one: Callable[[bytes, int], bytes]                       # a pack and a window's number -> the window's own pack


def identified(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, text: th tells apart rows that repeat an id with another text."""
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))


def _i64(x: np.ndarray) -> np.ndarray:
    return x.view(np.int64)


def _np(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return column(batch, name).to_numpy(zero_copy_only=False)


def _u64(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return _np(batch, name).view(np.uint64)


class _Buffer:
    """Column chunks until there are FLUSH_ROWS of them."""

    def __init__(self) -> None:
        self.chunks: list[tuple[np.ndarray, ...]] = []
        self.rows = 0

    def add(self, *cols: np.ndarray) -> bool:
        self.chunks.append(cols)
        self.rows += len(cols[0])
        return self.rows >= FLUSH_ROWS

    def take(self) -> list[np.ndarray]:
        cols = [np.concatenate(c) for c in zip(*self.chunks, strict=True)]
        self.chunks, self.rows = [], 0
        return cols


def _starts(*cols: np.ndarray) -> np.ndarray:
    """Where a new group of equal neighbours begins."""
    new = np.ones(len(cols[0]), bool)
    new[1:] = False
    for c in cols:
        new[1:] |= c[1:] != c[:-1]
    return new


def _group_of(new: np.ndarray) -> np.ndarray:
    return np.cumsum(new) - 1


class _Stream:
    """Groups of rows sorted by (key, sub, doc), over any number of batches.

    ``feed`` returns the rows of held and new rows whose key is known to have
    several different subs, and for each row whether its document is later than
    the first one of its (key, sub). Rows of a key with one sub so far are held
    only while they are of the sub's first document; later documents' rows do
    not depend on the key and are returned at once.
    """

    def __init__(self) -> None:
        self.key: int | None = None
        self.sub: tuple = ()
        self.first = 0
        self.many = False
        self.held: list[pa.RecordBatch] = []

    def feed(self, batch: pa.RecordBatch, key: np.ndarray, subs: list[np.ndarray], doc: np.ndarray
             ) -> tuple[list[pa.RecordBatch], np.ndarray, np.ndarray]:
        n = len(key)
        new_key, new_sub = _starts(key), _starts(key, *subs)
        goes_on = self.key is not None and int(key[0]) == self.key
        same_sub = goes_on and tuple(int(s[0]) for s in subs) == self.sub
        kg, sg = _group_of(new_key), _group_of(new_sub)
        first = doc[new_sub][sg]
        if same_sub:
            first = np.where(sg == 0, self.first, first)
        several = np.bincount(kg[new_sub & ~new_key], minlength=kg[-1] + 1) > 0
        if goes_on and (self.many or not same_sub):
            several[0] = True
        released: list[pa.RecordBatch] = []
        if goes_on and several[0]:
            released, self.held = self.held, []
        elif not goes_on:
            self.held = []
        later = doc > first
        last = kg == kg[-1]
        if not several[-1]:
            wait = np.flatnonzero(last & ~later)
            if len(wait):
                self.held.append(batch.take(pa.array(wait)))
        self.key, self.many = int(key[-1]), bool(several[-1])
        self.sub, self.first = tuple(int(s[-1]) for s in subs), int(first[-1])
        return released, several[kg], later


def _dealt(df: DataFrame, *order: str) -> DataFrame:
    return df.repartition("deal").sortWithinPartitions("deal", *order)


# --- 0. texts that stand in several documents -------------------------------------------------

def _contents(source: DataFrame, width: int) -> DataFrame:
    """doc_id, th, content of every text that may have a window."""
    return source.where(F.octet_length("text") >= width).select("doc_id", "th", F.unhex(F.md5("text")).alias("content"))


def _first_holders(contents: DataFrame) -> DataFrame:
    """th, content, first: the smallest id that has the content."""
    return contents.groupBy("th", "content").agg(F.min("doc_id").alias("first"))


# --- 1. probes that stand in several contents -------------------------------------------------

_AT = np.uint64(20)    # bits of a pair's number in its flush; above them stand the 44 bits of a probe that count
_TAG = 48              # bits of a content in a pair
_PAIRS = "deal int, keys binary, tags binary"


def _binaries(rows: np.ndarray, at: np.ndarray) -> pa.Array:
    """The rows' bytes, one binary for each group that begins at ``at``."""
    ends = np.append(at, len(rows)).astype(np.int32) * np.int32(rows.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def _bytes_of(col: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary column in rows of ``width``, and how many rows each value has."""
    if not len(col):
        return np.zeros((0, width), np.uint8), np.zeros(0, np.int64)
    offs = np.frombuffer(col.buffers()[1], np.int32)[col.offset:col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2], np.uint8)[offs[0]:offs[-1]]
    return data.reshape(-1, width), np.diff(offs) // width


def _pack(deal: np.ndarray, key: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
    """Pairs sorted by ``deal``, one row for each."""
    at = np.flatnonzero(_starts(deal))
    return pa.record_batch({"deal": pa.array(deal[at].astype(np.int32)),
                            "keys": _binaries(key.astype(np.uint32).view(np.uint8).reshape(-1, 4), at),
                            "tags": _binaries(tag.view(np.uint8).reshape(-1, 8)[:, :_TAG // 8], at)})


def _unpack(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """key, tag of all pairs of the rows."""
    key, _ = _bytes_of(column(batch, "keys"), 4)
    short, _ = _bytes_of(column(batch, "tags"), _TAG // 8)
    tag = np.zeros((len(short), 8), np.uint8)
    tag[:, :_TAG // 8] = short
    return key.copy().view(np.uint32)[:, 0].astype(np.uint64), tag.view(np.uint64)[:, 0]


def _shared(value: np.ndarray, tag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs sorted by value: which begin a value, and which have one that several contents hold."""
    head = _starts(value)
    first = np.flatnonzero(head)
    size = np.diff(np.append(first, len(value)))
    other = np.logical_or.reduceat(tag != np.repeat(tag[first], size), first)
    return head, np.repeat(other, size)


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by ``deal``: those of each bucket, whole."""
    waiting: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        deal = _np(batch, "deal")
        at = np.flatnonzero(_starts(deal)).tolist()
        for lo, hi in zip(at, [*at[1:], batch.num_rows], strict=True):
            if waiting and column(waiting[-1], "deal")[0].as_py() != int(deal[lo]):
                yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                waiting = []
            waiting.append(batch.slice(lo, hi - lo))
    if waiting:
        yield pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]


def _by_content(key: np.ndarray, tag: np.ndarray) -> pa.RecordBatch:
    """Pairs, dealt by content."""
    order = np.argsort(tag)
    tag = tag[order]
    return _pack(tag >> np.uint64(_TAG - BUCKETS), key[order], tag)


def probe_key(probe: np.ndarray) -> np.ndarray:
    """The bits of a probe that a content's list has."""
    return (probe >> _AT).astype(np.uint32)


def _shared_keys(source: DataFrame, units: Units) -> DataFrame:
    """tag, keys (packed, 32 bits each) of the contents that hold shared probes."""

    def emit(buf: _Buffer) -> Iterator[pa.RecordBatch]:
        probes, tags = buf.take()
        for lo in range(0, len(probes), 1 << int(_AT)):
            probe, tag = probes[lo:lo + (1 << int(_AT))], tags[lo:lo + (1 << int(_AT))]
            number = np.arange(len(probe), dtype=np.uint64)
            ranked = np.sort(probe >> _AT << _AT | number)
            value, tag = ranked >> _AT, tag[(ranked & np.uint64((1 << int(_AT)) - 1)).astype(np.int64)]
            keep = _starts(value, tag)                # a probe's pairs stay in reading order, so one content's lie together
            value, tag = value[keep], tag[keep]
            head, known = _shared(value, tag)         # known: shared inside this task already
            rows = _by_content(value[known] & np.uint64(0xFFFFFFFF), tag[known])
            yield rows.append_column("known", pa.array(np.ones(rows.num_rows, bool)))
            ask = ~known | head                       # one of them still tells the other tasks
            rows = _pack(value[ask] >> np.uint64(32), value[ask], tag[ask])
            yield rows.append_column("known", pa.array(np.zeros(rows.num_rows, bool)))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buf = _Buffer()
        for b in blocks(batches):
            p = units.parse(b)
            buf.add(p.probe, _u64(b.rows, "tag")[p.own[p.of]])
            if buf.rows >= PACK_ROWS:
                yield from emit(buf)
        if buf.rows:
            yield from emit(buf)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buf = _Buffer()
        for bucket in _buckets(batches):
            known = column(bucket, "known")
            buf.add(*_unpack(bucket.filter(known)))
            key, tag = _unpack(bucket.filter(pc.invert(known)))
            if len(key):
                ranked = np.sort(key << np.uint64(32) | np.arange(len(key), dtype=np.uint64))
                key, tag = ranked >> np.uint64(32), tag[(ranked & np.uint64(0xFFFFFFFF)).astype(np.int64)]
                several = _shared(key, tag)[1]
                buf.add(key[several], tag[several])
            if buf.rows >= PACK_ROWS:
                yield _by_content(*buf.take())
        if buf.rows:
            yield _by_content(*buf.take())

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket in _buckets(batches):
            key, tag = _unpack(bucket)
            order = np.lexsort((key, tag))
            key, tag = key[order], tag[order]
            keep = _starts(tag, key)
            key, tag = key[keep], tag[keep]
            at = np.flatnonzero(_starts(tag))
            yield pa.record_batch({"tag": _i64(tag[at]), "keys": _binaries(key.astype(np.uint32).view(np.uint8).reshape(-1, 4), at)})

    tagged = source.select(F.shiftrightunsigned("th", 64 - _TAG).alias("tag"), "text")
    pairs = _dealt(tagged.mapInArrow(scan, f"{_PAIRS}, known boolean")).mapInArrow(meet, _PAIRS)
    return _dealt(pairs).mapInArrow(collect, "tag long, keys binary")


# --- 2. equal segments ------------------------------------------------------------------------

def _member(own: np.ndarray, key: np.ndarray, lists: pa.Array) -> np.ndarray:
    """Whether each key is in its document's list."""
    flat, sizes = _bytes_of(lists, 4)
    tag = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
    known = np.sort(mix(flat.copy().view(np.uint32)[:, 0] + mix(tag + np.uint64(1))))
    want = mix(key + mix(own.astype(np.uint64) + np.uint64(1)))
    if not len(known):
        return np.zeros(len(key), bool)
    return known[np.minimum(np.searchsorted(known, want), len(known) - 1)] == want


def _chained(p: Parsed, at: np.ndarray, f1: np.ndarray, f2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Periodic text repeats one segment back to back: (which of ``at`` begin a
    chain of equal adjacent segments, and how many each chain has)."""
    goes_on = np.zeros(len(at), bool)
    a, b = at[:-1], at[1:]
    goes_on[1:] = ((b == a + 1) & (p.own[b] == p.own[a]) & (p.key[b] == p.key[a]) & (p.n[b] == p.n[a])
                   & (f1[1:] == f1[:-1]) & (f2[1:] == f2[:-1]) & (p.start[b] == p.start[a] + p.n[a]))
    head = np.flatnonzero(~goes_on)
    return head, np.diff(np.append(head, len(at)))


_SEG = "doc_id long, th long, start long, n long, times long, key long"


def _segments(source: DataFrame, keys: DataFrame, units: Units) -> DataFrame:
    """keys: doc_id, th, keys of the documents to look at. doc_id, th, start, n, times, key, open: repeated segments (open false) and
    rims still to be compared; ``times``: adjacent repetitions of the segment."""
    names = ["deal", "f1", "f2", "doc_id", "th", "start", "n", "times", "key", "known", "spread"]

    def emit(buf: _Buffer) -> pa.RecordBatch:
        cols = buf.take()
        order = np.lexsort((cols[3], cols[2], cols[1], cols[0]))
        key, f1, f2, doc, th, start, n, times = (c[order] for c in cols)
        new = _starts(key, f1, f2)
        known = doc > doc[new][_group_of(new)]       # an earlier document of this task has it
        head = _starts(key)
        spread = ~known & (np.bincount(_group_of(head)[~known & new], minlength=int(head.sum())) > RIMS)[_group_of(head)]
        deal = np.where(known, mix(f1 ^ mix(doc.view(np.uint64))), np.where(spread, mix(key ^ mix(f1)), key))
        # a marker: to the rows that other tasks deal by this key, one more segment
        mark = key[head][np.bincount(_group_of(head)[spread], minlength=int(head.sum())) > 0]
        m = len(mark)
        ones, zeros = np.full(m, -1, np.int64), np.zeros(m, np.int64)
        cols = [(_i64(deal), _i64(mark)), (_i64(f1), ones), (_i64(f2), ones), (doc, np.full(m, np.iinfo(np.int64).max)), (th, zeros),
                (start, zeros), (n, zeros), (times, zeros), (_i64(key), _i64(mark)), (known, zeros > 0), (spread, zeros > 0)]
        return pa.record_batch({name: np.concatenate(c) for name, c in zip(names, cols, strict=True)})

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buf = _Buffer()
        for b in blocks(batches):
            p = units.parse(b)
            at = np.unique(p.of[_member(p.own[p.of], probe_key(p.probe), column(b.rows, "keys"))])
            if not len(at):
                continue
            f1, f2 = p.prints(at)
            head, times = _chained(p, at, f1, f2)
            at = at[head]
            if buf.add(p.key[at], f1[head], f2[head], _np(b.rows, "doc_id")[p.own[at]], _np(b.rows, "th")[p.own[at]],
                       p.start[at], p.n[at], times):
                yield emit(buf)
        if buf.rows:
            yield emit(buf)

    out = ["doc_id", "th", "start", "n", "times", "key"]

    def told(batch: pa.RecordBatch, is_open: bool) -> pa.RecordBatch:
        batch = batch.filter(pc.greater(column(batch, "n"), 0))  # markers stay here
        return batch.select(out).append_column("open", pa.array(np.full(batch.num_rows, is_open)))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, apart = _Stream(), _Stream()
        for batch in batches:
            known = _np(batch, "known")
            if known.any():
                yield told(batch.filter(pa.array(known)), False)
                batch = batch.filter(pa.array(~known))
            spread = _np(batch, "spread")
            if spread.any():
                rows = batch.filter(pa.array(spread))
                batch = batch.filter(pa.array(~spread))
                _, _, later = apart.feed(rows, _u64(rows, "deal"), [_u64(rows, "f1"), _u64(rows, "f2")], _np(rows, "doc_id"))
                yield told(rows.filter(pa.array(later)), False)
                yield told(rows.filter(pa.array(~later)), True)
            if batch.num_rows:
                released, several, later = state.feed(batch, _u64(batch, "key"), [_u64(batch, "f1"), _u64(batch, "f2")], _np(batch, "doc_id"))
                for r in released:
                    yield told(r, True)
                if later.any():
                    yield told(batch.filter(pa.array(later)), False)
                rim = several & ~later
                if rim.any():
                    yield told(batch.filter(pa.array(rim)), True)

    rows = source.join(keys, ["doc_id", "th"]).mapInArrow(
        scan, "deal long, f1 long, f2 long, doc_id long, th long, start long, n long, times long, key long, "
        "known boolean, spread boolean")
    return _dealt(rows, "f1", "f2", "doc_id").mapInArrow(meet, f"{_SEG}, open boolean")


# --- 3. rims, window by window ----------------------------------------------------------------

def _open_windows(source: DataFrame, rims: DataFrame, units: Units) -> DataFrame:
    """doc_id, th, start, n of the repeated windows inside rims."""
    hot = (rims.groupBy("key").count().where(F.col("count") > HOT)
           .select("key", F.lit(True).alias("hot")))
    per_doc = (rims.join(hot, "key", "left").groupBy("doc_id", "th")
               .agg(F.collect_list(F.struct("start", "n", "key", "times", F.coalesce("hot", F.lit(False)).alias("hot"))).alias("rims")))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            lists = column(b.rows, "rims")
            flat = lists.flatten()
            owner = np.repeat(np.arange(b.n), list_sizes(lists))
            start, sizes, times = (flat.field(c).to_numpy() for c in ("start", "n", "times"))
            key = flat.field("key").to_numpy().view(np.uint64)
            is_hot = flat.field("hot").to_numpy(zero_copy_only=False)
            doc, th = _np(b.rows, "doc_id")[owner], _np(b.rows, "th")[owner]
            packs = units.pack(b, owner, start, sizes)
            # cold keys: one row a rim; hot keys: one row a window
            cold = np.flatnonzero(~is_hot)
            yield _rim_rows(key[cold], doc[cold], th[cold], start[cold], sizes[cold], sizes[cold], times[cold], [packs[i] for i in cold.tolist()])
            warm = np.flatnonzero(is_hot)
            if len(warm):
                row = np.repeat(warm, sizes[warm])
                at = np.arange(len(row)) - np.repeat(np.cumsum(sizes[warm]) - sizes[warm], sizes[warm])
                own = [units.one(packs[i], j) for i, j in zip(row.tolist(), at.tolist(), strict=True)]
                deal = np.fromiter((xxhash.xxh64_intdigest(x) for x in own), np.uint64, len(own))
                yield _rim_rows(deal, doc[row], th[row], start[row] + at, np.ones(len(row), np.int64), sizes[row], times[row], own)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        rows = 0
        for batch in batches:  # sorted by key: whole keys are compared together, a bounded number at a time
            key = _np(batch, "deal")
            waiting.append(batch)
            rows += len(key)
            if rows >= 4 * HOT and key[0] != key[-1]:
                cut = int(np.flatnonzero(key != key[-1])[-1]) + 1
                waiting[-1] = batch.slice(0, cut)
                yield from _compare(waiting, units)
                waiting, rows = [batch.slice(cut)], len(key) - cut
        if waiting:
            yield from _compare(waiting, units)

    rows = source.join(per_doc, ["doc_id", "th"]).mapInArrow(
        scan, "deal long, doc_id long, th long, start long, n long, step long, times long, pack binary")
    return _dealt(rows).mapInArrow(meet, "doc_id long, th long, start long, n long")


def _rim_rows(key, doc, th, start, n, step, times, packs) -> pa.RecordBatch:
    return pa.record_batch({"deal": _i64(key), "doc_id": doc, "th": th, "start": start, "n": n, "step": step, "times": times, "pack": pa.array(packs, pa.binary())})


def _compare(parts: list[pa.RecordBatch], units: Units) -> Iterator[pa.RecordBatch]:
    """Sort all windows of some whole keys; those that an earlier document also has are repeats."""
    t = pa.Table.from_batches(parts).combine_chunks().to_batches()
    if not t:
        return
    batch = t[0]
    n, doc, th, start, step, times = (_np(batch, c) for c in ("n", "doc_id", "th", "start", "step", "times"))
    ids = units.unfold(column(batch, "pack").to_pylist(), n)
    row = np.repeat(np.arange(len(n)), n)
    pos = start[row] + np.arange(len(row)) - (np.cumsum(n) - n)[row]
    # a window whose fingerprint is alone has no equal; the rest are sorted exactly
    mark = np.zeros(len(row), np.uint64)
    for c in ids.T:
        mark = mix(mark * np.uint64(0x9E3779B97F4A7C15) + c)
    order = np.argsort(mark)
    alone = _starts(mark[order])
    alone[:-1] &= alone[1:].copy()
    some = order[~alone]
    some = some[np.lexsort((doc[row[some]], *ids[some].T[::-1]))]
    d = doc[row[some]]
    new = _starts(*ids[some].T) if len(some) else np.zeros(0, bool)
    hit = some[d > d[new][_group_of(new)]] if len(some) else some
    if len(hit):
        hit.sort()
        new_run = _starts(row[hit], pos[hit] - np.arange(len(hit)))
        at = np.flatnonzero(new_run)
        size = np.diff(np.append(at, len(hit)))
        h = hit[at]
        full = size == step[row[h]]                     # every window of the segment, so every one of the whole chain
        again = np.where(full, 1, times[row[h]])        # else the same ones in each repetition
        size = np.where(full, size * times[row[h]], size)
        h, size = np.repeat(h, again), np.repeat(size, again)
        turn = np.arange(len(h)) - np.repeat(np.cumsum(again) - again, again)
        yield pa.record_batch({"doc_id": doc[row[h]], "th": th[row[h]], "start": pos[h] + turn * step[row[h]], "n": size})


# --- 4. spans ---------------------------------------------------------------------------------

def removed_spans(source: DataFrame, units: Units) -> DataFrame:
    """doc_id, th, spans (array of start, end in units; an end of -1 is the
    document's, if it has a window) of every document of ``source`` (see
    ``identified``) that repeats windows of documents with a smaller id. Rows
    with a NULL id are neither earlier nor later than others."""
    prepare(source.sparkSession)
    source = source.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "th", "text")
    contents = cut_lineage(_contents(source, units.width), "repeat-contents")
    holders = _first_holders(contents)
    shared = cut_lineage(_shared_keys(source, units), "repeat-keys")
    keys = (holders.select(F.col("first").alias("doc_id"), "th", F.shiftrightunsigned("th", 64 - _TAG).alias("tag"))
            .join(shared, "tag").select("doc_id", "th", "keys"))
    segs = cut_lineage(_segments(source, keys, units), "repeat-segments")
    rims = segs.where("open").select("doc_id", "th", "start", "n", "times", "key")
    opened = cut_lineage(_open_windows(source, rims, units), "repeat-windows")
    spans = segs.where("not open").select("doc_id", "th", "start", (F.col("n") * F.col("times")).alias("n")).unionByName(opened)
    spans = spans.select("doc_id", "th", F.struct(F.col("start").alias("s"), (F.col("start") + F.col("n") + F.lit(units.width - 1)).alias("e")).alias("span"))
    copies = (contents.join(holders, ["th", "content"]).where("doc_id > first")
              .select("doc_id", "th", F.struct(F.lit(0).cast("long").alias("s"), F.lit(-1).cast("long").alias("e")).alias("span")))
    return spans.unionByName(copies).groupBy("doc_id", "th").agg(F.collect_list("span").alias("spans"))
