"""Arrow text columns as numpy byte blocks: words, hashes and window fingerprints.

Every function here is a small per-block helper that runs inside Spark tasks
(``mapInArrow``). A block is a run of whole documents of about
``BLOCK_BYTES`` (one longer document is a block of its own), so task memory is
bounded by the longest document and never by a partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 17  # a block's arrays stay in the processor's cache

# The byte classes of the contracts.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True
NOT_SPACE = ~SPACE

_ODD = np.uint64(0x9E3779B97F4A7C15)
_ODD2 = np.uint64(0xD1342543DE82EF95)
_MIX1 = np.uint64(0xBF58476D1CE4E5B9)
_MIX2 = np.uint64(0x94D049BB133111EB)


class Block(NamedTuple):
    rows: pa.RecordBatch  # the documents' other columns
    data: np.ndarray      # uint8, all texts one after another
    offsets: np.ndarray   # int64, len(rows) + 1

    @property
    def n(self) -> int:
        return len(self.offsets) - 1

    def text(self, i: int) -> bytes:
        return self.data[self.offsets[i]:self.offsets[i + 1]].tobytes()


_kept: dict = {}  # what this worker keeps from one task to the next, by name
_keeper: list[int | None] = [None]  # the last task that asked for it


def _task() -> int | None:
    from pyspark import TaskContext
    context = TaskContext.get()
    return context.taskAttemptId() if context else None


def keep(name: str, make: Callable[[], object]) -> object:
    """What ``make`` gives, made once a worker for tasks that follow each other; one name is kept at a time."""
    _keeper[0] = _task()
    if name not in _kept:
        _kept.clear()
        _kept[name] = make()
    return _kept[name]


def release() -> None:
    """Drop what is kept, unless this task asked for it: a worker reused by other work holds it no longer."""
    if _kept and _keeper[0] != _task():
        _kept.clear()


def blocks(batches: Iterator[pa.RecordBatch], text_col: str = "text",
           max_bytes: int = BLOCK_BYTES) -> Iterator[Block]:
    """Cut record batches into blocks of whole documents; NULL text is empty."""
    release()
    for batch in batches:
        if batch.num_rows == 0:
            continue
        col = batch.column(batch.schema.get_field_index(text_col))
        if col.null_count:
            col = pc.fill_null(col, "")
        rest = batch.drop_columns([text_col])
        wide = pa.types.is_large_string(col.type)
        bufs = col.buffers()
        offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset:col.offset + len(col) + 1].astype(np.int64)
        raw = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < len(col):
            hi = int(np.searchsorted(offs, offs[lo] + max_bytes, side="right")) - 1
            hi = min(max(hi, lo + 1), len(col))
            yield Block(rest.slice(lo, hi - lo), raw[offs[lo]:offs[hi]], offs[lo:hi + 1] - offs[lo])
            lo = hi


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = (x ^ (x >> np.uint64(30))) * _MIX1
    x = (x ^ (x >> np.uint64(27))) * _MIX2
    return x ^ (x >> np.uint64(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
_FOLDED = _BYTE.copy()
_FOLDED[65:91] = _BYTE[97:123]  # A-Z count as a-z

_pow: dict[int, np.ndarray] = {}


def _powers(mult: int, n: int) -> np.ndarray:
    """mult**0 .. mult**n modulo 2**64, cached and grown on demand."""
    have = _pow.get(mult)
    if have is None or len(have) <= n:
        size = max(n + 1, 1 << 16)
        steps = np.full(size, mult, np.uint64)
        steps[0] = 1
        have = _pow[mult] = np.cumprod(steps, dtype=np.uint64)
    return have


def _inverse(mult: int) -> int:
    return pow(mult, -1, 1 << 64)


class Prefix:
    """Polynomial prefix sums: the hash of any span in O(1), equal for equal contents wherever they stand."""

    def __init__(self, values: np.ndarray, mult: int = int(_ODD)):
        n = len(values)
        self.inv = _powers(_inverse(mult), n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * _powers(mult, n)[:n], out=self.sums[1:])

    def spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inv[starts] + (ends - starts).astype(np.uint64))

    def windows(self, width: int) -> np.ndarray:
        """Hashes of all spans of ``width`` values, by start."""
        n = len(self.sums) - width
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[width:] - self.sums[:n]) * self.inv[:n] + np.uint64(width))


SECOND = int(_ODD2)  # multiplier of an independent second fingerprint


def byte_values(data: np.ndarray, fold: bool = False) -> np.ndarray:
    return (_FOLDED if fold else _BYTE)[data]


def words(data: np.ndarray, offsets: np.ndarray, member: np.ndarray = NOT_SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of member bytes inside each document: starts, ends, and the index of each document's first word (len n + 1)."""
    n = len(data)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offsets), np.int64)
    inside = member[data]
    cut = np.zeros(n + 1, bool)  # a document starts here
    cut[offsets] = True
    begin = inside.copy()
    begin[1:] &= ~inside[:-1] | cut[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | cut[1:n]
    starts = np.flatnonzero(begin)
    ends = np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: bool = False) -> np.ndarray:
    return Prefix(byte_values(data, fold)).spans(starts, ends)


def owners(first: np.ndarray) -> np.ndarray:
    """Document index of every word, from the first-word index."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def window_starts(first: np.ndarray, width: int) -> np.ndarray:
    """Word positions at which a window of ``width`` words of one document starts."""
    ok = np.zeros(first[-1] + 1, np.int32)
    lens = np.diff(first)
    has = lens >= width
    np.add.at(ok, first[:-1][has], 1)
    np.add.at(ok, first[1:][has] - width + 1, -1)
    return np.flatnonzero(np.cumsum(ok[:-1]) > 0)


def covered(starts: np.ndarray, ends: np.ndarray, n: int) -> np.ndarray:
    """Boolean mask of positions inside any of the spans."""
    step = np.zeros(n + 1, np.int32)
    np.add.at(step, starts, 1)
    np.add.at(step, ends, -1)
    return np.cumsum(step[:-1]) > 0


def column(rows: pa.RecordBatch, name: str) -> pa.Array:
    return rows.column(rows.schema.get_field_index(name))


def list_sizes(lists: pa.Array) -> np.ndarray:
    """Lengths of a list column; NULL counts as empty."""
    return pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
