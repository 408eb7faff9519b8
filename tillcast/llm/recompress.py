"""Locally consistent recompression of a block of token sequences (helper of operator 3).

A round names every maximal run of one symbol by (symbol, length) and then
every pair of a left-class and a right-class symbol by (left, right). A name is
a hash of what it stands for, so equal substrings get equal names in every
document of the corpus without any exchange of dictionaries: naming is global.

Each symbol carries its *context*: the range of words that forces this symbol
to be cut and named exactly so. Any other place whose words agree on that range
has the same symbol there. A window therefore knows, from its own words alone,
which symbols lie in it for certain; its anchor is the highest-level one, of
those the one with the least hash, of those the leftmost. Equal windows have
equal anchors. Level 0 (the words) needs no context, so every window has one.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np

from .blocks import mix

ROUNDS = 3
_A, _B, _C = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))
_INDEX_BITS = np.uint64(24)
_STRETCH = 1 << 23  # symbols ranked together; with their overlap they fit in _INDEX_BITS
_SALT = mix(np.arange(101, 165, dtype=np.uint64))  # splits the symbols of each round into left and right anew


class Level(NamedTuple):
    name: np.ndarray   # uint64
    lo: np.ndarray     # context: first word; a document's edge counts as the position before it
    hi: np.ndarray     # context: end
    own: np.ndarray    # document of the block


def _neighbours(lv: Level, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Context bounds of each symbol's left and right neighbour, or just outside the document."""
    left = first[lv.own] - 1
    right = first[lv.own + 1] + 1
    same = lv.own[1:] == lv.own[:-1]
    left[1:][same] = lv.lo[:-1][same]
    right[:-1][same] = lv.hi[1:][same]
    return left, right


def _name_runs(lv: Level, first: np.ndarray) -> Level:
    left, right = _neighbours(lv, first)
    head = np.ones(len(lv.name), bool)
    head[1:] = (lv.name[1:] != lv.name[:-1]) | (lv.own[1:] != lv.own[:-1])
    at = np.flatnonzero(head)
    last = np.append(at[1:], len(head)) - 1
    size = last - at + 1
    name = lv.name[at]
    long = size > 1
    name[long] = mix(name[long] * _A + size[long].astype(np.uint64) * _C)
    return Level(name, left[at], right[last], lv.own[at])


def _name_pairs(lv: Level, first: np.ndarray, round_no: int) -> Level:
    n = len(lv.name)
    is_left = (mix(lv.name ^ _SALT[round_no]) & np.uint64(1)).astype(bool)
    opens = np.zeros(n, bool)
    opens[:-1] = is_left[:-1] & ~is_left[1:] & (lv.own[1:] == lv.own[:-1])
    second = np.zeros(n, bool)
    second[1:] = opens[:-1]
    left, right = _neighbours(lv, first)
    lo = np.where(is_left, lv.lo, left)     # an unpaired right symbol saw its left neighbour
    hi = np.where(is_left, right, lv.hi)    # a left symbol saw its right neighbour; paired or not, that is its context
    name = lv.name.copy()
    p = np.flatnonzero(opens)
    name[p] = mix(lv.name[p] * _A + lv.name[p + 1] * _B + np.uint64(round_no))
    keep = ~second
    return Level(name[keep], lo[keep], hi[keep], lv.own[keep])


def levels(hashes: np.ndarray, first: np.ndarray, own: np.ndarray, rounds: int = ROUNDS) -> list[Level]:
    """Level 0 (words) to the last round's symbols."""
    at = np.arange(len(hashes))
    out = [Level(hashes, at, at + 1, own)]
    for r in range(rounds):
        out.append(_name_pairs(_name_runs(out[-1], first), first, r))
    return out


def _range_min(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """min(values[lo:hi]) of many non-empty ranges by doubling."""
    size = hi - lo
    out = np.empty(len(lo), values.dtype)
    table, width = values, 1
    while len(lo):
        now = (size >= width) & (size < 2 * width)
        if now.any():
            a, b = lo[now], hi[now]
            out[now] = np.minimum(table[a], table[b - width])
        if width * 2 > size.max(initial=0):
            return out
        table = np.minimum(table[:-width], table[width:])
        width *= 2
    return out


def _least_symbols(name: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Index of the least rank in each of the non-empty ranges (``lo`` ascending), the leftmost of equal ones."""
    out = np.empty(len(lo), np.int64)
    for first in range(0, len(name), _STRETCH):
        now = slice(*np.searchsorted(lo, [first, first + _STRETCH]))
        if now.start == now.stop:
            continue
        part = name[first:hi[now].max()]
        rank = (mix(part ^ _C) >> _INDEX_BITS << _INDEX_BITS) | np.arange(len(part), dtype=np.uint64)
        out[now] = (_range_min(rank, lo[now] - first, hi[now] - first) & np.uint64((1 << 24) - 1)).astype(np.int64) + first
    return out


def anchors(lvs: list[Level], starts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per window start: anchor level, symbol index, and the symbol's context (lo, hi)."""
    level = np.full(len(starts), -1, np.int8)
    symbol = np.zeros(len(starts), np.int64)
    lo_out, hi_out = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    todo = np.arange(len(starts))
    for k in range(len(lvs) - 1, -1, -1):
        lv, at = lvs[k], starts[todo]
        a = np.searchsorted(lv.lo, at)
        b = np.searchsorted(lv.hi, at + width, side="right")
        has = b > a
        best = _least_symbols(lv.name, a[has], b[has])
        into = todo[has]
        level[into], symbol[into] = k, best
        lo_out[into], hi_out[into] = lv.lo[best], lv.hi[best]
        todo = todo[~has]
        if not len(todo):
            break
    return level, symbol, lo_out, hi_out
