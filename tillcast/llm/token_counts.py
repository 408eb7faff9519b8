"""Token counts that follow edits (operator 2).

A tokenizer with a pre-token pattern never merges across pre-tokens, so a
document's count is a sum over them. Every document keeps a segment tree whose
leaves are runs of ``LEAF`` pre-tokens: characters and tokens of each leaf, and
the sums of all subtrees. An edit re-encodes only the leaves it touches, from
the last leaf start that ``MARGIN`` characters of boundary context keep stable
to the first old leaf start at which the new pre-tokens fall into step again,
and updates the sums on the paths to the root.

The trees are a Spark table beside the documents; edits come as one array per
document and meet text and tree by key. The vocabulary file (about 1 MB) is
read once and broadcast; its path and pattern are parameters.

Edge cases: NULL and empty texts have no pre-tokens and an empty tree; an edit
outside the text is cut to it; edits apply in order, each to the text that the
ones before it left; repeated rows are counted one by one; a text that grows
far beyond its leaves gets a new tree; an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.session import cut_lineage

from .blocks import column
from .common import prepare, table

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public byte-level BPE pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LEAF = 64
MARGIN = 3            # characters a pre-token can look beyond its end
CACHE = 1 << 19       # pre-tokens whose counts a task remembers at once


class Counter(dict):
    """pre-token -> number of tokens, filled on demand."""

    def __init__(self, ranks: dict[bytes, int], pattern: str = PATTERN):
        super().__init__()
        self.pattern = regex.compile(pattern)
        self.encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def __missing__(self, pre: str) -> int:
        if len(self) >= CACHE:
            self.clear()
        n = self[pre] = len(self.encoding.encode_ordinary(pre))
        return n

    def of(self, pre: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, pre), np.int64, len(pre))


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Tree:
    """Heap of token sums over a power of two of leaves (node 1 is the root), and each leaf's characters."""

    def __init__(self, chars: list[int], pres: list[int], tokens: list[int]):
        self.chars, self.pres = list(chars), list(pres)
        self.base = 1
        while self.base < len(tokens):
            self.base *= 2
        self.sums = [0] * self.base + list(tokens) + [0] * (self.base - len(tokens))
        for i in range(self.base - 1, 0, -1):
            self.sums[i] = self.sums[2 * i] + self.sums[2 * i + 1]

    @staticmethod
    def of(text: str, counter: Counter) -> Tree:
        return Tree(*_leaves(counter.pattern.findall(text), counter))

    @property
    def total(self) -> int:
        return self.sums[1] if len(self.sums) > 1 else 0

    def _set(self, leaf: int, tokens: int) -> None:
        i = self.base + leaf
        delta = tokens - self.sums[i]
        while i:
            self.sums[i] += delta
            i //= 2

    def edit(self, text: str, start: int, end: int, new: str, counter: Counter) -> tuple[str, Tree, int]:
        """The text after replacing [start, end), its tree, and the pre-tokens that were encoded."""
        start, end = max(0, min(start, len(text))), max(0, min(end, len(text)))
        end = max(start, end)
        after = text[:start] + new + text[end:]
        if not self.chars or len(after) > 8 * max(len(text), LEAF):
            tree = Tree.of(after, counter)
            return after, tree, sum(tree.pres)
        edges = np.concatenate([[0], np.cumsum(self.chars)])
        i = max(0, int(np.searchsorted(edges, start - MARGIN, side="right")) - 1)
        j = min(len(self.chars) - 1, max(i, int(np.searchsorted(edges, end, side="left")) - 1))
        shift = len(after) - len(text)
        while True:
            lo, hi = int(edges[i]), int(edges[j + 1]) + shift
            pre, pos, level = [], lo, hi == len(after)
            for m in counter.pattern.finditer(after, lo):
                if m.start() >= hi:
                    level = level or m.start() == hi   # an old leaf start is a pre-token start again
                    break
                pre.append(m.group())
                pos = m.end()
            if (level and pos <= hi) or j == len(self.chars) - 1:
                break
            j += 1
        part = -(-len(pre) // (j - i + 1)) if pre else 0
        if part > 8 * LEAF:
            tree = Tree.of(after, counter)
            return after, tree, sum(tree.pres)
        counts = counter.of(pre)
        for k in range(j - i + 1):
            piece = slice(k * part, (k + 1) * part)
            self.chars[i + k] = sum(map(len, pre[piece]))
            self.pres[i + k] = len(pre[piece])
            self._set(i + k, int(counts[piece].sum()))
        return after, self, len(pre)


def _leaves(pre: list[str], counter: Counter) -> tuple[list[int], list[int], list[int]]:
    if not pre:
        return [], [], []
    at = np.arange(0, len(pre), LEAF)
    tokens = np.add.reduceat(counter.of(pre), at)
    chars = np.add.reduceat(np.fromiter(map(len, pre), np.int64, len(pre)), at)
    return chars.tolist(), np.diff(np.append(at, len(pre))).tolist(), tokens.tolist()


_EDIT = "array<struct<start:int,stop:int,new:string>>"
_KEYED = "doc_id long, th long"
_TREE = "leaf_chars array<int>, leaf_pres array<int>, leaf_tokens array<int>"


def _keyed(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

BROADCAST_KEYS = 1_000_000  # edited texts whose keys (16 bytes) are broadcast; beyond it the texts are shuffled


def build_trees(docs: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN,
                id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, th, leaf_chars, leaf_pres, leaf_tokens: the leaves, which the sums above them follow from."""
    prepare(docs.sparkSession)
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value, pattern)
        for batch in batches:
            rows = [_leaves(counter.pattern.findall(t.as_py() or ""), counter) for t in column(batch, "text")]
            yield pa.record_batch({"doc_id": column(batch, "doc_id"), "th": column(batch, "th"),
                                   **{c: pa.array([r[k] for r in rows], pa.list_(pa.int32()))
                                      for k, c in enumerate(("leaf_chars", "leaf_pres", "leaf_tokens"))}})

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"{_KEYED}, {_TREE}")


def apply_edits(docs: DataFrame, trees: DataFrame, edits: DataFrame, vocabulary: str = VOCABULARY, pattern: str = PATTERN,
                id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """Counts before and after the edits of every document.

    ``edits``: doc_id, th (the text's xxhash64) and an array of (start, stop,
    new), at most one row per text. Only edited documents are opened; the other
    documents' counts are the sums their trees already hold.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(vocabulary))
    extra = ", after string" if with_text else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(ranks.value, pattern)
        for batch in batches:
            out = []
            for r in batch.select(["text", "leaf_chars", "leaf_pres", "leaf_tokens", "edits"]).to_pylist():
                tree, text, encoded = Tree(r["leaf_chars"], r["leaf_pres"], r["leaf_tokens"]), r["text"] or "", 0
                for e in r["edits"]:
                    text, tree, n = tree.edit(text, e["start"], e["stop"], e["new"] or "", counter)
                    encoded += n
                out.append((tree.total, sum(tree.pres), encoded, text))
            yield pa.record_batch({
                "doc_id": column(batch, "doc_id"), "th": column(batch, "th"),
                "n_tokens_after": pa.array([x[0] for x in out], pa.int64()), "n_pretokens_after": pa.array([x[1] for x in out], pa.int64()),
                "n_reencoded": pa.array([x[2] for x in out], pa.int64()),
                **({"after": pa.array([x[3] for x in out], pa.string())} if with_text else {})})

    leaves = trees.dropDuplicates(["doc_id", "th"])
    touched = edits.where(F.size("edits") > 0)
    key = lambda d, p: d.withColumnsRenamed({"doc_id": f"{p}_id", "th": f"{p}_th"})
    same = lambda p: F.col("doc_id").eqNullSafe(F.col(f"{p}_id")) & (F.col("th") == F.col(f"{p}_th"))
    # Only edited texts are moved: the keys go to the texts as long as they are few.
    keys = key(touched.select("doc_id", "th"), "k")
    keys = F.broadcast(keys) if keys.limit(BROADCAST_KEYS + 1).count() <= BROADCAST_KEYS else keys
    changed = (_keyed(docs, id_col, text_col).join(keys, same("k"), "left_semi").dropDuplicates(["doc_id", "th"])
               .join(key(touched, "e"), same("e")).join(key(leaves, "l"), same("l"))
               .select("doc_id", "th", "text", "leaf_chars", "leaf_pres", "leaf_tokens", "edits")
               .mapInArrow(run, f"{_KEYED}, n_tokens_after long, n_pretokens_after long, n_reencoded long{extra}"))
    total = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    counted = trees.select("doc_id", "th", total("leaf_pres").alias("n_pretokens"), total("leaf_tokens").alias("n_tokens"))
    n_edits = key(touched.select("doc_id", "th", F.size("edits").cast("long").alias("n_edits")), "e")
    return (counted.join(n_edits, same("e"), "left").join(key(changed, "c"), same("c"), "left")
            .select("doc_id", "n_pretokens", "n_tokens", F.coalesce("n_edits", F.lit(0)).alias("n_edits"),
                    F.coalesce("n_pretokens_after", "n_pretokens").alias("n_pretokens_after"),
                    F.coalesce("n_tokens_after", "n_tokens").alias("n_tokens_after"),
                    F.coalesce("n_reencoded", F.lit(0)).alias("n_reencoded"), *["after"] * with_text))


EMAIL = regex.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}")


def redaction_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A cleaning pass as edits: e-mail addresses become <EMAIL>, lines equal to
    an earlier line of the document go. Edits run from the end of the text to
    its start, so that each one's offsets hold when its turn comes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t in column(batch, "text"):
                text, seen, at, found = t.as_py() or "", set(), 0, []
                for line in text.split("\n"):
                    if line.strip() and line in seen:
                        found.append((max(at - 1, 0), at + len(line), ""))
                    else:
                        if "@" in line:
                            found += [(at + m.start(), at + m.end(), "<EMAIL>") for m in EMAIL.finditer(line)]
                        seen.add(line)
                    at += len(line) + 1
                rows.append([{"start": a, "stop": b, "new": n} for a, b, n in reversed(found)])
            kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("new", pa.string())]))
            yield pa.record_batch({"doc_id": column(batch, "doc_id"), "th": column(batch, "th"), "edits": pa.array(rows, kind)})

    return _keyed(docs, id_col, text_col).mapInArrow(run, f"{_KEYED}, edits {_EDIT}").dropDuplicates(["doc_id", "th"])


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    trees = cut_lineage(build_trees(docs), "token-trees")
    edits = cut_lineage(redaction_edits(docs).where(F.size("edits") > 0), "token-edits")
    return apply_edits(docs, trees, edits)
