"""Language-model scoring with a gated recurrent network (operator 9).

The model reads folded words one by one and keeps a GRU state per document. The
output softmax is factored: first a class, then a word in it. The ``SHORTLIST``
most frequent words are dealt to classes by frequency; all other words belong to
tail classes by their surface (length, last byte, non-ASCII bytes), inside which
a word's share follows its exact corpus count, unseen words included. So every
word has a probability, and the counts of all training documents enter it.

* Counts: one Spark aggregation over all training documents.
* Training: truncated back-propagation through time in numpy. In each of
  ``ROUNDS`` rounds the tasks start from the same weights, train on their own
  documents with the state carried from window to window, and return their
  weights; Spark averages them in a tree. A hash deals every training document
  to one of the rounds, so all of them reach the weights, as they do the class
  and tail statistics.
* Scoring: whole documents, the state carried across windows to the last word.
  Only words outside the broadcast ``KNOWN`` most frequent ones leave a task:
  their counts are joined by Spark and summed back per document.

Edge cases: NULL and empty texts are one end token; a NULL doc_id counts as a
training document; repeated rows get the same scores each; without training
documents every count is 0 and the model is uniform over what it knows; an
empty table gives an empty result. Ids and texts only are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.session import cut_lineage

from .blocks import Block, Prefix, blocks, byte_values, column, words
from .common import prepare, table
from .repeats import identified

SHORTLIST = 1984      # words the network predicts one by one: 31 classes
CLASS_WORDS = 64
KNOWN = 1 << 16       # words whose counts are broadcast
HIDDEN = 16
WINDOW = 32           # steps of truncated back-propagation
TRAIN_LANES = 64      # documents trained side by side
SCORE_LANES = 256
ROUNDS = 2
RATE = 0.02
FLUSH_TOKENS = 1 << 21
SLOT_BITS = 17
TAILS = 18            # 3 lengths x 3 last bytes x ASCII or not

END = np.uint64(0x00E4D0F7EC57A11D)  # the end token's key


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 1, F.lit(False))


def tokens(b: Block) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word key, tail class) of all tokens, one end after each document, and document offsets."""
    s, e, first = words(b.data, b.offsets)
    key = Prefix(byte_values(b.data, fold=True)).spans(s, e)
    size = e - s
    beyond = b.data >= 0x80
    last = b.data[e - 1] if len(e) else b.data[:0]
    tail = (np.searchsorted([5, 9], size, side="right") * 6 + np.where(last == 0x2E, 2, np.where(last == 0x2C, 1, 0)) * 2
            ).astype(np.int16)
    if beyond.any():
        wide = np.concatenate([[0], np.cumsum(beyond)])
        tail += wide[e] > wide[s]
    n = np.diff(first) + 1
    offs = np.concatenate([[0], np.cumsum(n)])
    keys = np.full(offs[-1], END, np.uint64)
    tails = np.zeros(offs[-1], np.int16)
    at = np.arange(len(key)) + np.repeat(np.arange(len(n)), n - 1)  # an end stands after each document before
    keys[at], tails[at] = key, tail
    return keys, tails, offs


def count_words(training: DataFrame) -> DataFrame:
    """key, tail, c of every token of the training documents (column ``text``)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            key, tail = (np.concatenate(x) for x in zip(*held, strict=True))
            held.clear()
            u, at, c = np.unique(key, return_index=True, return_counts=True)
            return pa.record_batch({"key": u.view(np.int64), "tail": tail[at], "c": c.astype(np.int64)})

        for b in blocks(batches):
            key, tail, _ = tokens(b)
            held.append((key, tail))
            size += len(key)
            if size >= FLUSH_TOKENS:
                yield emit()
                size = 0
        if held:
            yield emit()

    return (training.select("text").mapInArrow(count, "key long, tail short, c long")
            .groupBy("key").agg(F.min("tail").alias("tail"), F.sum("c").alias("c")))


_slots: dict[str, tuple[np.ndarray, np.ndarray]] = {}  # of this worker's vocabulary


class Vocabulary(NamedTuple):
    known: np.ndarray       # sorted keys of the most frequent words
    known_c: np.ndarray
    index: np.ndarray       # per known key: shortlist index, or -1
    total: int              # N
    distinct: int           # V
    tail_total: np.ndarray  # per tail class: tokens, distinct words
    tail_distinct: np.ndarray
    start: np.ndarray       # log frequency of shortlist words, then of tail classes

    def look_up(self, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(shortlist index or -1, count or 0 where it isn't known here)."""
        if not len(self.known):
            return np.full(len(key), -1), np.zeros(len(key), np.int64)
        # Keys are hashes: few begin with the same bits, so a word is found at or shortly after the first of them.
        bits = (key >> np.uint64(64 - SLOT_BITS)).astype(np.int64)
        at, stop = self.slots.take(bits), self.slots.take(bits + 1)
        hit = self.known.take(at, mode="clip") == key
        left = np.flatnonzero(~hit & (at + 1 < stop))
        while len(left):
            at[left] += 1
            hit[left] = self.known[at[left]] == key[left]
            left = left[~hit[left] & (at[left] + 1 < stop[left])]
        return np.where(hit, self.index.take(at, mode="clip"), -1), np.where(hit, self.known_c.take(at, mode="clip"), 0)

    @property
    def slots(self) -> np.ndarray:
        """The first known key of each beginning of ``SLOT_BITS`` bits."""
        made = _slots.get("of")
        if made is None or made[0] is not self.known:
            edges = np.arange(1 << SLOT_BITS, dtype=np.uint64) << np.uint64(64 - SLOT_BITS)
            made = _slots["of"] = (self.known, np.append(np.searchsorted(self.known, edges), len(self.known)))
        return made[1]


def vocabulary(counts: DataFrame) -> Vocabulary:
    """Sums by Spark; at most KNOWN rows reach the driver."""
    top = counts.orderBy(F.desc("c"), "key").limit(KNOWN).collect()
    sums = counts.groupBy("tail").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect()
    tail_total, tail_distinct = np.zeros(TAILS), np.zeros(TAILS)
    for r in sums:
        tail_total[r.tail], tail_distinct[r.tail] = r.c, r.n
    total, distinct = int(tail_total.sum()), int(tail_distinct.sum())
    short = {r.key for r in top[:SHORTLIST]}
    for r in top[:SHORTLIST]:
        tail_total[r.tail] -= r.c
        tail_distinct[r.tail] -= 1
    key = np.array([r.key for r in top], np.int64).view(np.uint64)
    c = np.array([r.c for r in top], np.int64)
    index = np.array([i if r.key in short else -1 for i, r in enumerate(top)], np.int64)
    order = np.argsort(key)
    start = np.full(SHORTLIST, -30.0)
    start[:len(top[:SHORTLIST])] = np.log(c[:SHORTLIST] / max(total, 1))
    return Vocabulary(key[order], c[order], index[order], total, distinct, tail_total, tail_distinct,
                      np.concatenate([start, np.log((tail_total + 0.5) / (total + 0.5 * TAILS))]))


class Network:
    """GRU with class-factored output. Weights are a dict of float32 arrays."""

    classes = SHORTLIST // CLASS_WORDS

    @staticmethod
    def initial(start: np.ndarray) -> dict[str, np.ndarray]:
        """Unigram probabilities and small random weights: training starts from the unigram model."""
        rng = np.random.default_rng(9)
        c, w = Network.classes, CLASS_WORDS
        word = start[:SHORTLIST].reshape(c, w)
        mass = np.concatenate([np.log(np.exp(word).sum(1) + 1e-12), start[SHORTLIST:]])
        f = np.float32
        return {"x": rng.normal(0, 0.3, (SHORTLIST + TAILS, 3 * HIDDEN)).astype(f),
                "u": rng.normal(0, 0.3, (HIDDEN, 3 * HIDDEN)).astype(f),
                "wc": np.zeros((HIDDEN, c + TAILS), f), "bc": mass.astype(f),
                "ww": np.zeros((c, HIDDEN, w), f), "bw": np.maximum(word, -30).astype(f)}

    @staticmethod
    def step(p: dict[str, np.ndarray], h: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, ...]:
        gate = p["x"][x]
        hu = h @ p["u"]
        zr = 1 / (1 + np.exp(-(gate[:, :2 * HIDDEN] + hu[:, :2 * HIDDEN])))
        z, r = zr[:, :HIDDEN], zr[:, HIDDEN:]
        n = np.tanh(gate[:, 2 * HIDDEN:] + r * hu[:, 2 * HIDDEN:])
        return n + z * (h - n), z, r, n, hu[:, 2 * HIDDEN:]

    @staticmethod
    def outputs(p: dict[str, np.ndarray], h: np.ndarray, x: np.ndarray, grad: dict[str, np.ndarray] | None = None):
        """Log probability (natural) of token x after state h, row by row; with ``grad``, adds the weights'
        gradient of the negative sum and also returns the states' gradient.

        Arrays are classes or words by tokens, the tokens sorted by class, so that each step is one pass over
        all of them; a last state of 1 carries the bias."""
        n, classes = len(x), Network.classes
        state = np.ones((HIDDEN + 1, n), h.dtype)
        state[:-1] = h.T
        cls = np.where(x >= SHORTLIST, x - SHORTLIST + classes, x // CLASS_WORDS).astype(np.uint8)
        order = np.argsort(cls, kind="stable")
        edge = np.searchsorted(cls[order], np.arange(classes + 1))
        order = order[:edge[-1]]                                # words of the shortlist
        wc = np.vstack([p["wc"], p["bc"]])
        out, da = Network._softmax(wc.T @ state, cls, grad is not None)
        held = state.take(order, axis=1)
        ww = np.concatenate([p["ww"], p["bw"][:, None]], axis=1)
        spans = [(c, slice(edge[c], edge[c + 1])) for c in np.flatnonzero(np.diff(edge)).tolist()]
        b = np.empty((CLASS_WORDS, len(order)), h.dtype)
        for c, at in spans:
            np.matmul(ww[c].T, held[:, at], out=b[:, at])
        in_class, db = Network._softmax(b, x[order] % CLASS_WORDS, grad is not None)
        out[order] += in_class
        if grad is None:
            return out
        dw = da @ state.T
        grad["wc"] += dw[:, :-1].T
        grad["bc"] += dw[:, -1]
        dh = p["wc"] @ da
        dheld = np.empty((HIDDEN, len(order)), h.dtype)
        for c, at in spans:
            dw = db[:, at] @ held[:, at].T
            grad["ww"][c] += dw[:, :-1].T
            grad["bw"][c] += dw[:, -1]
            np.matmul(p["ww"][c], db[:, at], out=dheld[:, at])
        dh[:, order] += dheld
        return out, dh.T

    @staticmethod
    def _softmax(a: np.ndarray, picked: np.ndarray, gradient: bool) -> tuple[np.ndarray, np.ndarray]:
        """Log probability of each column's picked row; ``a`` becomes its negative's gradient."""
        columns = np.arange(a.shape[1])
        a -= a.max(0) if a.size else 0
        out = a[picked, columns]
        np.exp(a, out=a)
        total = a.sum(0)
        out -= np.log(total)
        if gradient:
            a /= total
            a[picked, columns] -= 1
        return out, a

    @staticmethod
    def read(p: dict[str, np.ndarray], h: np.ndarray, x: np.ndarray, reset: np.ndarray) -> tuple[np.ndarray, ...]:
        """``step`` over a window (steps by lanes): the states before each step, the last state, and z with r, n and
        the product of state and ``u`` of each step. All input gates are read at once and nothing is allocated in a step."""
        steps, width = x.shape
        gate = p["x"].take(np.maximum(x, 0), axis=0)
        half = np.ones(3 * HIDDEN, h.dtype)
        half[:2 * HIDDEN] = 0.5                                 # 1 / (1 + exp(-a)) is (1 + tanh(a / 2)) / 2
        gate[:, :, :2 * HIDDEN] *= half[:2 * HIDDEN]
        u = p["u"] * half
        states, n = (np.empty((steps, width, HIDDEN), h.dtype) for _ in range(2))
        zr, hu = (np.empty((steps, width, k * HIDDEN), h.dtype) for k in (2, 3))
        stops = reset.any(1).tolist()
        h = h.copy()
        for t in range(steps):
            if stops[t]:
                h[reset[t]] = 0
            states[t] = h
            s, c, v = zr[t], n[t], hu[t]
            np.matmul(h, u, out=v)
            np.add(gate[t, :, :2 * HIDDEN], v[:, :2 * HIDDEN], out=s)
            np.tanh(s, out=s)
            s += 1
            s *= 0.5
            np.multiply(s[:, HIDDEN:], v[:, 2 * HIDDEN:], out=c)
            c += gate[t, :, 2 * HIDDEN:]
            np.tanh(c, out=c)
            h -= c
            h *= s[:, :HIDDEN]
            h += c
        return states, h, zr, n, hu[:, :, 2 * HIDDEN:]


class Lanes:
    """Documents laid out side by side: each lane reads whole documents one after
    another. Fuller lanes come first, so that the lanes still reading are a prefix."""

    def __init__(self, ids: np.ndarray, offs: np.ndarray, lanes: int):
        n = np.diff(offs)
        lanes = max(1, min(lanes, len(n)))
        load = np.zeros(lanes, np.int64)
        place = np.zeros((len(n), 2), np.int64)
        for d in np.argsort(-n, kind="stable").tolist():       # longest first, to the emptiest lane
            lane = int(load.argmin())
            place[d] = lane, load[lane]
            load[lane] += n[d]
        rank = np.argsort(-load, kind="stable")
        moved = np.empty(lanes, np.int64)
        moved[rank] = np.arange(lanes)
        place[:, 0] = moved[place[:, 0]]
        steps = int(load.max(initial=0))
        self.reading = np.searchsorted(-load[rank], -np.arange(steps))  # lanes with a token at each step
        self.x = np.full((steps, lanes), -1, np.int32)          # -1: the lane has ended
        self.reset = np.zeros((steps, lanes), bool)
        row = np.repeat(place[:, 1] - offs[:-1], n) + np.arange(offs[-1])
        self.at = (row, np.repeat(place[:, 0], n))              # where each token lies
        self.x[self.at] = ids
        self.reset[place[:, 1], place[:, 0]] = True


def log_probabilities(p: dict[str, np.ndarray], lanes: Lanes) -> np.ndarray:
    """Natural log probability of every token, in the documents' order."""
    steps, width = lanes.x.shape
    out = np.zeros((steps, width), np.float32)
    h = np.zeros((width, HIDDEN), np.float32)
    for t0 in range(0, steps, WINDOW):
        width = lanes.reading[t0]
        x, reset, h = lanes.x[t0:t0 + WINDOW, :width], lanes.reset[t0:t0 + WINDOW, :width], h[:width]
        states, h = Network.read(p, h, x, reset)[:2]
        live = x >= 0
        out[t0:t0 + len(x), :width][live] = Network.outputs(p, states[live], x[live])
    return out[lanes.at]


class Trainer:
    """Adam over windows of truncated back-propagation."""

    def __init__(self, p: dict[str, np.ndarray]):
        # The weights, their gradient and its moments lie in one array each, seen by name.
        flat = np.concatenate([v.ravel() for v in p.values()])
        self.flat, self.moments = [flat, np.zeros_like(flat)], [np.zeros_like(flat), np.zeros_like(flat)]
        self.spare = np.empty_like(flat)
        cuts = np.cumsum([0, *(v.size for v in p.values())])
        self.p, self.grad, self.m, self.v = ({k: a[lo:hi].reshape(v.shape) for (k, v), lo, hi in zip(p.items(), cuts, cuts[1:], strict=False)}
                                             for a in (*self.flat, *self.moments))
        self.steps = 0

    def window(self, h: np.ndarray, x: np.ndarray, reset: np.ndarray) -> np.ndarray:
        p, grad = self.p, self.grad
        self.flat[1].fill(0)
        states, last, zr, n, hn = Network.read(p, h, x, reset)
        live = x >= 0 if x.min() < 0 else slice(None)           # a slice where all lanes read on
        read, size = x[live].reshape(-1), int((x >= 0).sum())
        d_out = np.zeros_like(states)
        d_out[live] = Network.outputs(p, states[live].reshape(-1, HIDDEN), read, grad)[1].reshape(d_out[live].shape)
        z, r = zr[:, :, :HIDDEN], zr[:, :, HIDDEN:]
        # What a state's gradient is multiplied by on its way to n and, through the gates, to the state before.
        to_n = (1 - z) * (1 - n * n)
        through = np.empty((*x.shape, 3, HIDDEN), h.dtype)
        through[:, :, 0] = (states - n) * z * (1 - z)
        through[:, :, 2] = to_n * r
        through[:, :, 1] = through[:, :, 2] * hn * (1 - r)
        back, stops = np.ascontiguousarray(p["u"].T), reset.any(1).tolist()
        dh, part = np.zeros_like(last), np.empty_like(last)
        for t in range(len(x) - 1, -1, -1):
            to_n[t] *= dh
            through[t] *= dh[:, None]
            np.matmul(through[t].reshape(-1, 3 * HIDDEN), back, out=part)
            dh *= z[t]
            dh += part
            dh += d_out[t]
            if stops[t]:
                dh[reset[t]] = 0
        grad["u"] += states.reshape(-1, HIDDEN).T @ through.reshape(-1, 3 * HIDDEN)
        through[:, :, 2] = to_n
        ids = read.astype(np.int16)
        order = np.argsort(ids, kind="stable")
        first = np.flatnonzero(np.diff(ids[order], prepend=-1))
        if len(first):
            grad["x"][ids[order[first]]] = np.add.reduceat(through[live].reshape(-1, 3 * HIDDEN).take(order, axis=0), first, axis=0)
        self.steps += 1
        fix = np.sqrt(1 - 0.999 ** self.steps) / (1 - 0.9 ** self.steps)
        (w, g), (m, v), s = self.flat, self.moments, self.spare
        g /= max(size, 1)
        np.subtract(g, m, out=s)
        s *= 0.1
        m += s
        np.multiply(g, g, out=s)
        s -= v
        s *= 0.001
        v += s
        np.sqrt(v, out=s)
        s += 1e-8
        np.divide(m, s, out=s)
        s *= RATE * fix
        w -= s
        return last

    def documents(self, lanes: Lanes) -> None:
        h = np.zeros((lanes.x.shape[1], HIDDEN), np.float32)
        for t in range(0, len(lanes.x), WINDOW):
            width = lanes.reading[t]
            h = self.window(h[:width], lanes.x[t:t + WINDOW, :width], lanes.reset[t:t + WINDOW, :width])


def _ids(vocab: Vocabulary, key: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    index, c = vocab.look_up(key)
    return np.where(index >= 0, index, SHORTLIST + tail).astype(np.int32), c


def _dump(p: dict[str, np.ndarray]) -> bytes:
    return b"".join(p[k].tobytes() for k in sorted(p))


def _load(raw: bytes, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    flat, out, at = np.frombuffer(raw, np.float32), {}, 0
    for k in sorted(like):
        out[k] = flat[at:at + like[k].size].reshape(like[k].shape).copy()
        at += like[k].size
    return out


def train(training: DataFrame, vocab: Vocabulary, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Weights averaged over the tasks' local training, round by round (``training``: doc_id, text)."""
    spark = training.sparkSession
    p = Network.initial(vocab.start)
    pick = F.pmod(F.xxhash64("doc_id", F.lit("lm")), F.lit(rounds))

    def average(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = None, 0.0
        for batch in batches:
            for raw, w in zip(column(batch, "weights").to_pylist(), column(batch, "tokens").to_pylist(), strict=True):
                part = np.frombuffer(raw, np.float32).astype(np.float64) * w
                total = part if total is None else total + part
                weight += w
        if total is not None:
            yield pa.record_batch({"weights": pa.array([(total / weight).astype(np.float32).tobytes()], pa.binary()), "tokens": [weight]})

    for r in range(rounds):
        shared = spark.sparkContext.broadcast((vocab, p))

        def local(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            vocab, p = shared.value
            trainer, seen = Trainer(p), 0
            ids: list[np.ndarray] = []
            sizes: list[np.ndarray] = []

            def flush() -> None:
                trainer.documents(Lanes(np.concatenate(ids), np.concatenate([[0], np.cumsum(np.concatenate(sizes))]), TRAIN_LANES))
                ids.clear()
                sizes.clear()

            for b in blocks(batches):
                key, tail, offs = tokens(b)
                ids.append(_ids(vocab, key, tail)[0])
                sizes.append(np.diff(offs))
                seen += len(key)
                if sum(map(len, ids)) >= FLUSH_TOKENS:
                    flush()
            if ids:
                flush()
            if seen:
                yield pa.record_batch({"weights": pa.array([_dump(trainer.p)], pa.binary()), "tokens": [float(seen)]})

        schema = "weights binary, tokens double"
        parts = training.where(pick == r).select("text").mapInArrow(local, schema)
        tasks = max(1, parts.rdd.getNumPartitions())
        tree = parts.repartition(max(1, int(tasks ** 0.5))).mapInArrow(average, schema).coalesce(1).mapInArrow(average, schema)
        got = tree.collect()  # one row of fixed size
        if got:
            p = _load(bytes(got[0].weights), p)
    return p


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every document."""
    spark = docs.sparkSession
    prepare(spark)
    source = identified(docs, id_col, text_col).withColumn("held_out", held_out())
    training = source.where(~F.col("held_out")).select("doc_id", "text")
    counts = cut_lineage(count_words(training), "lm-counts")
    vocab = vocabulary(counts)
    shared = spark.sparkContext.broadcast((vocab, train(training, vocab)))
    base_z = float(np.log10(vocab.total + 0.5 * (vocab.distinct + 1)))
    id_type = source.schema["doc_id"]
    # kind 0: one row a document; kind 1: one row a document and word whose count is not known in the task
    schema = T.StructType([id_type, T.StructField("th", T.LongType()), T.StructField("held_out", T.BooleanType()),
                           T.StructField("key", T.LongType()), T.StructField("times", T.LongType()), T.StructField("n_known", T.LongType()),
                           T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab, p = shared.value
        tail_z = np.log10(vocab.tail_total + 0.5 * (vocab.tail_distinct + 1))
        held: list[tuple] = []
        size = 0

        def emit() -> Iterator[pa.RecordBatch]:
            key, tail = (np.concatenate([x[i] for x in held]) for i in (0, 1))
            n = np.concatenate([x[2] for x in held])
            rows = pa.Table.from_batches([x[3] for x in held]).combine_chunks().to_batches()[0]
            held.clear()
            offs = np.concatenate([[0], np.cumsum(n)])
            ids, c = _ids(vocab, key, tail)
            known = c > 0
            own = np.repeat(np.arange(len(n)), n)
            logp = log_probabilities(p, Lanes(ids, offs, SCORE_LANES)).astype(np.float64) / np.log(10)
            lc = np.where(known, np.log10(np.maximum(c, 1) + 0.5), 0.0)
            in_tail = ids >= SHORTLIST
            logp += np.where(in_tail, lc - tail_z[tail], 0.0)
            out = lambda w: np.bincount(own, w, minlength=len(n))
            nulls = lambda kind: pa.nulls(len(n), kind)
            yield pa.record_batch({"doc_id": column(rows, "doc_id"), "th": column(rows, "th"), "held_out": column(rows, "held_out"),
                                   "key": nulls(pa.int64()), "times": n.astype(np.int64), "n_known": out(known).astype(np.int64),
                                   "base": out(lc - base_z), "score": out(logp)})
            far = np.flatnonzero(~known)
            order = far[np.lexsort((key[far], own[far]))]
            k, o = key[order], own[order]
            at = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (o[1:] != o[:-1])])) if len(k) else np.zeros(0, np.int64)
            who = pa.array(o[at])
            m = len(at)
            yield pa.record_batch({"doc_id": column(rows, "doc_id").take(who), "th": column(rows, "th").take(who),
                                   "held_out": pa.nulls(m, pa.bool_()), "key": k[at].view(np.int64),
                                   "times": np.diff(np.append(at, len(k))).astype(np.int64), "n_known": pa.nulls(m, pa.int64()),
                                   "base": pa.nulls(m, pa.float64()), "score": pa.nulls(m, pa.float64())})

        for b in blocks(batches):
            key, tail, offs = tokens(b)
            held.append((key, tail, np.diff(offs), b.rows))
            size += len(key)
            if size >= FLUSH_TOKENS:
                yield from emit()
                size = 0
        if held:
            yield from emit()

    rows = cut_lineage(source.mapInArrow(run, schema), "lm-rows")
    per_doc = rows.where("key is null")
    seen = counts.join(rows.where("key is not null").select("doc_id", "th", "key", "times"), "key", "right")
    far = (seen.withColumn("lc", F.log10(F.coalesce("c", F.lit(0)) + 0.5) * F.col("times"))
           .groupBy("doc_id", "th").agg(F.sum("lc").alias("far"), F.sum(F.expr("if(c is null, 0, times)")).alias("far_known")))
    copies = rows.where("key is null").groupBy("doc_id", "th").agg(F.count("*").alias("rows"))
    extra = (far.join(copies, far["doc_id"].eqNullSafe(copies["doc_id"]) & far["th"].eqNullSafe(copies["th"]))
             .select(far["doc_id"].alias("x_id"), far["th"].alias("x_th"), (F.col("far") / F.col("rows")).alias("far"),
                     (F.col("far_known") / F.col("rows")).cast("long").alias("far_known")))  # repeated rows sent theirs too
    return (per_doc.join(extra, F.col("doc_id").eqNullSafe(F.col("x_id")) & (F.col("th") == F.col("x_th")), "left")
            .select("doc_id", "held_out", F.col("times").alias("n_tokens"),
                    (F.col("n_known") + F.coalesce("far_known", F.lit(0))).alias("n_known"),
                    F.lit(vocab.total).cast("long").alias("train_tokens"),
                    (F.col("base") + F.coalesce("far", F.lit(0.0))).alias("base_score"),
                    (F.col("score") + F.coalesce("far", F.lit(0.0))).alias("score")))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))
