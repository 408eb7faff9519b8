"""Operators on text against brute force, over every edge case."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from llm_helpers import DOCS, edge_documents, frame, item_words, repeated, words
from tillcast.llm import decontaminate, jaccard, language_model, mixing, phrases, quality, substrings, token_counts, toxicity


@pytest.fixture(scope="module")
def rows():
    return edge_documents()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).cache()


def by_row(result, value):
    return sorted(((r.doc_id if r.doc_id is not None else -1), *value(r)) for r in result.collect())


def test_substrings(docs, rows):
    gone = repeated([(r[0], words(r[1])) for r in rows], 50)
    want = []
    for r, g in zip(rows, gone, strict=True):
        kept = b" ".join(w for w, x in zip(words(r[1]), g, strict=True) if not x)
        want.append((r[0] if r[0] is not None else -1, len(g), sum(g), hashlib.sha256(kept).hexdigest()))
    assert any(w[2] for w in want)
    assert by_row(substrings.deduplicate(docs), lambda r: (r.n_words, r.n_removed, r.kept_sha256)) == sorted(want)


def byte_truth(rows):
    return repeated([(r[0], list((r[1] or "").encode())) for r in rows], 50)


def test_suffix_array_bytes(docs, rows):
    want = []
    for r, g in zip(rows, byte_truth(rows), strict=True):
        raw = (r[1] or "").encode()
        runs = sum(x and (k == 0 or not g[k - 1]) for k, x in enumerate(g))
        kept = bytes(c for c, x in zip(raw, g, strict=True) if not x)
        want.append((r[0] if r[0] is not None else -1, len(raw), sum(g), runs, hashlib.sha256(kept).hexdigest()))
    assert by_row(phrases.repeated_bytes(docs), lambda r: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256)) == sorted(want)


def test_hot_keys_are_compared_by_window(docs, rows, monkeypatch):
    from tillcast.llm import repeats
    monkeypatch.setattr(repeats, "HOT", 1)
    monkeypatch.setattr(repeats, "RIMS", 1)
    monkeypatch.setattr(repeats, "FLUSH_ROWS", 40)
    want = sorted((r[0] if r[0] is not None else -1, sum(g)) for r, g in zip(rows, byte_truth(rows), strict=True))
    assert by_row(phrases.repeated_bytes(docs), lambda r: (r.n_removed,)) == want


def plain(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")


def letters(seed):
    import random
    rng = random.Random(seed)
    return lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(n))


def test_short_strings_shared_by_chance_are_not_dealt(spark):
    """Trigger words that texts share without a window in common leave at once."""
    from tillcast.llm import repeats
    text = letters(11)
    common = [text(24) for _ in range(40)]
    docs = plain(spark, ["".join(text(30) + c for c in common) for _ in range(20)])
    assert repeats._shared_keys(repeats.identified(docs), phrases.units()).count() == 0
    assert {r.n_removed for r in phrases.repeated_bytes(docs).collect()} == {0}


def test_whole_copies_are_one_span(spark):
    """Copies of a whole text are no other content; their windows are not dealt."""
    from tillcast.llm import repeats
    text = letters(12)
    long, other, short = text(4000), text(4000), text(49)
    texts = [long, other] + [long] * 30 + [short] * 2 + [text(100) + long[500:700]]
    docs = plain(spark, texts)
    source = repeats.identified(docs)
    shared = repeats._shared_keys(source, phrases.units())
    assert shared.count() == 2
    spans = {r.doc_id: r.spans for r in repeats.removed_spans(source, phrases.units()).collect()}
    assert all([tuple(x) for x in spans[i]] == [(0, -1)] for i in range(2, 32)) and spans.keys() == {*range(2, 32), 34}
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in phrases.repeated_bytes(docs).collect()}
    assert got == {0: (0, 0), 1: (0, 0), **{i: (4000, 1) for i in range(2, 32)}, 32: (0, 0), 33: (0, 0), 34: (200, 1)}


def test_copies_without_a_window_stay(spark):
    """A copied text of many bytes and fewer than 50 words loses nothing to operator 3."""
    few, many = " ".join(["several words"] * 10), " ".join(f"word{i}" for i in range(60))
    got = by_row(substrings.deduplicate(plain(spark, [few, few, many, many])), lambda r: (r.n_words, r.n_removed))
    assert got == [(0, 20, 0), (1, 20, 0), (2, 60, 0), (3, 60, 60)]


def test_pairs_travel_packed(docs, rows, monkeypatch):
    """Ten bytes a pair, and the same result when a task deals its pairs many times."""
    import numpy as np
    from tillcast.llm import repeats
    rng = np.random.default_rng(4)
    key, tag = rng.integers(0, 1 << 32, 5000).astype(np.uint64), rng.integers(0, 1 << 48, 5000).astype(np.uint64)
    deal = np.sort(rng.integers(0, 9, 5000)).astype(np.uint64)
    packed = repeats._pack(deal, key, tag)
    assert packed.num_rows == 9 and packed.nbytes < 10 * 5000 + 300
    for part in (packed, packed.slice(3)):
        skip = int((deal < part.column(0)[0].as_py()).sum())
        assert all((a == b[skip:]).all() for a, b in zip(repeats._unpack(part), (key, tag), strict=True))
    monkeypatch.setattr(repeats, "PACK_ROWS", 50)
    want = sorted((r[0] if r[0] is not None else -1, sum(g)) for r, g in zip(rows, byte_truth(rows), strict=True))
    assert by_row(phrases.repeated_bytes(docs), lambda r: (r.n_removed,)) == want


def test_cuts_beyond_24_bits():
    """A passage is cut alike wherever it stands in a document of over 16 MiB."""
    import numpy as np
    import pyarrow as pa
    from tillcast.llm.blocks import Block
    rng = np.random.default_rng(2)
    size, span = (1 << 24) + 4000, 1000
    data = rng.integers(97, 123, size).astype(np.uint8)
    rows = pa.record_batch({"doc_id": pa.array([1])})
    far = (1 << 24) + 1500
    part = phrases._parser(50, 16)(Block(rows, data[far:far + span], np.array([0, span])))
    whole = phrases._parser(50, 16)(Block(rows, data, np.array([0, size])))
    want = dict(zip((part.start[1:-1] + far).tolist(), part.key[1:-1].tolist(), strict=True))
    got = dict(zip(whole.start.tolist(), whole.key.tolist(), strict=True))
    assert want and all(got.get(a) == k for a, k in want.items())


def test_symbols_beyond_24_bits():
    """The least symbol of a range, far into a document of over 16.7 million words."""
    import numpy as np
    from tillcast.llm import recompress
    name = np.random.default_rng(3).integers(0, 1 << 63, (1 << 24) + 4000).astype(np.uint64)
    level = recompress.Level(name, np.arange(len(name)), np.arange(1, len(name) + 1), np.zeros(len(name), np.int64))
    far = np.arange((1 << 24) + 1500, (1 << 24) + 1700)
    short = recompress.Level(*(c[far[0]:far[0] + 300] for c in (name, np.arange(len(name)), np.arange(1, len(name) + 1), level.own)))
    want = recompress.anchors([short], far, 50)[1] + far[0]
    assert (recompress.anchors([level], far, 50)[1] == want).all()


def test_remove_repeats_keeps_text_valid(docs, rows):
    out = phrases.remove_repeats(docs)
    assert out.columns == docs.columns
    truth = {(r[0], r[1]): g for r, g in zip(rows, byte_truth(rows), strict=True)}
    left = {(r.doc_id, r.text) for r in out.collect()}
    for (i, t), g in truth.items():
        if not any(g):
            assert (i, t) in left            # untouched rows come back unchanged
    assert len(left) <= len(truth)


def jaccard_truth(rows):
    sets = []
    for r in rows:
        w = [x.lower() for x in words(r[1])]
        sets.append({tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            o = len(sets[a] & sets[b])
            if o and 100 * o >= 80 * (len(sets[a]) + len(sets[b]) - o):
                root[find(a)] = find(b)
    best: dict[int, int] = {}
    for k, r in enumerate(rows):
        if r[0] is not None:
            best[find(k)] = min(best.get(find(k), r[0]), r[0])
    return [(len(sets[k]), best.get(find(k)) if sets[k] else r[0]) for k, r in enumerate(rows)]


def test_jaccard(docs, rows):
    want = sorted((r[0] if r[0] is not None else -1, n, c if c is not None else -1) for r, (n, c) in zip(rows, jaccard_truth(rows), strict=True))
    got = by_row(jaccard.near_duplicates(docs), lambda r: (r.n_shingles, r.component_id if r.component_id is not None else -1))
    assert got == want


def test_jaccard_hub_groups(spark, monkeypatch):
    """Many near copies of one text, around and below the threshold: links through hubs lose nothing."""
    import random
    monkeypatch.setattr(jaccard, "RARE", 2)
    rng = random.Random(3)
    base = [f"b{k}" for k in range(90)]
    rows = []
    for i in range(60):
        w = list(base)
        for _ in range(rng.randrange(5)):
            w[rng.randrange(len(w))] = f"e{rng.randrange(25)}"
        rows.append((i, " ".join(w[: len(w) - rng.randrange(12)]), "en", "s", 0))
    want = sorted((r[0], n, c) for r, (n, c) in zip(rows, jaccard_truth(rows), strict=True))
    assert len({c for _, _, c in want}) > 1
    assert by_row(jaccard.near_duplicates(spark.createDataFrame(rows, DOCS)), lambda r: (r.n_shingles, r.component_id)) == want


def test_keep_one(docs, rows):
    out = jaccard.keep_one(docs)
    truth = [(r, c) for r, (n, c) in zip(rows, jaccard_truth(rows), strict=True)]
    keep = Counter(r[0] for r, c in truth if r[0] is None or r[0] == c)
    drop = {r[0] for r, c in truth if r[0] is not None and r[0] != c}
    got = Counter(r.doc_id for r in out.select("doc_id").collect())
    assert got == Counter({k: v for k, v in keep.items() if k not in drop})


ITEMS = [(1, "alpha beta gamma delta eps zeta eta theta iota kappa lambda mu"), (2, "short item"), (10, ""), (3, None), (4, "gamma delta eps"),
         (None, "Alpha, beta! gamma?"), (5, "x y x y x y x y x y x y x"), (5, "short item")]


def test_decontamination(spark, rows):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    texts = ["pre ALPHA beta-gamma delta eps zeta eta theta iota kappa lambda mu post", "a short, item b short item", "x y " * 9, None, "", "über x",
             "alpha beta gamma delta eps zeta eta theta iota", "short ITEMs item short item"] + [r[1] for r in rows]
    data = list(enumerate(texts))
    items = [(k, item_words(t)) for k, t in ITEMS]
    want = {}
    for i, t in data:
        w = item_words(t)
        hit, found = set(), set()
        for n, (_, it) in enumerate(items):
            m = min(10, len(it))
            grams = {tuple(it[k:k + m]) for k in range(len(it) - m + 1)} if m else set()
            for k in range(len(w) - m + 1 if m else 0):
                if tuple(w[k:k + m]) in grams:
                    hit |= set(range(k, k + m))
                    found.add(n)
        ids = sorted({str(items[n][0]) for n in found if items[n][0] is not None})
        want[i] = (len(w), len(hit), len(found), hashlib.sha256(",".join(ids).encode()).hexdigest(), bool(hit))
    df = spark.createDataFrame(data, "doc_id long, text string")
    auto = decontaminate.build_automaton(bench)
    got = {r.doc_id: tuple(r)[1:] for r in decontaminate.contamination(df, auto).collect()}
    assert got == want
    cleaned = decontaminate.remove_spans(df, auto)
    after = {r.doc_id: r.text for r in cleaned.collect()}
    for i, t in data:
        n, hit = want[i][:2]
        assert (i in after) == (hit <= 0.5 * n)
        if not hit:
            assert after[i] == t
    assert after[1] == "a  b short item".replace("short item", "") if 1 in after else True
    none = decontaminate.build_automaton(bench.limit(0))
    assert not decontaminate.contamination(df, none).where("contaminated").count()


def test_decontamination_counts_ids_once(spark):
    """Items that share an id are one item, items without one are one more; SQL counts them alike."""
    import hashlib
    w, v = (" ".join(f"{x}{k}" for k in range(12)) for x in "wv")
    bench = spark.createDataFrame([(7, w), (7, w), (7, v), (None, v), (None, w)], "item_id long, text string")
    df = spark.createDataFrame([(1, f"so {w} then {v}", "en", "s", 0), (2, "nothing", "en", "s", 0), (3, v + " end" * 200_000, "en", "s", 0)], DOCS)
    got = {r.doc_id: r for r in decontaminate.contamination(df, decontaminate.build_automaton(bench)).collect()}
    seven, empty = (hashlib.sha256(x).hexdigest() for x in (b"7", b""))
    assert [(got[k].n_items, got[k].items_sha256, got[k].n_hit) for k in (1, 2, 3)] == [(2, seven, 24), (0, empty, 0), (2, seven, 12)]
    assert got[3].n_words == 200_012


def test_quality_measures(docs, rows):
    import re
    want = []
    for r in rows:
        t = r[1] or ""
        w = words(t)
        grams = Counter(tuple(w[i:i + 3]) for i in range(len(w) - 2))
        inside = {k for i in range(len(w) - 2) if grams[tuple(w[i:i + 3])] > 1 for k in range(i, i + 3)}
        lines = [x for x in t.split("\n") if words(x)]
        want.append((r[0] if r[0] is not None else -1, len(w), sum(len(x.decode()) for x in w), len(re.findall(r"[#*$%&|<>]", t)),
                     len(lines) - len(set(lines)), len(inside), len(w) < 50 or 100 * len(inside) > 50 * len(w)))
    out = quality.judge(docs)
    got = by_row(out, lambda r: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed))
    assert got == sorted(want)
    assert not out.where("kept and base_failed").count()


def test_quality_thresholds_follow_the_group(spark):
    """A feature that is normal in one source is an outlier in another."""
    clean = " ".join(f"word{k}" for k in range(80))
    noisy = " ".join(f"word{k}{'#' if k % 2 else ''}" for k in range(80))
    rows = [(i, noisy + f" n{i}", "en", "tables", 0) for i in range(300)] + [(1000 + i, clean + f" n{i}", "en", "prose", 0) for i in range(300)]
    rows.append((5000, noisy, "en", "prose", 0))
    got = {r.doc_id: r.kept for r in quality.judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert not got.pop(5000) and all(got.values())


def test_language_model(docs, rows):
    tokens = lambda t: [w.lower() for w in words(t)] + ["END"]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    count = Counter(w for r in rows if not held(r[0]) for w in tokens(r[1]))
    total, distinct = sum(count.values()), len(count)
    want = sorted((r[0] if r[0] is not None else -1, held(r[0]), len(tokens(r[1])), sum(count[w] > 0 for w in tokens(r[1])), total,
                   round(sum(math.log10((count[w] + 0.5) / (total + 0.5 * (distinct + 1))) for w in tokens(r[1])), 6)) for r in rows)
    out = language_model.score(docs).collect()
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out)
    assert got == want
    assert all(r.score < 0 for r in out)


def test_every_training_document_reaches_the_network(spark):
    """Each document, alone in the corpus, moves the weights from where they start."""
    import numpy as np
    for i in range(5):
        one = spark.createDataFrame([(i, "some words that follow some words")], "doc_id long, text string")
        vocab = language_model.vocabulary(language_model.count_words(one))
        start, got = language_model.Network.initial(vocab.start), language_model.train(one, vocab)
        assert not np.array_equal(start["wc"], got["wc"])


def test_network_gradient():
    """Back-propagation against finite differences."""
    import numpy as np
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in language_model.Network.initial(np.full(language_model.SHORTLIST + language_model.TAILS, -8.0)).items()}
    p["wc"] += rng.normal(0, 0.2, p["wc"].shape)
    p["ww"] += rng.normal(0, 0.2, p["ww"].shape)
    x = rng.integers(0, language_model.SHORTLIST + language_model.TAILS, (6, 3)).astype(np.int32)
    reset = np.zeros((6, 3), bool)
    reset[0] = True
    reset[3, 1] = True

    def loss(q):
        h, total = np.zeros((3, language_model.HIDDEN)), 0.0
        for t in range(6):
            h = h * ~reset[t][:, None]
            total -= language_model.Network.outputs(q, h, x[t]).sum()
            h = language_model.Network.step(q, h, x[t])[0]
        return total

    trainer = language_model.Trainer(p)
    before = {k: v.copy() for k, v in trainer.m.items()}
    trainer.window(np.zeros((3, language_model.HIDDEN)), x, reset)
    for name in ("u", "x", "wc", "bw"):
        grad = (trainer.m[name] - before[name]) / 0.1 * x.size      # first moment after one step
        for _ in range(4):
            at = tuple(rng.integers(0, s) for s in p[name].shape) if name != "x" else (x[1, 0], int(rng.integers(0, 3 * language_model.HIDDEN)))
            up, down = ({k: v.copy() for k, v in p.items()} for _ in range(2))
            up[name][at] += 1e-5
            down[name][at] -= 1e-5
            assert abs((loss(up) - loss(down)) / 2e-5 - grad[at]) < 1e-4 * max(1, abs(grad[at]))


def test_probabilities_sum_to_one():
    import numpy as np
    p = language_model.Network.initial(np.full(language_model.SHORTLIST + language_model.TAILS, -8.0))
    x = np.arange(language_model.SHORTLIST + language_model.TAILS, dtype=np.int32)
    h = np.tile(np.linspace(-1, 1, language_model.HIDDEN, dtype=np.float32), (len(x), 1))
    assert abs(np.exp(language_model.Network.outputs(p, h, x)).sum() - 1) < 1e-3


@pytest.mark.parametrize("frequent", [1, 20, 10**6])
def test_toxicity_is_exact_knn(spark, monkeypatch, frequent):
    """The block-max search returns what a full scan returns; held-out labels change nothing."""
    import numpy as np
    import random
    rng = random.Random(8)
    bad, fine = [f"bad{k}" for k in range(12)], [f"fine{k}" for k in range(300)]
    rows, labels = [], []
    for i in range(400):
        toxic = int(i % 5 == 0)
        w = rng.choices(fine, k=40) + rng.choices(bad, k=4) * toxic
        rng.shuffle(w)
        rows.append((i, " ".join(w), "en", "s", 0))
        labels.append((i, toxic))
    rows += [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, "bad1 bad2 bad3", "en", "s", 0)]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "FREQUENT", frequent)
    fitted = toxicity.fit(docs, lab)
    index = fitted.index
    dense = np.zeros((len(index.ids), len(index.terms)))
    for t in range(len(index.terms)):
        held = slice(index.where.edge[t], index.where.edge[t + 1])
        dense[index.where[t], t] = index.grown[index.count[held]] * index.idf[t] * index.inverse[index.where[t]]
    assert np.allclose((dense * dense).sum(axis=1), 1)
    again = toxicity.unpacked(toxicity.packed(index))
    assert (again.where.flat == index.where.flat).all() and again.where.flat.dtype == index.where.flat.dtype
    for place in range(0, len(index.ids), 7):
        term = np.flatnonzero(dense[place])
        at, cosine = index.nearest(term, dense[place][term], 16)
        full = np.sort(dense @ dense[place])[::-1]
        full = full[full > 0][:16]
        assert np.allclose(cosine, full)
    out = {r.doc_id: r for r in toxicity.score(docs, fitted).collect()}
    # Votes and scores of the examples, by hand: each is its own nearest neighbour with cosine 1.
    for place in range(0, len(index.ids), 11):
        cos = dense @ dense[place]
        near = sorted((x for x in range(len(cos)) if cos[x] > 0), key=lambda x: (-round(cos[x], 12), x))[:16]
        vote = (sum(cos[x] * index.toxic[x] for x in near) + 0.5 * index.base) / (sum(cos[x] for x in near) + 0.5)
        a, b = fitted.curve
        assert out[index.ids[place]].score == pytest.approx(1 / (1 + math.exp(-(a * math.log(vote / (1 - vote)) + b))), abs=1e-6)
    assert sum((out[i].score >= 0.3) == bool(t) for i, t in labels) >= 390
    assert out[900].score == out[901].score < 0.3 and not out[None].held_out and out[None].predicted == 1
    flipped = lab.withColumn("toxic", F.when(toxicity.held_out(), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    assert {r.doc_id: r.score for r in toxicity.score(docs, toxicity.fit(docs, flipped)).collect()} == {k: r.score for k, r in out.items()}


def test_toxicity_is_over_all_words(spark):
    """Words count whichever class they lean to, and however many there are."""
    rows, labels = [], []
    for i in range(600):
        rows.append((i, " ".join([f"q{i // 10:03d}z{k}" for k in range(8)] + ["kind" if i % 2 else "vile"]), "en", "s", 0))
        labels.append((i, 1 - i % 2))
    rows += [(9001, "kind", "en", "s", 0)]
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, toxic int")
    index = toxicity.fit(docs, lab)
    assert len(index.index.terms) > 1024
    assert toxicity.score(docs, index).where("doc_id = 9001").first().evidence  # a word of the clean class has neighbours


def test_token_counts(docs, rows):
    counter = token_counts.Counter(token_counts.read_ranks(token_counts.VOCABULARY))
    n = lambda t: len(counter.encoding.encode_ordinary(t or ""))
    trees, edits = token_counts.build_trees(docs), token_counts.redaction_edits(docs)
    out = token_counts.apply_edits(docs, trees, edits, with_text=True).collect()
    assert sorted(r.n_tokens for r in out) == sorted(n(r[1]) for r in rows)
    assert len(out) == len(rows) and any(r.n_edits for r in out)
    for r in out:
        assert r.after is None or r.n_tokens_after == n(r.after)


def test_edits_of_documents_without_an_id(spark):
    counter = token_counts.Counter(token_counts.read_ranks(token_counts.VOCABULARY))
    n = lambda t: len(counter.encoding.encode_ordinary(t))
    text = "write to someone.long@mail.example.com today"
    docs = spark.createDataFrame([(None, text, "en", "s", 0), (1, text, "en", "s", 0)], DOCS)
    out = token_counts.apply_edits(docs, token_counts.build_trees(docs), token_counts.redaction_edits(docs), with_text=True).collect()
    assert sorted(r.doc_id or 0 for r in out) == [0, 1]
    for r in out:
        assert r.n_edits == 1 and r.n_reencoded > 0 and r.after == "write to <EMAIL> today" and r.n_tokens_after == n(r.after)


def test_tree_follows_random_edits():
    import random
    rng = random.Random(4)
    counter = token_counts.Counter(token_counts.read_ranks(token_counts.VOCABULARY))
    text = " ".join(rng.choice(["don't", "naïve", "the", "12345", "  ", "\n\n", "x", "日本"]) for _ in range(2000))
    tree = token_counts.Tree.of(text, counter)
    for _ in range(150):
        a = rng.randrange(len(text) + 1)
        b = a + rng.choice([0, 1, 7, 300])
        new = rng.choice(["", " ", "'s", "\n \n", "long inserted run " * 4, "é"])
        text, tree, encoded = tree.edit(text, a, b, new, counter)
        assert tree.total == len(counter.encoding.encode_ordinary(text)) and tree.sums[1] == sum(tree.sums[tree.base:])
    assert encoded < 1500


def test_mixing(docs, rows):
    out = mixing.mix(docs)
    got = out.collect()
    assert sorted((r.doc_id or -1) for r in got) == sorted((r[0] or -1) for r in rows)
    size: Counter = Counter()
    for r in rows:
        size[r[3]] += len(words(r[1]))
    goal = mixing.targets(list(size.items()))
    assert abs(sum(goal.values()) - 1.5 * sum(size.values())) < 1e-6
    taken: Counter = Counter()
    for r in got:
        assert r.source_size == size[r.source] and abs(r.target - goal[r.source]) < 1e-9
        assert 0 <= r.taken <= 2 * r.size and r.taken == r.copies * r.size
        taken[r.source] += r.taken
    biggest = max(r.size for r in got)
    assert all(abs(taken[s] - goal[s]) <= biggest for s in size)
    again = mixing.mix(docs.repartition(3)).collect()
    assert sorted(map(str, again)) == sorted(map(str, got))


def test_mixing_tree(spark, monkeypatch):
    """Many buckets and levels give the same guarantees."""
    monkeypatch.setattr(mixing, "BUCKET_ROWS", 20)
    monkeypatch.setattr(mixing, "FANIN", 3)
    rows = [(i, "w " * (i % 37), "en", f"s{i % 3}" if i % 7 else "hot", 0) for i in range(1500)]
    got = mixing.mix(spark.createDataFrame(rows, DOCS)).collect()
    taken, goal = Counter(), {}
    for r in got:
        taken[r.source] += r.taken
        goal[r.source] = r.target
    assert len(got) == 1500 and all(abs(taken[s] - goal[s]) <= 37 for s in goal)


def test_target_rule():
    goal = mixing.targets([("b", 100), (None, 1000), ("a", 10), ("c", 0)])
    assert goal["a"] == 20 and goal["c"] == 0 and goal["b"] == 200
    assert abs(sum(goal.values()) - 1.5 * 1110) < 1e-9 and goal[None] <= 2000


def test_empty_tables(spark):
    none = frame(spark, [])
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    for result in (substrings.deduplicate(none), phrases.repeated_bytes(none), phrases.remove_repeats(none), jaccard.near_duplicates(none),
                   jaccard.keep_one(none), quality.judge(none), mixing.mix(none), language_model.score(none),
                   decontaminate.contamination(none, decontaminate.build_automaton(bench)), toxicity.score(none, toxicity.fit(none, labels)),
                   token_counts.apply_edits(none, token_counts.build_trees(none), token_counts.redaction_edits(none))):
        assert result.count() == 0


def test_toxicity_index_takes_few_bytes_a_posting(monkeypatch):
    """Building an index and opening one work part by part; before, they took about 39 and 33 bytes a posting at once."""
    import tracemalloc

    import numpy as np
    rng = np.random.default_rng(3)
    monkeypatch.setattr(toxicity, "PART", 1 << 12, raising=False)
    n, terms = 2000, 1500
    picked = [np.sort(rng.choice(terms, 300, replace=False)).astype(np.int32) for _ in range(n)]
    term, sizes = np.concatenate(picked), np.full(n, 300)
    count = rng.integers(1, 4, len(term)).astype(np.uint8)
    tracemalloc.start()
    try:
        index = toxicity._index(np.arange(terms, dtype=np.uint64), rng.uniform(0.01, 2, terms), np.arange(n), rng.integers(0, 2, n), sizes, term, count, 0.5)
        built = tracemalloc.get_traced_memory()[1] / len(term)
        tracemalloc.reset_peak()
        start = tracemalloc.get_traced_memory()[0]
        assert len(index.search.count) + len(index.search.weight) == len(term)
        searched = (tracemalloc.get_traced_memory()[1] - start) / len(term)
    finally:
        tracemalloc.stop()
    assert built < 24 and searched < 16


def test_toxicity_postings_are_gathered_in_few_bytes(spark, monkeypatch):
    """The driver gathers the examples' postings packed, below 3 bytes each; before, it took 8 for each of them."""
    import numpy as np

    kind = type(spark.range(1))
    gathered, plain = [], kind.toArrow

    def measured(self):
        out = plain(self)
        gathered.append((out.column_names, out.nbytes))
        return out

    monkeypatch.setattr(kind, "toArrow", measured)
    rng = np.random.default_rng(5)
    docs = spark.createDataFrame([(i, " ".join(f"w{x}" for x in rng.integers(0, 900, 300))) for i in range(200)], "doc_id long, text string")
    index = toxicity.fit(docs, docs.selectExpr("doc_id", "cast(doc_id % 3 = 0 as int) AS toxic")).index
    postings = len(index.where.flat)
    assert postings > 20_000 and len(index.ids) > 100
    assert max(n for _, n in gathered) < 3 * postings + 16 * len(index.terms)
    term, count = np.array([0, 7, 3, 2_000_000_000, 1], np.int64), np.array([1, 300, 2, 1, 70_000])
    for sent in (5, 0):
        back = toxicity._received(toxicity._sent(term[:sent], count[:sent]))
        assert back[0].tolist() == term[:sent].tolist() and back[1].tolist() == count[:sent].tolist()


def test_other_work_drops_a_kept_index(spark):
    """A worker that read a text for another operator holds no index of an earlier task any more."""
    import pyarrow as pa

    from tillcast.llm import blocks

    def first(batches):
        list(batches)
        made = blocks.keep("index", lambda: "big")
        list(blocks.blocks(iter([pa.record_batch({"text": ["a"]})])))  # its own texts
        yield pa.record_batch({"n": [len(blocks._kept) if made else 0]})

    def second(batches):
        list(blocks.blocks(batches))
        yield pa.record_batch({"n": [len(blocks._kept)]})

    docs = spark.createDataFrame([("a b",)], "text string").coalesce(1)
    assert [r.n for r in docs.mapInArrow(first, "n long").collect()] == [1] * docs.rdd.getNumPartitions()
    assert {r.n for r in docs.mapInArrow(second, "n long").collect()} == {0}


def test_training_is_back_propagation_over_whole_windows(monkeypatch):
    """A window of training gives the weights that tokens taken one by one give, and its steps make no arrays of their own."""
    import numpy as np
    lm = language_model
    rng = np.random.default_rng(5)
    weights = lm.Network.initial(np.log(1 / np.arange(1, lm.SHORTLIST + lm.TAILS + 1)) - 2)
    words_ = np.concatenate([rng.zipf(1.3, 20000), [1]])
    windows = [rng.choice(words_[words_ < lm.SHORTLIST], (lm.WINDOW, lm.TRAIN_LANES)).astype(np.int32) for _ in range(4)]
    for x in windows:
        tail = rng.random(x.shape) < 0.3
        x[tail] = lm.SHORTLIST + rng.integers(0, lm.TAILS, int(tail.sum()))
    windows[3][-5:, -9:] = -1  # lanes that have ended
    stops = [rng.random(x.shape) < 0.02 for x in windows]

    def plain(p, h, x, reset, m, v, steps):
        g = {k: np.zeros_like(w) for k, w in p.items()}
        states, kept = [], []
        for t in range(len(x)):
            h = h * ~reset[t][:, None]
            states.append(h)
            h, *rest = lm.Network.step(p, h, np.maximum(x[t], 0))
            kept.append(rest)
        dh = np.zeros_like(h)
        for t in range(len(x) - 1, -1, -1):
            (z, r, n, hn), prev, live = kept[t], states[t], x[t] >= 0
            dn = dh * (1 - z) * (1 - n * n)
            gates = np.concatenate([dh * (prev - n) * z * (1 - z), dn * hn * r * (1 - r), dn], axis=1)
            through = np.concatenate([gates[:, :2 * lm.HIDDEN], dn * r], axis=1)
            g["u"] += prev.T @ through
            np.add.at(g["x"], x[t][live], gates[live])
            out = np.zeros_like(dh)
            for i in np.flatnonzero(live):
                s, w = prev[i], x[t, i]
                c = w // lm.CLASS_WORDS if w < lm.SHORTLIST else w - lm.SHORTLIST + lm.Network.classes
                a = s @ p["wc"] + p["bc"]
                a = np.exp(a - a.max())
                a /= a.sum()
                a[c] -= 1
                g["wc"] += np.outer(s, a)
                g["bc"] += a
                out[i] = p["wc"] @ a
                if w < lm.SHORTLIST:
                    b = s @ p["ww"][c] + p["bw"][c]
                    b = np.exp(b - b.max())
                    b /= b.sum()
                    b[w % lm.CLASS_WORDS] -= 1
                    g["ww"][c] += np.outer(s, b)
                    g["bw"][c] += b
                    out[i] += p["ww"][c] @ b
            dh = (dh * z + through @ p["u"].T + out) * ~reset[t][:, None]
        fix = np.sqrt(1 - 0.999 ** steps) / (1 - 0.9 ** steps)
        for k, w in g.items():
            w /= (x >= 0).sum()
            m[k] += 0.1 * (w - m[k])
            v[k] += 0.001 * (w * w - v[k])
            p[k] -= lm.RATE * fix * m[k] / (np.sqrt(v[k]) + 1e-8)
        return h

    trainer = lm.Trainer(weights)
    p, m, v = ({k: f(w).astype(np.float64) for k, w in weights.items()} for f in (np.copy, np.zeros_like, np.zeros_like))
    ref = np.zeros((lm.TRAIN_LANES, lm.HIDDEN))
    for k, (x, reset) in enumerate(zip(windows, stops, strict=True), 1):
        ref = plain(p, ref, x, reset, m, v, k)
    monkeypatch.setattr(lm.Network, "step", lambda *a: pytest.fail("a step by itself"))
    h = np.zeros((lm.TRAIN_LANES, lm.HIDDEN), np.float32)
    for x, reset in zip(windows, stops, strict=True):
        h = trainer.window(h, x, reset)
    assert np.allclose(h, ref, atol=5e-3)
    for k, w in p.items():
        assert np.abs(trainer.p[k] - w).mean() < 1e-3, k
