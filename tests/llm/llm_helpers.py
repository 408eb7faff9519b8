"""Fixtures of the operator tests: hand-made documents with every edge, and brute-force judges."""

from __future__ import annotations

import random
import re

from pyspark.sql import types as T

SF = "/root/testdata/sf0.001"
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
                     T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())])


def words(text):
    return (text or "").encode().split()


def lower(b: bytes) -> bytes:
    return b.lower()


def edge_documents(seed: int = 5) -> list[tuple]:
    """Copies, near copies, shared passages, runs of one word, multi-byte text, NULLs, empties, repeated rows."""
    rng = random.Random(seed)
    vocab = [f"w{rng.randrange(10**6):x}" for _ in range(400)] + ["über", "naïve", "日本語", "Ω"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    passage = text(70)
    base = text(160)
    texts = [text(120), passage + "\n" + text(40), text(30) + "\t" + passage, text(55) + " " + passage + " " + text(9), base, base]
    for k in range(6):
        w = base.split()
        w[7 + 20 * k] = f"edit{k}"
        texts.append(" ".join(w))
    texts += ["", None, " \n\t ", "one", "two words", "a b c d", "lone " * 130, "lone " * 131 + "end", "x" * 200, "é" * 120, "x" * 201 + "y",
              text(49), text(50), "The " + passage.upper(), text(3000), "a@b.example.com " * 20 + "\n" + "same line here\n" * 5]
    rows = [(i * 3 + 1, t, rng.choice(["en", "de", None]), rng.choice(["s1", "s2", "s3", None]), len(t or "")) for i, t in enumerate(texts)]
    rows.append(rows[0])                                              # a repeated row
    rows.append((rows[4][0], text(90) + " " + passage, "en", "s1", 0))  # an id with another text
    rows.append((None, base, "en", "s2", 0))                          # no id
    rng.shuffle(rows)
    return rows


def frame(spark, rows):
    """With further columns whose names clash with the operators' own."""
    from pyspark.sql import functions as F
    df = spark.createDataFrame(rows, DOCS)
    for name in ("th", "class", "spans", "size", "copies", "score", "key", "node", "host", "kept"):
        df = df.withColumn(name, F.lit("clash"))
    return df


def repeated(seqs: list[tuple[int | None, list]], width: int) -> list[list[bool]]:
    """Brute force: units covered by a window that also starts in a document with a smaller id."""
    first: dict[tuple, int] = {}
    for i, s in seqs:
        if i is not None:
            for k in range(len(s) - width + 1):
                w = tuple(s[k:k + width])
                first[w] = min(first.get(w, i), i)
    out = []
    for i, s in seqs:
        gone = [False] * len(s)
        for k in range(len(s) - width + 1 if i is not None else 0):
            if first[tuple(s[k:k + width])] < i:
                gone[k:k + width] = [True] * width
        out.append(gone)
    return out


ITEM_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")


def item_words(text):
    return ITEM_WORD.findall((text or "").encode().lower())
