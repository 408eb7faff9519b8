"""Quality rules with adaptive thresholds from quantile sketches (operator 5).

Per (lang, source) Spark's mergeable KLL sketches summarise three features of
the documents; partial sketches are built per task and merged, so a hot source
costs one sketch per task. Limits come from the sketches' quantiles instead of
fixed cutoffs: the upper quartile plus ``FENCE`` interquartile ranges (at least
``SPREAD`` wide, so that a feature that is constant in a group does not reject
the first document that differs). A group of fewer than ``MIN_GROUP`` documents
is too small for quantiles of its own: the sketches of its language, merged
from the group sketches, judge it. The limits are joined back to the documents
and filter them.

Only documents that pass the base rule feed the sketches: what is junk by the
base rule says nothing about how clean text of a source looks.

Edge cases: NULL or empty text has no words, fails the base rule and is not
kept; NULL lang or source is a group like any other; a language whose every
document fails the base rule has no limits and keeps nothing anyway; repeated
documents are judged one by one; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.session import cut_lineage

from .blocks import SPACE, Prefix, blocks, byte_values, column, owners, window_starts, words
from .common import prepare, table

# Fixed values of the contract: base rule and symbol class.
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"

MIN_GROUP = 200
FENCE = 3.0
SKETCH_K = 400  # about 0.7 % rank error
#: feature -> least width of the fence above the upper quartile
FEATURES = {"symbol_share": 0.10, "repeat_share": 0.45, "dup_line_share": 0.50}

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in SYMBOLS]] = True
_NEWLINE = np.uint8(10)


def _repeats(keys: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(found twice or more in its document, equal to an earlier one of its document)."""
    order = np.lexsort((keys, owner))  # stable: equal keys stay in text order
    k, o = keys[order], owner[order]
    same = np.zeros(len(k), bool)
    same[1:] = (k[1:] == k[:-1]) & (o[1:] == o[:-1])
    twice = same.copy()
    twice[:-1] |= same[1:]
    a, b = np.zeros(len(k), bool), np.zeros(len(k), bool)
    a[order], b[order] = twice, same
    return a, b


def _measure(b) -> dict[str, np.ndarray]:
    s, e, first = words(b.data, b.offsets)
    values = byte_values(b.data)
    prefix = Prefix(values)
    solid = np.concatenate([[0], np.cumsum(~SPACE[b.data] & ((b.data & 0xC0) != 0x80))])
    symbol = np.concatenate([[0], np.cumsum(_SYMBOL[b.data])])
    lo, hi = b.offsets[:-1], b.offsets[1:]
    # 3-word windows
    at = window_starts(first, 3)
    own = owners(first)
    grams = Prefix(prefix.spans(s, e)).windows(3)[at] if len(at) else np.zeros(0, np.uint64)
    twice, _ = _repeats(grams, own[at] if len(at) else at)
    inside = np.zeros(len(s), bool)
    for k in range(3):
        inside[at[twice] + k] = True
    # lines, cut at \n, that hold a word
    is_line_byte = b.data != _NEWLINE
    ls, le, lfirst = words(is_line_byte.view(np.uint8), b.offsets, np.arange(256) == 1)
    lown = owners(lfirst)
    full = np.searchsorted(s, le) > np.searchsorted(s, ls)
    ls, le, lown = ls[full], le[full], lown[full]
    _, again = _repeats(prefix.spans(ls, le), lown)
    n = b.n
    return {"n_words": np.diff(first), "word_chars": solid[hi] - solid[lo], "n_symbols": symbol[hi] - symbol[lo],
            "n_dup_lines": np.bincount(lown[again], minlength=n), "n_repeat_words": np.bincount(own[inside], minlength=n),
            "n_lines": np.bincount(lown, minlength=n)}


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
            lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """The base measures of every whole document."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"),
                         F.col(lang_col).alias("lang"), F.col(source_col).alias("source"))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
    schema = T.StructType([source.schema["doc_id"], source.schema["lang"], source.schema["source"],
                           *[T.StructField(n, T.LongType()) for n in names]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            m = _measure(b)
            yield pa.record_batch({**{c: column(b.rows, c) for c in ("doc_id", "lang", "source")},
                                   **{n: m[n].astype(np.int64) for n in names}})

    return source.mapInArrow(run, schema)


def limits(measured: DataFrame) -> DataFrame:
    """lang, source and one upper limit per feature, from merged quantile sketches."""
    base = measured.where(~F.col("base_failed"))
    sketches = base.groupBy("lang", "source").agg(
        F.count("*").alias("n"), *[F.kll_sketch_agg_double(f, F.lit(SKETCH_K)).alias(f) for f in FEATURES])
    by_lang = sketches.groupBy(F.col("lang").alias("l")).agg(
        *[F.kll_merge_agg_double(f, F.lit(SKETCH_K)).alias(f"l_{f}") for f in FEATURES])
    own = sketches.join(by_lang, F.col("lang").eqNullSafe(F.col("l")))

    def limit(f: str, width: float):
        sketch = F.when(F.col("n") >= MIN_GROUP, F.col(f)).otherwise(F.col(f"l_{f}"))
        q1, q3 = (F.kll_sketch_get_quantile_double(sketch, F.lit(q)) for q in (0.25, 0.75))
        return (q3 + F.greatest(FENCE * (q3 - q1), F.lit(width))).alias(f"max_{f}")

    return own.select("lang", "source", *[limit(f, w) for f, w in FEATURES.items()])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
          lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Every document with its measures, its group's limits and the verdict."""
    prepare(docs.sparkSession)
    per_word = F.greatest(F.col("n_words"), F.lit(1))
    measured = cut_lineage(measure(docs, id_col, text_col, lang_col, source_col).select(
        "*",
        ((F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))).alias("base_failed"),
        (F.col("n_symbols") / per_word).alias("symbol_share"),
        (F.col("n_repeat_words") / per_word).alias("repeat_share"),
        (F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1))).alias("dup_line_share")), "quality-measures")
    rules = limits(measured).withColumnsRenamed({"lang": "r_lang", "source": "r_source"})
    joined = measured.join(rules, F.col("lang").eqNullSafe(F.col("r_lang")) & F.col("source").eqNullSafe(F.col("r_source")), "left")
    ok = ~F.col("base_failed")
    for f in FEATURES:
        ok = ok & F.coalesce(F.col(f) <= F.col(f"max_{f}"), F.lit(True))
    return joined.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                         ok.alias("kept"), "lang", "source", *[f"max_{f}" for f in FEATURES])


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "documents"))
