"""The corpus pipeline: documents to a training mix, in five stages.

Every stage is ``(spark, docs, sf_dir) -> DataFrame``. ``run`` writes each
stage's result as Parquet in the shared folder and reads it back as the next
one's input, so a lost executor never costs more than the running stage. All
stages but the last return the columns of ``documents``.

1. toxicity: documents predicted toxic go (operator 4; labels of held-out ids unread).
2. near duplicates: one document, the smallest id, of each component at a
   5-word-shingle Jaccard similarity of 0.8 stays (operator 8).
3. suffix-array dedup: bytes of 50-byte strings that a document with a smaller
   id also holds are cut, at character boundaries; what is left empty goes (operator 7).
4. decontamination: words inside benchmark windows are cut; documents that
   consist of them by more than half go (operator 6).
5. mix: every document with its number of copies, sources at their target
   weights; documents with no copy go (operator 10).

Edge cases follow the operators': NULL or empty texts pass stages 1 to 4
unchanged and are never taken by the mix; repeated rows share one row of the
mix with their copies added up; an empty table stays empty.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.llm import decontaminate, jaccard, mixing, phrases, toxicity
from tillcast.llm.common import table
from tillcast.session import cut_lineage


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.drop_toxic(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return jaccard.keep_one(docs).select(docs.columns)


def _recount(docs: DataFrame) -> DataFrame:
    """n_chars of the text as it is now."""
    return docs.withColumn("n_chars", F.coalesce(F.length("text").cast(docs.schema["n_chars"].dataType), "n_chars"))


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(phrases.remove_repeats(docs))


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _recount(decontaminate.remove_spans(docs, decontaminate.build_automaton(table(spark, sf_dir, "benchmark"))))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of documents, and size, source_size, target, copies, taken."""
    th = F.xxhash64("text")
    plan = (mixing.mix(docs.withColumn("__th", th), keep=["__th"]).where("copies > 0")
            .groupBy(F.col("doc_id").alias("__id"), F.col("__th").alias("__text"), F.col("source").alias("__source"))
            .agg(F.first("size").alias("size"), F.first("source_size").alias("source_size"), F.first("target").alias("target"),
                 F.sum("copies").alias("copies"), F.sum("taken").alias("taken")))
    rows = docs.drop(*DECISION).withColumn("__th", th).dropDuplicates(["doc_id", "__th", "source"])
    same = (F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__th") == F.col("__text"))
            & F.col("source").eqNullSafe(F.col("__source")))
    return rows.join(plan, same).drop("__th", "__id", "__text", "__source")


#: Columns of the mix; input columns of these names give way to them.
DECISION = ["size", "source_size", "target", "copies", "taken"]

STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("suffix_array_dedup", cut_repeats),
    ("decontamination", cut_benchmark),
    ("mix", mix_sources),
]

#: The fitted, rounded and byte-cutting stages have no SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = cut_lineage(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
