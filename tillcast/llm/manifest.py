"""Merkle manifest of a dataset from concatenated-level strings (operator 12).

Every row is a leaf, the leaves of a group (language) in order of their id
form a tree of ``FANOUT`` children a node, and the group roots, in order of
the group, form a tree again. A leaf's proof is what stands beside its path.

Leaves are dealt into aligned blocks of ``BLOCK`` = FANOUT ** LEVELS leaves.
A block keeps each of its levels as one string of 64 hex digits a node; a
parent is the hash of a fixed-width substring of the level below, and what
stands on the flanks of a node inside its parent's substring are the siblings
of the proof. The blocks' roots are the leaves of the next round (a partial
last block hashes its single node up to the block's height, as the tree
itself does), so a group of n leaves takes log_BLOCK(n) rounds. Proofs go the
other way: each block of a round hands its nodes the segments above them, one
row a block, and only the last step has a row per leaf.

All of it is DataFrame expressions. Texts are read once, to hash them; leaf
places come from a range-partitioned sort (``operators.ranking``), so a group
with a third of all rows is no task of its own, and no task holds more than
one block of digests.

Edge cases: NULL columns enter a leaf as ``-`` and empty ones as ``0:``; NULL
ids come first in their group, rows with equal ids follow each other by the
digest of their leaf; the NULL group comes first; a single leaf is its own
root and has an empty proof; an empty table gives an empty manifest. Texts of
any length are hashed whole. Input columns other than those named are not
read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillcast.operators.ranking import with_position
from tillcast.session import cut_lineage

from .common import prepare, table

# Fixed values of the contract.
FANOUT = 2
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
TAMPER_ONE_OF = 7

LEVELS = 10                # of a block
BLOCK = FANOUT ** LEVELS
DIGEST = 64                # hex digits


def leaf(fields: Sequence[Column]) -> Column:
    """Hash of the fields, each told by its length."""
    told = [F.coalesce(F.concat(F.octet_length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in fields]
    return F.sha2(F.concat(*told), 256)


def _cut(level: Column, start: Column, nodes: Column) -> Column:
    """``nodes`` digests of a level from node ``start`` on. Levels are binary: fixed-width substrings need no scan."""
    return F.substring(level, (start * DIGEST + 1).cast("int"), (nodes * DIGEST).cast("int"))


def _nodes(level: Column) -> Column:
    return F.call_function("div", F.octet_length(level), F.lit(DIGEST)).cast("int")


def _hash(c: Column) -> Column:
    return F.sha2(c, 256).cast("binary")


def _next_level(level: Column) -> Column:
    last = F.call_function("div", _nodes(level) - 1, F.lit(FANOUT)).cast("int")
    parents = F.transform(F.sequence(F.lit(0), last), lambda i: F.sha2(_cut(level, i * FANOUT, F.lit(FANOUT)), 256))
    return F.array_join(parents, "").cast("binary")


def _levels(level: Column, height: Column) -> Column:
    """The level strings of a block, from its nodes to its root."""
    steps = F.when(height > 0, F.sequence(F.lit(1), height)).otherwise(F.array().cast("array<int>"))
    return F.aggregate(steps, F.array(level), lambda acc, _: F.concat(acc, F.array(_next_level(F.element_at(acc, -1)))))


def _segments(levels: Column, index: Column) -> Column:
    """What stands left and right of node ``index`` inside its parent's substring, level by level below the root."""
    widths = F.array(*[F.lit(FANOUT ** k) for k in range(LEVELS + 1)])  # leaves below a node of each level

    def flanks(level: Column, i: Column) -> Column:
        run = i - i % FANOUT
        return F.struct(_cut(level, run, i - run).alias("left"),
                        _cut(level, i + 1, F.least(run + FANOUT, _nodes(level)) - i - 1).alias("right"))

    def beside(level: Column, k: Column) -> Column:
        at = F.call_function("div", index, F.element_at(widths, k + 1)).cast("int")
        return F.transform(F.array(at), lambda i: flanks(level, i))[0]  # the place is worked out once
    return F.transform(F.slice(levels, F.lit(1), F.size(levels) - 1), beside)


def proof_digest(segments: Column) -> Column:
    joined = F.transform(segments, lambda s: F.concat(s["left"], s["right"]))
    return F.sha2(F.aggregate(joined, F.lit("").cast("binary"), lambda acc, s: F.concat(acc, s)), 256)


def fold(digest: Column, segments: Column) -> Column:
    """The root that a leaf and its siblings lead to."""
    return F.aggregate(segments, digest.cast("binary"), lambda acc, s: _hash(F.concat(s["left"], acc, s["right"]))).cast("string")


def _height(n: int) -> int:
    h = 0
    while n > 1:
        n, h = -(-n // FANOUT), h + 1
    return h


def _blocks(nodes: DataFrame, carried: Sequence[str]) -> DataFrame:
    """(g, block, n, levels, rows) of nodes (g, pos, n, digest, carried...): n nodes in all of group g."""
    small = F.lit(0)  # height of a tree of at most one block
    for n in range(LEVELS):
        small = F.when(F.col("n") > FANOUT ** n, n + 1).otherwise(small)
    row = F.struct("pos", "digest", *carried)
    nodes = nodes.withColumn("block", F.call_function("div", F.col("pos"), F.lit(BLOCK)))
    if carried:  # as many partitions as asked for: hashing a block takes long for its few bytes
        nodes = nodes.repartition(int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions")), "g", "block")
    got = (nodes.groupBy("g", "block", "n")
           .agg(F.sort_array(F.collect_list(row)).alias("rows")))
    height = F.when(F.col("n") > BLOCK, LEVELS).otherwise(small)
    first = F.array_join(F.transform("rows", lambda r: r["digest"]), "").cast("binary")
    return got.select("g", "block", "n", _levels(first, height).alias("levels"),
                      F.transform("rows", lambda r: F.struct(*[r[c].alias(c) for c in carried]) if carried else r["pos"]).alias("rows"))


def trees(nodes: DataFrame, carried: Sequence[str] = ()) -> list[DataFrame]:
    """The written blocks of each round; the last round has one block a group, whose last level is the group's root."""
    largest = nodes.agg(F.max("n")).first()[0] or 0
    rounds = [cut_lineage(_blocks(nodes, carried), "merkle")]
    while largest > BLOCK:
        largest = -(-largest // BLOCK)
        up = rounds[-1].select("g", F.col("block").alias("pos"), F.ceil(F.col("n") / BLOCK).alias("n"),
                               F.element_at("levels", -1).cast("string").alias("digest"))
        rounds.append(cut_lineage(_blocks(up, ()), "merkle"))
    return rounds


def roots(rounds: list[DataFrame]) -> DataFrame:
    """(g, digest): the groups' roots."""
    return rounds[-1].select("g", F.element_at("levels", -1).cast("string").alias("digest"))


def _above(rounds: list[DataFrame], tails: DataFrame) -> DataFrame:
    """The first round's blocks with ``tail``: the segments above the block's root, up to those that ``tails``
    (g, tail and further columns of the group) gives."""
    more = [c for c in tails.columns if c not in ("g", "tail")]
    at = rounds[-1].join(tails, "g")
    for below in reversed(rounds[:-1]):
        each = F.transform(F.sequence(F.lit(0), F.size("rows") - 1), lambda i: F.struct(
            (F.col("block") * BLOCK + i).alias("block"), F.concat(_segments(F.col("levels"), i), F.col("tail")).alias("tail")))
        at = below.join(at.select("g", *more, F.inline(each)), ["g", "block"])
    return at


def manifest(df: DataFrame, group: str = "lang", key: str = "doc_id", fields: Sequence[str] = FIELDS,
             received: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``df``: key, group, leaf, subroot, root, proof (its segments, as hex), folded_root, verified.

    ``received`` replaces fields by what a receiver holds: ``folded_root`` is
    recomputed from those and the manifest's siblings, ``verified`` tells
    whether it is the root. Without it the rows are verified as they are.
    """
    prepare(df.sparkSession)
    fields = list(fields)
    held = [(received or {}).get(c, F.col(c)) for c in fields]
    leaves = df.select(F.col(key).alias("key"), F.col(group).alias("grp"), leaf([F.col(c) for c in fields]).alias("digest"),
                       leaf(held).alias("told"))
    leaves = leaves.withColumn("told", F.when(F.col("told") != F.col("digest"), F.col("told")))  # only where it differs
    leaves = cut_lineage(leaves, "leaves")
    placed = with_position(leaves, ["grp"], [F.col("key").asc_nulls_first(), "digest"], "pos", "n")
    placed = placed.withColumn("g", F.coalesce(F.concat(F.lit("="), F.col("grp")), F.lit("")))  # "": the NULL group
    low = trees(placed, ["key", "told"])
    # The groups' roots by group: "" (NULL) first, then by their bytes.
    tops = with_position(roots(low).withColumnRenamed("g", "of"), [], ["of"], "pos", "n").withColumn("g", F.lit(""))
    high = trees(tops, ["of"])
    empty = F.array().cast("array<struct<left:binary,right:binary>>")
    high_blocks = _above(high, roots(high).select("g", F.col("digest").alias("root"), empty.alias("tail")))
    each = F.transform("rows", lambda r, i: F.struct(
        r["of"].alias("g"), _cut(F.element_at("levels", 1), i, F.lit(1)).cast("string").alias("subroot"), F.col("root"),
        F.concat(_segments(F.col("levels"), i), F.col("tail")).alias("tail")))
    tails = cut_lineage(high_blocks.select(F.inline(each)), "tails")
    blocks = _above(low, tails)

    def entry(r: Column, i: Column) -> Column:
        digest = _cut(F.element_at("levels", 1), i, F.lit(1)).cast("string")
        return F.struct(r["key"].alias("key"), digest.alias("leaf"), F.coalesce(r["told"], digest).alias("told"),
                        F.concat(_segments(F.col("levels"), i), F.col("tail")).alias("proof"))
    out = blocks.select("g", "subroot", "root", F.transform("rows", entry).alias("rows"))
    # Proofs are folded inside the array: a row per leaf carries digests, not segments.
    done = F.transform("rows", lambda r: F.struct(
        r["key"].alias(key), r["leaf"].alias("leaf"), proof_digest(r["proof"]).alias("proof_sha256"),
        fold(r["told"], r["proof"]).alias("folded_root")))
    return out.select(F.when(F.col("g") != "", F.expr("substring(g, 2)")).alias(group), "subroot", "root", F.inline(done)).withColumn(
        "verified", F.col("folded_root") == F.col("root"))


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % TAMPER_ONE_OF == 0
    received = {"n_chars": F.when(hit, F.col("n_chars").cast("decimal(20,0)") + 1).otherwise(F.col("n_chars").cast("decimal(20,0)"))}
    return manifest(docs, received=received).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


_FIELD = "coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
_LEAF = " || ".join(_FIELD.format(c=c) for c in FIELDS)
_CLIMB = """SELECT c.k, c.g, c.lvl + 1, c.pos // 2,
           sha256(CASE WHEN c.pos % 2 = 0 THEN c.acc || coalesce(s.digest, '') ELSE s.digest || c.acc END),
           c.proof || coalesce(s.digest, '')
    FROM {climb} c JOIN {heights} h ON h.g = c.g AND c.lvl < h.height
    LEFT JOIN {nodes} s ON s.g = c.g AND s.lvl = c.lvl AND s.pos = xor(c.pos, 1)"""
_UP = """SELECT lvl + 1, g, pos // 2, sha256(string_agg(digest, '' ORDER BY pos)), (n + 1) // 2
    FROM {nodes} WHERE n > 1 GROUP BY lvl, g, pos // 2, n"""
# crc32 of the decimal id: each byte is a xor, then eight steps of the polynomial.
_CRC = """xor(4294967295, list_reduce([4294967295::BIGINT] || flatten(list_transform(string_split(doc_id::VARCHAR, ''),
        lambda c: [ord(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda a, x: CASE WHEN x >= 0 THEN xor(a, x) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""
SQL = f"""
WITH RECURSIVE hashed AS (
    SELECT doc_id, CASE WHEN lang IS NULL THEN '' ELSE '=' || lang END AS g, sha256({_LEAF}) AS leaf,
           CASE WHEN {_CRC} % {TAMPER_ONE_OF} = 0
                THEN sha256({_LEAF.replace("n_chars::VARCHAR", "(n_chars + 1)::VARCHAR")}) ELSE sha256({_LEAF}) END AS told
    FROM documents),
placed AS (
    SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY g) AS n,
           row_number() OVER () AS k
    FROM hashed),
low(lvl, g, pos, digest, n) AS (
    SELECT 0, g, pos, leaf, n FROM placed UNION ALL {_UP.format(nodes="low")}),
low_heights AS (SELECT g, max(lvl) AS height FROM low GROUP BY g),
subroots AS (SELECT g, digest FROM low WHERE n = 1),
high(lvl, g, pos, digest, n) AS (
    SELECT 0, 'all', row_number() OVER (ORDER BY encode(g)) - 1, digest, count(*) OVER () FROM subroots
    UNION ALL {_UP.format(nodes="high")}),
high_heights AS (SELECT g, max(lvl) AS height FROM high GROUP BY g),
climb(k, g, lvl, pos, acc, proof) AS (
    SELECT k, g, 0, pos, told, '' FROM placed
    UNION ALL {_CLIMB.format(climb="climb", heights="low_heights", nodes="low")}),
top_places AS (SELECT g AS lang_g, row_number() OVER (ORDER BY encode(g)) - 1 AS pos FROM subroots),
climb2(k, g, lvl, pos, acc, proof) AS (
    SELECT c.k, 'all', 0, t.pos, c.acc, c.proof
    FROM climb c JOIN low_heights h ON h.g = c.g AND c.lvl = h.height JOIN top_places t ON t.lang_g = c.g
    UNION ALL {_CLIMB.format(climb="climb2", heights="high_heights", nodes="high")}),
done AS (SELECT c.k, c.acc, c.proof FROM climb2 c JOIN high_heights h ON c.lvl = h.height)
SELECT p.doc_id, p.leaf, s.digest AS subroot, r.digest AS root, sha256(d.proof) AS proof_sha256, d.acc AS folded_root,
       d.acc = r.digest AS verified
FROM placed p JOIN subroots s ON s.g = p.g JOIN done d ON d.k = p.k CROSS JOIN (SELECT digest FROM high WHERE n = 1) r
"""
