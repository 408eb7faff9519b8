"""Exact n-gram Jaccard join and its components by vertical partitioning (operator 8).

A document is the set of its distinct 5-word shingles; documents with equal
sets form a class and are joined once. The join cuts the global n-gram order
into fragments and never compares whole sets before it has to:

1. *Fragments.* Every class's set is cut by hash into fragments; a fragment
   task sees all holders of its shingles, counts their document frequency and
   keeps shingles held by two classes or more. The partial results are summed
   per class: a class whose unshared shingles alone exceed what J >= 0.8 allows
   has no partner and leaves. Usually nine tenths of the text end here.
2. *Candidates.* Shingles are ordered by (frequency, hash), rarest first. Two
   similar sets share a shingle within their prefixes of n - ceil(0.8 n) + 1
   shingles. A rare shingle (at most ``RARE`` holders) names its pairs. For a
   frequent one only the pairs (hub, member) are named, the hub being the
   member with the fewest rare shingles.
3. *Overlaps.* The sets of named pairs are cut along the global order; partial
   overlaps are counted per fragment and summed per pair.
4. *Members that miss their hub.* If x is not similar to its hub h, then any y
   similar to x shares with it at least alpha(x, y) - |x & h| shingles outside h.
   Such pairs are named through the prefixes of the remainders x - h, y - h, or
   directly where that difference is not positive. So a group of m near copies
   costs m rows, not m * m, and no link between different texts is lost.
5. *Components* of the links by alternating large and small stars, in Spark.

Shingles are identified by about 55 bits of their hash; a verdict could only
change if two different shingles of one candidate pair agreed on all of them.

Edge cases: NULL texts and texts without words have an empty set, 0 shingles
and are linked with nothing; texts of fewer than five words are one shingle;
repeated rows and exact copies share a class; the component id is the smallest
non-NULL doc_id of the component (NULL if there is none); an empty table gives
an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tillcast.session import cut_lineage

from .blocks import Block, Prefix, blocks, byte_values, column, mix, owners, window_starts, words
from .common import prepare, table

WORDS = 5
RARE = 16                 # holders of a shingle whose pairs are named directly
FLUSH_SHINGLES = 1 << 20
PARTS = 8                 # vertical parts of a set when overlaps are counted
# A similarity of 0.8 in integers: 100 * o >= 80 * (a + b - o).
NEED = "cast(ceil((a_n + b_n) * 4 / 9.0 - 0.000000001) as int)"


def _shingles(b: Block, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingles by document, document offsets into them, and each set's class key."""
    s, e, first = words(b.data, b.offsets)
    prefix = Prefix(Prefix(byte_values(b.data, fold=True)).spans(s, e))
    own = owners(first)
    at = window_starts(first, width)
    h, doc = (prefix.windows(width)[at], own[at]) if len(at) else (np.zeros(0, np.uint64), np.zeros(0, np.int64))
    lens = np.diff(first)
    few = np.flatnonzero((lens > 0) & (lens < width))
    h = np.concatenate([h, prefix.spans(first[few], first[few] + lens[few])])
    doc = np.concatenate([doc, few])
    order = np.lexsort((h, doc))
    h, doc = h[order], doc[order]
    keep = np.ones(len(h), bool)
    keep[1:] = (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])
    h, doc = h[keep], doc[keep]
    offs = np.searchsorted(doc, np.arange(b.n + 1))
    one, two = (np.concatenate([[np.uint64(0)], np.cumsum(x, dtype=np.uint64)]) for x in (mix(h + np.uint64(11)), mix(h ^ np.uint64(0x5BD1E995))))
    n = np.diff(offs).astype(np.uint64)
    key = mix(mix(one[offs[1:]] - one[offs[:-1]]) + (two[offs[1:]] - two[offs[:-1]]) + n)
    return h, offs, key, doc


def classes(docs: DataFrame, width: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, class of every document; class is NULL for an empty set."""
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = T.StructType([source.schema["doc_id"], T.StructField("n_shingles", T.LongType()), T.StructField("class", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in blocks(batches):
            _, offs, key, _ = _shingles(b, width)
            n = np.diff(offs)
            yield pa.record_batch({"doc_id": column(b.rows, "doc_id"), "n_shingles": n.astype(np.int64),
                                   "class": pa.array(key.view(np.int64), mask=n == 0)})

    return source.mapInArrow(run, schema)


def _six(x: np.ndarray) -> bytes:
    """The upper 48 bits of each value."""
    return np.ascontiguousarray((x >> np.uint64(16)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()


def _from_six(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(raw, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


_ENTRY = np.dtype([("class", "<u8"), ("n", "<u4"), ("df", "<u4"), ("item", "<u8")])


def shared_items(docs: DataFrame, fragments: int, width: int = WORDS, text_col: str = "text") -> DataFrame:
    """class, n, items, dfs: the shared shingles, rarest first, of the classes that can have a partner."""
    source = docs.select(F.col(text_col).alias("text"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        size = 0

        def emit() -> pa.RecordBatch:
            h, key, n = (np.concatenate([x[i] for x in held]) for i in range(3))
            _, pick = np.unique(key, return_index=True)      # one copy of each class
            start = np.concatenate([[0], np.cumsum(n)])
            chosen = np.zeros(len(key), bool)
            chosen[pick] = True
            h = h[np.repeat(chosen, n)]
            key, n = key[chosen], n[chosen]
            doc = np.repeat(np.arange(len(key)), n)
            del start
            frag = (h % np.uint64(fragments)).astype(np.int64)
            order = np.argsort(frag, kind="stable")
            h, doc, frag = h[order], doc[order], frag[order]
            edges = np.searchsorted(frag, np.arange(fragments + 1))
            rows = []
            for f in range(fragments):
                lo, hi = edges[f], edges[f + 1]
                if lo == hi:
                    continue
                d = doc[lo:hi]
                at = np.flatnonzero(np.concatenate([[True], d[1:] != d[:-1]]))
                counts = np.diff(np.append(at, len(d))).astype("<u4")
                head = np.uint32(len(at)).tobytes() + key[d[at]].astype("<u8").tobytes() + n[d[at]].astype("<u4").tobytes() + counts.tobytes()
                rows.append((f, head + _six(h[lo:hi])))
            held.clear()
            return pa.record_batch({"frag": pa.array([r[0] for r in rows], pa.int32()), "part": pa.array([r[1] for r in rows], pa.binary())})

        for b in blocks(batches):
            h, offs, key, _ = _shingles(b, width)
            n = np.diff(offs)
            if len(h):
                held.append((h, key[n > 0], n[n > 0]))
                size += len(h)
            if size >= FLUSH_SHINGLES:
                yield emit()
                size = 0
        if size:
            yield emit()

    def fragment(f: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        items, keys, ns = [], [], []
        for raw in parts:
            k = int(np.frombuffer(raw, "<u4", 1)[0])
            key = np.frombuffer(raw, "<u8", k, 4)
            n = np.frombuffer(raw, "<u4", k, 4 + 8 * k)
            counts = np.frombuffer(raw, "<u4", k, 4 + 12 * k)
            items.append(_from_six(raw[4 + 16 * k:]))
            keys.append(np.repeat(key, counts))
            ns.append(np.repeat(n, counts))
        item, key, n = np.concatenate(items), np.concatenate(keys), np.concatenate(ns)
        order = np.lexsort((key, item))
        item, key, n = item[order], key[order], n[order]
        new_item = np.concatenate([[True], item[1:] != item[:-1]])
        fresh = new_item | np.concatenate([[True], key[1:] != key[:-1]])   # copies of a class count once
        item, key, n, new_item = item[fresh], key[fresh], n[fresh], new_item[fresh]
        at = np.flatnonzero(new_item)
        df = np.repeat(np.diff(np.append(at, len(item))), np.diff(np.append(at, len(item))))
        keep = df > 1
        out = np.empty(int(keep.sum()), _ENTRY)
        out["class"], out["n"], out["df"] = key[keep], n[keep], df[keep]
        out["item"] = (item[keep] << np.uint64(16)) | np.uint64(f & 0xFFFF)
        bucket = (out["class"] % np.uint64(fragments)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        out, bucket = out[order], bucket[order]
        at = np.flatnonzero(np.concatenate([[True], bucket[1:] != bucket[:-1]])) if len(out) else np.zeros(0, np.int64)
        ends = np.append(at[1:], len(out))
        yield pa.record_batch({"frag": pa.array(bucket[at], pa.int32()),
                               "part": pa.array([out[i:j].tobytes() for i, j in zip(at, ends, strict=True)], pa.binary())})

    def gather(_: int, parts: list[bytes]) -> Iterator[pa.RecordBatch]:
        e = np.concatenate([np.frombuffer(raw, _ENTRY) for raw in parts])
        e = e[np.lexsort((e["item"], e["df"], e["class"]))]
        at = np.flatnonzero(np.concatenate([[True], e["class"][1:] != e["class"][:-1]]))
        shared = np.diff(np.append(at, len(e)))
        n = e["n"][at].astype(np.int64)
        able = shared >= (4 * n + 4) // 5                     # unshared shingles leave room for a partner
        e = e[np.repeat(able, shared)]
        offs = pa.array(np.concatenate([[0], np.cumsum(shared[able])]), pa.int32())
        cls = np.ascontiguousarray(e["class"])[np.concatenate([[0], np.cumsum(shared[able])[:-1]]).astype(np.int64)] if len(e) else np.zeros(0, np.uint64)
        yield pa.record_batch({
            "class": cls.view(np.int64), "n": n[able].astype(np.int32),
            "items": pa.ListArray.from_arrays(offs, pa.array(np.ascontiguousarray(e["item"]).view(np.int64))),
            "dfs": pa.ListArray.from_arrays(offs, pa.array(e["df"].astype(np.int32)))})

    def grouped(work):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            now, parts = None, []
            for batch in batches:                              # sorted by fragment
                for f, raw in zip(column(batch, "frag").to_pylist(), column(batch, "part").to_pylist(), strict=True):
                    if f != now and parts:
                        yield from work(now, parts)
                        parts = []
                    now = f
                    parts.append(raw)
            if parts:
                yield from work(now, parts)
        return run

    packed = "frag int, part binary"
    dealt = source.mapInArrow(cut, packed).repartition("frag").sortWithinPartitions("frag")
    found = dealt.mapInArrow(grouped(fragment), packed).repartition("frag").sortWithinPartitions("frag")
    return found.mapInArrow(grouped(gather), "class long, n int, items array<long>, dfs array<int>")


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).where("a < b").distinct()


def _overlaps(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """a, b, a_n, b_n, o: partial overlaps per vertical part, summed per pair."""
    cut = sets.select("class", "n", F.posexplode(F.array(*[
        F.expr(f"filter(items, q -> pmod(q, {PARTS}) = {p})") for p in range(PARTS)])).alias("part", "items"))
    a = cut.select(F.col("class").alias("a"), F.col("n").alias("a_n"), "part", F.col("items").alias("a_items"))
    b = cut.select(F.col("class").alias("b"), F.col("n").alias("b_n"), "part", F.col("items").alias("b_items"))
    return (pairs.join(a, "a").join(b, ["b", "part"])
            .groupBy("a", "b").agg(F.first("a_n").alias("a_n"), F.first("b_n").alias("b_n"),
                                   F.sum(F.size(F.array_intersect("a_items", "b_items"))).cast("int").alias("o")))


def links(sets: DataFrame) -> DataFrame:
    """a, b: the similar pairs that connect each component (all of them but those a hub stands for)."""
    near = "5 * least(a_n, b_n) >= 4 * greatest(a_n, b_n)"
    sized = sets.select("class", "n", F.expr(f"n - size(items) + size(filter(dfs, d -> d <= {RARE}))").alias("rare"),
                        F.expr("slice(arrays_zip(items, dfs), 1, size(items) - cast(ceil(n * 4 / 5.0 - 0.000000001) as int) + 1)").alias("prefix"))
    heads = cut_lineage(sized.select("class", "n", "rare", F.explode("prefix").alias("p"))
                        .select("class", "n", "rare", F.col("p.items").alias("item"), F.col("p.dfs").alias("df")), "jaccard-prefixes")
    rare = heads.where(F.col("df") <= RARE)
    left = rare.select("item", F.col("class").alias("x"), F.col("n").alias("a_n"))
    right = rare.select("item", F.col("class").alias("y"), F.col("n").alias("b_n"))
    direct = _ordered(left.join(right, "item").where("x < y").where(near))
    common = heads.where(F.col("df") > RARE)
    # written, so that the join below deals raw rows only and Spark can split a hot shingle
    hubs = cut_lineage(common.groupBy("item").agg(F.min(F.struct("rare", "n", "class")).alias("h"))
                       .select("item", F.col("h.class").alias("hub")), "jaccard-item-hubs")
    member = cut_lineage(common.join(hubs, "item").where("class != hub").select("hub", "class").distinct(), "jaccard-members")
    first = cut_lineage(_overlaps(direct.unionByName(_ordered(member.select(F.col("hub").alias("x"), F.col("class").alias("y")))).distinct(), sets),
                        "jaccard-overlaps")
    similar = f"o >= {NEED}"

    # members x of a hub h, with |x & h|
    seen = first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "o", (F.expr(similar)).alias("linked"))
    around = cut_lineage(member.withColumn("a", F.least("hub", "class")).withColumn("b", F.greatest("hub", "class"))
                         .join(seen, ["a", "b"]).select("hub", "class", "o", "linked")
                         .join(sets.select("class", "n", "items"), "class")
                         .join(sets.select(F.col("class").alias("hub"), F.col("items").alias("h_items")), "hub")
                         .select("hub", "class", "n", "o", "linked", F.size("items").alias("shared"),
                                 F.array_except("items", "h_items").alias("rest")), "jaccard-hubs")
    lost = around.where("not linked")
    # y small enough that x & h alone could suffice: no shingle outside the hub is forced
    free = (lost.select("hub", F.col("class").alias("x"),
                        F.explode(F.expr("sequence(cast(ceil(n * 4 / 5.0) as int), greatest(cast(floor(o * 9 / 4.0) as int) - n, cast(ceil(n * 4 / 5.0) as int)))")).alias("n"),
                        F.expr("cast(floor(o * 9 / 4.0) as int) - n").alias("most"))
            .where("n <= most").join(around.select("hub", F.col("class").alias("y"), "n"), ["hub", "n"]).select("x", "y"))
    # else they share a shingle of the remainders' prefixes
    rest = around.select("hub", "class", "n", "o", "linked", F.expr("n - o").alias("outside"), F.explode(F.expr(
        "slice(rest, 1, least(size(rest), greatest(0, (n - o) - (n - shared) + 1 - "
        "if(linked, 1, greatest(1, cast(ceil((n + ceil(n * 4 / 5.0)) * 4 / 9.0 - 0.000000001) as int) - o)))))")).alias("item"))
    x, y = (rest.select("hub", "item", F.col("class").alias(c), F.col("n").alias(f"{k}_n"), F.col("o").alias(f"{k}_o"),
                        F.col("outside").alias(f"{k}_out"), F.col("linked").alias(f"{k}_linked")) for c, k in (("x", "a"), ("y", "b")))
    forced = (x.where("not a_linked").join(y, ["hub", "item"]).where("x != y and (b_linked or x < y)").where(near)
              .where(f"least(a_out, b_out) >= {NEED} - least(a_o, b_o)").select("x", "y"))
    more = _ordered(free.unionByName(forced)).join(first.select("a", "b"), ["a", "b"], "left_anti")
    return first.unionByName(_overlaps(more, sets)).where(similar).select("a", "b")


def components(edges: DataFrame) -> DataFrame:
    """node, root of every node with an edge: alternating large and small stars, until nothing changes."""
    edges = cut_lineage(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "component-edges")
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # small star: every node points its smaller neighbours at the least of them
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(down, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v")
        after = cut_lineage(small.unionByName(down.select("u", F.col("m").alias("v"))).distinct(), "component-edges")
        changed = after.join(edges, ["u", "v"], "left_anti").limit(1).count() + edges.join(after, ["u", "v"], "left_anti").limit(1).count()
        edges = after
        if not changed:
            return edges.groupBy(F.col("u").alias("node")).agg(F.min("v").alias("root"))


def near_duplicates(docs: DataFrame, width: int = WORDS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every document, and its class."""
    spark = docs.sparkSession
    prepare(spark)
    fragments = min(1 << 16, 2 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    members = cut_lineage(classes(docs, width, id_col, text_col), "jaccard-classes")
    sets = cut_lineage(shared_items(docs, fragments, width, text_col), "jaccard-sets")
    roots = components(links(sets))
    per_class = members.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("least"))
    rooted = (per_class.join(roots, per_class["class"] == roots["node"], "left")
              .select("class", "least", F.coalesce("root", "class").alias("root")))
    ids = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    by_class = rooted.join(ids, "root").select("class", "component_id")
    return (members.join(by_class, "class", "left")
            .select("doc_id", "n_shingles", F.expr("if(class is null, doc_id, component_id)").alias("component_id"), "class"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One document of each component, the one with the smallest id, in the
    columns it came with; documents without words or id are all kept."""
    found = near_duplicates(docs, id_col=id_col, text_col=text_col)
    gone = found.where("doc_id > component_id").select(F.col("doc_id").alias(id_col)).distinct()
    return docs.join(gone, id_col, "left_anti")


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g
      FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS o FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY x, y),
l AS (SELECT x, y FROM o JOIN n AS a ON a.doc_id = x JOIN n AS b ON b.doc_id = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
e AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(node, id) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.y, r.id FROM r JOIN e ON e.x = r.node)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, c.id AS component_id
FROM w LEFT JOIN n USING (doc_id) JOIN (SELECT node, min(id) AS id FROM r GROUP BY node) AS c ON c.node = w.doc_id
"""
