"""The Merkle manifest against a plain recursion over lists of digests."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from llm_helpers import DOCS, edge_documents, frame
from tillcast.llm import manifest


def h(s: str) -> str:
    return hashlib.sha256(s.encode()).hexdigest()


def leaf_of(doc_id, text, lang, source, n_chars):
    return h("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)))


def tree(digests):
    """Root and, per leaf, its (left, right) siblings of every level."""
    paths, at, level = [[] for _ in digests], list(range(len(digests))), list(digests)
    while len(level) > 1:
        for k, i in enumerate(at):
            run = level[i - i % 2:i - i % 2 + 2]
            paths[k].append(("".join(run[:i % 2]), "".join(run[i % 2 + 1:])))
        at = [i // 2 for i in at]
        level = [h("".join(level[i:i + 2])) for i in range(0, len(level), 2)]
    return level[0], paths


def truth(rows, bad):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append((r[0] is not None, r[0] or 0, leaf_of(*r), r))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    built = {}
    for g in names:
        groups[g].sort(key=lambda x: x[:3])
        built[g] = tree([x[2] for x in groups[g]])
    root, tops = tree([built[g][0] for g in names]) if names else (None, [])
    out = []
    for g, top in zip(names, tops, strict=True):
        for x, path in zip(groups[g], built[g][1], strict=True):
            r, way = x[3], path + top
            acc = leaf_of(*r[:4], r[4] + 1) if r[0] in bad and r[4] is not None else x[2]
            for left, right in way:
                acc = h(left + acc + right)
            out.append((r[0], x[2], built[g][0], root, h("".join(a + b for a, b in way)), acc, acc == root))
    return sorted(out, key=repr)


def rows_with_gaps():
    rows = edge_documents()
    rows += [(1000, "t", "Ä", "s1", None), (1001, "", "", "", 0), (1002, "x" * 2_000_000, "solo", None, 7)]
    return rows


@pytest.mark.parametrize("levels", [1, 2, 10])
def test_manifest(spark, monkeypatch, levels):
    monkeypatch.setattr(manifest, "LEVELS", levels)
    monkeypatch.setattr(manifest, "BLOCK", 2 ** levels)
    rows = rows_with_gaps()
    bad = {r[0] for r in rows if r[0] is not None and r[0] % 2}
    df = frame(spark, rows).withColumns({c: F.lit("clash") for c in ("pos", "g", "grp", "digest", "told", "leaf", "root")})
    tampered = {"n_chars": F.when(F.col("doc_id").isin(*bad), F.col("n_chars") + 1).otherwise(F.col("n_chars"))}
    got = manifest.manifest(df, received=tampered).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    want = truth(rows, bad)
    assert 0 < sum(not w[-1] for w in want) < len(want)
    assert sorted((tuple(r) for r in got), key=repr) == want


@pytest.mark.parametrize("rows", [[], [(5, "one", None, None, None)], [(5, "one", "a", "s", 3), (6, None, "b", "s", 0)]])
def test_small_tables(spark, rows):
    got = manifest.manifest(spark.createDataFrame(rows, DOCS)).select(
        "doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    assert sorted((tuple(r) for r in got), key=repr) == truth(rows, set())
