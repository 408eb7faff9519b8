"""Every registered query against its DuckDB oracle on the smallest driver data."""

from __future__ import annotations

import pytest

from tillcast.registry import load_all
from tools.oracle_check import canon, duck_connect

SF = "/root/testdata/sf0.001"
QUERIES, ORACLE = load_all()


@pytest.fixture(scope="module")
def duck():
    con = duck_connect(SF)
    yield con
    con.close()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, name):
    df = QUERIES[name](spark, SF)
    rows = [tuple(r) for r in df.collect()]
    if name not in ORACLE:
        assert df.columns
        return
    rel = duck.execute(ORACLE[name])
    cols = [d[0] for d in rel.description]
    c1, r1 = canon(df.columns, rows)
    c2, r2 = canon(cols, rel.fetchall())
    assert c1 == c2
    assert len(r1) == len(r2)
    assert r1 == r2


def test_entry_smoke(spark):
    import __spark_entry__ as e

    df = e.entry(spark)
    assert df.count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
