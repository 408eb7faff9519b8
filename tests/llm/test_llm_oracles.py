"""Every operator query against its SQL on the smallest tables."""

from __future__ import annotations

import pytest

from llm_helpers import SF
from tillcast.llm.registry import ORACLE, QUERIES
from tools.oracle_check import canon, duck_connect


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_matches_sql(spark, name):
    df = QUERIES[name](spark, SF)
    con = duck_connect(SF)
    rel = con.execute(ORACLE[name])
    columns = [d[0] for d in rel.description]
    assert canon(df.columns, [tuple(r) for r in df.collect()]) == canon(columns, rel.fetchall())
    con.close()


def test_all_are_registered():
    import __spark_entry__ as e
    names = e.queries()
    assert {f"op{k}" for k in range(1, 14)} == {n.split("_")[0] for n in names if n.startswith("op")}
    assert "pipeline" in names
