"""Positions by range-partitioned sort against plain sorting."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from tillcast.operators.ranking import dense_codes, with_position


def test_positions_with_hot_and_null_groups(spark):
    rng = random.Random(3)
    rows = [(rng.choice(["hot"] * 6 + ["a", None]), rng.choice([None, *range(40)]), k) for k in range(900)]
    df = spark.createDataFrame(rows, "g string, v int, pos_in int")
    got = with_position(df, ["g"], [F.col("v").desc_nulls_last(), "pos_in"], "pos", "n").collect()
    for g in ("hot", "a", None):
        want = sorted((r for r in rows if r[0] == g), key=lambda r: (r[1] is None, -(r[1] or 0), r[2]))
        mine = sorted((r for r in got if r.g == g), key=lambda r: r.pos)
        assert [(r.g, r.v, r.pos_in) for r in mine] == want
        assert [r.pos for r in mine] == list(range(len(want))) and {r.n for r in mine} == {len(want)}


def test_equal_rows_and_no_group(spark):
    df = spark.createDataFrame([("x",)] * 300 + [("y",)], "v string").repartition(5)
    got = with_position(df, [], ["v"], "pos").collect()
    assert sorted(r.pos for r in got) == list(range(301))
    assert [r.pos for r in got if r.v == "y"] == [300]
    assert with_position(df.limit(0), [], ["v"], "pos").count() == 0


def test_dense_codes(spark):
    df = spark.createDataFrame([("b", "x"), ("b", "x"), ("b", None), ("b", "A"), ("c", "q")], "g string, v string")
    assert sorted(map(tuple, dense_codes(df, ["g"], "v", "code").collect()), key=str) == sorted(
        [("b", None, 0), ("b", "A", 1), ("b", "x", 2), ("c", "q", 0)], key=str)


def test_no_unbounded_window(spark):
    """The only window runs over one row per (group, partition)."""
    df = spark.range(1000).withColumn("g", F.lit(1))
    plan = with_position(df, ["g"], ["id"])._jdf.queryExecution().optimizedPlan().toString()
    window = plan[plan.index("Window"):]
    assert "Aggregate" in window.splitlines()[1] or "Aggregate" in window.splitlines()[2]
