"""Stored tables: merges that leave other buckets alone, inserts through filters."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from tillcast.operators import bucketed as BK
from tillcast.operators import merges as M

DAY = dt.date(2024, 1, 1)
PRED = "model_id long, prediction_date date, item_name string, predicted_quantity int, actual_quantity int"


def files(path):
    held = json.loads((path / BK.MANIFEST).read_text())
    return {int(b): sorted(str(p) for f in fs for p in (path / f).glob("*.parquet")) for b, fs in held["folders"].items()}


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_a_merge_writes_only_its_buckets(spark, tmp_path):
    rows = [(m, DAY + dt.timedelta(days=k), item, k, None) for m in (1, 2) for k in range(30) for item in ("a", None)]
    old = spark.createDataFrame(rows, PRED)
    path = tmp_path / "predictions"
    table = BK.Table.create(old, str(path), M.PRED_KEY, buckets=16)
    before = files(path)
    new = spark.createDataFrame([(1, DAY, None, 77, None), (9, DAY, "z", 5, None)], PRED).drop("actual_quantity")
    table.merge(new, M.upsert_predictions)
    after = files(path)
    changed = {b for b in after if after[b] != before.get(b)}
    assert 1 <= len(changed) <= 2 and len(before) > 10
    assert rows_of(BK.Table(spark, str(path)).read()) == rows_of(M.upsert_predictions(old, new))


def test_a_merge_that_breaks_off_leaves_the_table(spark, tmp_path):
    old = spark.createDataFrame([(1, DAY, "a", 3, None)], PRED)
    table = BK.Table.create(old, str(tmp_path / "t"), M.PRED_KEY, buckets=4)
    with pytest.raises(Exception, match="lost"):
        table.merge(old.drop("actual_quantity"), lambda s, i: M.upsert_predictions(s, i).withColumn(
            "predicted_quantity", F.raise_error(F.lit("lost")).cast("int")))
    assert rows_of(BK.Table(spark, str(tmp_path / "t")).read()) == rows_of(old)


def test_insert_absent_is_exact(spark, tmp_path, monkeypatch):
    """Against an anti join, batch after batch, with filters that err often, grow full and are built anew."""
    monkeypatch.setattr(BK, "BITS", 3)
    schema = "integration_id long, external_id string, total double"
    batch = lambda lo, hi, tag: spark.createDataFrame(
        [(k % 3, f"o{k}" if k % 11 else None, float(k + tag)) for k in range(lo, hi)] + [(lo % 3, f"o{lo}", -1.0 * tag)], schema)
    first = lambda df: M.first_per_key(df, M.ORDER_KEY)
    start = first(batch(0, 50, 0))
    table = BK.Table.create(start, str(tmp_path / "orders"), M.ORDER_KEY, buckets=4, filtered=True)
    held = {(r.integration_id, r.external_id): r.total for r in start.collect()}
    for lo, hi, tag in ((30, 120, 1), (0, 60, 2), (100, 400, 3)):
        incoming = batch(lo, hi, tag)
        want = {}
        for r in incoming.collect():
            key = (r.integration_id, r.external_id)
            if key not in held:
                want[key] = min(want.get(key, r.total), r.total)
        got = table.insert_absent(incoming, first)
        assert {(r.integration_id, r.external_id): r.total for r in got.collect()} == want
        held |= want
    assert {(r.integration_id, r.external_id): r.total for r in BK.Table(spark, str(tmp_path / "orders")).read().collect()} == held
    assert table.insert_absent(batch(0, 400, 9), first).count() == 0


def test_filters_know_all_they_were_told():
    import numpy as np
    rng = np.random.default_rng(0)
    h = rng.integers(-2**63, 2**63 - 1, 20_000)
    bits = BK._empty(10_000)
    BK._set(bits, h[:10_000])
    assert BK._hit(bits, h[:10_000]).all() and BK._hit(bits, h[10_000:]).mean() < 0.02


def test_rows_are_written_once(spark, tmp_path):
    """Neither storing a table nor inserting into it leaves a scratch copy of its rows."""
    from pathlib import Path

    from tillcast.session import shared_dir

    scratch = Path(shared_dir(spark).removeprefix("file:"))
    copies = lambda: {p for name in ("table-*", "new-rows-*") for p in scratch.glob(name)}
    before = copies()
    rows = spark.createDataFrame([(1, f"o{k}", float(k)) for k in range(20)], "integration_id long, external_id string, total double")
    table = BK.Table.create(rows.where("total < 10"), str(tmp_path / "orders"), M.ORDER_KEY, buckets=4, filtered=True)
    added = table.insert_absent(rows, lambda df: M.first_per_key(df, M.ORDER_KEY))
    assert rows_of(added) == rows_of(rows.where("total >= 10")) and rows_of(table.read()) == rows_of(rows)
    assert scratch.is_dir() and copies() == before
