"""Hand-made edge frames for what the driver tables cannot show (FIXTURES.md 6)."""

from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tillcast.functions import blocks as B
from tillcast.functions import dates as D
from tillcast.functions import scalars as X
from tillcast.operators import calendar_joins as J
from tillcast.operators import items as I
from tillcast.operators import merges as M
from tillcast.operators import quality as Q
from tillcast.operators import reports as R
from tillcast.operators import series as S
from tillcast.sources import calendars as C
from tillcast.sources import files as FL
from tillcast.sources import providers as P
from tillcast.util import null_nonfinite


def d(s):
    return dt.date.fromisoformat(s)


def test_lag_features_nulls_single_row_and_fill_order(spark):
    rows = [("a", d("2024-01-01"), 2.0), ("a", d("2024-01-02"), None), ("a", d("2024-01-03"), 6.0),
            ("b", d("2024-01-01"), 4.0)]
    df = spark.createDataFrame(rows, "item_name string, date date, quantity double")
    out = {(r.item_name, r.date): r for r in S.lag_features(df).collect()}
    mean = (2 + 6 + 4) / 3
    first = out[("a", d("2024-01-01"))]
    # nothing before the first row: every column falls back to the global mean
    assert first.lag_1 == pytest.approx(mean) and first.rolling_7_std == pytest.approx(mean)
    second = out[("a", d("2024-01-02"))]
    # one previous row: std is NULL -> rolling_7_avg (Q4), lag_7 missing -> rolling_7_avg
    assert second.lag_1 == 2.0 and second.rolling_7_avg == 2.0 and second.rolling_7_std == 2.0
    assert second.lag_7 == 2.0
    third = out[("a", d("2024-01-03"))]
    # previous value is NULL: lag_1 falls back to the rolling mean of non-null rows
    assert third.lag_1 == 2.0
    assert out[("b", d("2024-01-01"))].lag_1 == pytest.approx(mean)


def test_daily_sales_drops_null_keys_and_sums_all_null_to_zero(spark):
    rows = [("a", d("2024-01-01"), None), (None, d("2024-01-01"), 3.0), ("a", None, 1.0)]
    df = spark.createDataFrame(rows, "item_name string, date date, quantity double")
    out = S.daily_item_sales(df).collect()
    assert [(r.item_name, r.quantity) for r in out] == [("a", 0.0)]


@pytest.mark.parametrize("t,block", [("10:59", "morning"), ("11:00", "afternoon"), ("23:58", "night"),
                                     ("23:59", "other"), ("00:00", "other"), ("06:00:30", "morning"),
                                     ("25:00", "other"), (None, "other")])
def test_time_block_edges(spark, t, block):
    df = spark.createDataFrame([(t,)], "time string")
    assert df.select(B.time_block("time")).first()[0] == block


def test_parse_dates_day_first_and_bad(spark):
    rows = [("2024-03-04",), ("03/04/2024",), ("31/01/2024",), ("13/31/2024",), ("nope",), ("2024-02-29",)]
    df = spark.createDataFrame(rows, "t string")
    got = [r[0] for r in df.select(D.parse_date("t", day_first=True)).collect()]
    assert got == [d("2024-03-04"), d("2024-04-03"), d("2024-01-31"), None, None, d("2024-02-29")]
    got_mf = [r[0] for r in df.select(D.parse_date("t", day_first=False)).collect()]
    assert got_mf[1] == d("2024-03-04") and got_mf[2] == d("2024-01-31")
    assert [r[0] for r in df.select(D.safe_parse_date("t")).collect()][4] is None


def test_iso_week_and_weekday(spark):
    df = spark.createDataFrame([(d("2024-12-30"),), (d("2024-02-29"),)], "date date")
    r = df.select(*[v.alias(k) for k, v in D.date_parts("date").items()]).collect()
    assert r[0].week_of_year == 1 and r[0].day_of_week == 0
    assert r[1].day_of_month == 29 and r[1].is_weekend == 0


def test_asof_distances_and_caps(spark):
    hol = spark.createDataFrame([(d("2024-07-04"),), (d("2024-12-25"),)], "date date")
    days = spark.createDataFrame([(d("2024-07-04"),), (d("2024-06-01"),), (d("2024-07-10"),),
                                  (d("2024-12-31"),), (d("2024-01-01"),)], "date date")
    out = J.days_since_last(J.days_to_next(days, hol, "to", 30), hol, "since", 30)
    got = {r.date: (r.to, r.since) for r in out.collect()}
    assert got[d("2024-07-04")] == (0, 0)
    assert got[d("2024-06-01")] == (30, 30)      # 33 days away -> capped; no earlier holiday
    assert got[d("2024-07-10")] == (30, 6)
    assert got[d("2024-12-31")] == (30, 6)       # after the last holiday
    assert got[d("2024-01-01")] == (30, 30)      # before the first


def test_school_break_winter_edges(spark):
    years = spark.createDataFrame([(2023,), (2024,)], "year int")
    school = C.school_calendar(years)
    days = spark.createDataFrame([(d(x),) for x in ("2023-12-31", "2024-01-05", "2024-01-06", "2024-12-17")],
                                 "date date")
    got = {r.date: r.is_school_break for r in J.school_break_flag(days, school).collect()}
    assert got == {d("2023-12-31"): 1, d("2024-01-05"): 1, d("2024-01-06"): 0, d("2024-12-17"): 0}
    sess = {r.date: r.in_session for r in J.in_session(days, school).collect()}
    # Jan 5 2024 is inside the 2023 calendar's winter break, not the 2024 one
    assert sess[d("2024-01-05")] is True and sess[d("2023-12-31")] is False


def test_holiday_rules(spark):
    years = spark.createDataFrame([(2024,)], "year int")
    got = {r.name: r.date for r in C.holiday_calendar(years).collect()}
    assert got["Thanksgiving Day"] == d("2024-11-28")
    assert got["Memorial Day"] == d("2024-05-27")
    assert got["Labor Day"] == d("2024-09-02")
    assert got["Martin Luther King, Jr. Day"] == d("2024-01-15")


def test_paydays_friday_on_first(spark):
    years = spark.createDataFrame([(2024,)], "year int")
    pays = C.payday_calendar(years).where(F.col("date") == F.lit("2024-03-01").cast("date")).collect()
    assert sorted(r.type for r in pays) == ["monthly_1st", "weekly_friday"]


def test_primary_size_tie_and_size_expansion(spark):
    sales = spark.createDataFrame(
        [(0, d("2024-01-01"), "pizza", 1.0, "L", "Pizza", 12.0, "o1"),
         (0, d("2024-01-01"), "pizza", 1.0, "M", "Pizza", 10.0, "o2"),
         (0, d("2024-01-02"), "soda", 2.0, None, "Drink", 0.0, "o3")],
        "business_id long, date date, item_name string, quantity double, size string, type string, "
        "unit_price double, order_id string")
    assert {r.item_name: r.primary_size for r in I.primary_size(sales).collect()} == {"pizza": "L"}
    preds = spark.createDataFrame([(0, d("2024-02-01"), "pizza", 0), (0, d("2024-02-01"), "soda", 3)],
                                  "business_id long, prediction_date date, item_name string, "
                                  "predicted_quantity int")
    out = I.expand_by_size(preds, I.item_profile(sales), I.size_profile(sales)).collect()
    pizza = sorted((r.size, r.predicted_quantity, r.unit_price) for r in out if r.item_name == "pizza")
    assert pizza == [("L", 1, 12.0), ("M", 1, 10.0)]      # base 0 -> each size at least 1
    soda = [r for r in out if r.item_name == "soda"][0]
    assert soda.size is None and soda.predicted_quantity == 3


def test_similar_items_both_directions(spark):
    known = spark.createDataFrame([(0, "Pepperoni Pizza", "Pizza"), (0, "Cola", "Drink")],
                                  "business_id long, item_name string, category string")
    names = spark.createDataFrame([(0, "pepperoni"), (0, "Large Cola Zero"), (0, "Salad"), (0, "")],
                                  "business_id long, name string")
    got = {r.name: r.similar_item for r in I.similar_items(names, known).collect()}
    assert got == {"pepperoni": "Pepperoni Pizza", "Large Cola Zero": "Cola"}


def test_similar_items_against_all_pairs(spark):
    import random
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abÄ ") for _ in range(rng.randrange(0, 7)))
    names = [(rng.randrange(2), word()) for _ in range(80)]
    known = [(rng.randrange(2), word(), rng.choice("xy")) for _ in range(80)] + [(0, "", "x"), (1, None, "y")]
    got = {(r.business_id, r.name): (r.similar_item, r.similar_category) for r in I.similar_items(
        spark.createDataFrame(names, "business_id int, name string"),
        spark.createDataFrame(known, "business_id int, item_name string, category string")).collect()}
    want = {}
    for b, n in names:
        fits = [(abs(len(k) - len(n)), c, k) for kb, k, c in known if kb == b and n and k and (n.lower() in k.lower() or k.lower() in n.lower())]
        if fits:
            want[b, n] = min(fits)[:0:-1]
    assert got == want and len(want) > 20
    plan = I.similar_items(spark.createDataFrame(names, "business_id int, name string"),
                           spark.createDataFrame(known, "business_id int, item_name string, category string"))._jdf.queryExecution().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_merges_with_null_keys(spark):
    key = "model_id long, prediction_date date, item_name string"
    day = d("2024-01-01")
    old = spark.createDataFrame([(1, day, None, 5, 4), (1, day, "a", 6, None)], f"{key}, predicted_quantity int, actual_quantity int")
    new = spark.createDataFrame([(1, day, None, 9), (None, day, "a", 7)], f"{key}, predicted_quantity int")
    got = sorted(map(tuple, M.upsert_predictions(old, new).collect()), key=str)
    assert got == sorted([(1, day, None, 9, 4), (1, day, "a", 6, None), (None, day, "a", 7, None)], key=str)
    rows = [("a", 1, "x"), ("a", 2, "y"), (None, 3, "p"), (None, 7, "q"), ("b", None, "z"), (None, 7, "r")]
    got = M.keep_latest(spark.createDataFrame(rows, "k string, id int, v string"), ["k"]).collect()
    assert sorted(map(tuple, got), key=str) == sorted([("a", 2, "y"), (None, 7, "r"), ("b", None, "z")], key=str)


def test_accuracy_skips_nonpositive_actuals(spark):
    rows = [(1, 0, d("2024-01-01"), "a", 5, 0), (1, 0, d("2024-01-01"), "b", 3, -1),
            (1, 0, d("2024-01-02"), "a", 5, 10)]
    df = spark.createDataFrame(rows, "model_id long, business_id long, prediction_date date, item_name string, "
                                     "predicted_quantity int, actual_quantity int")
    r = R.accuracy(df).first()
    assert r.mape == pytest.approx(50.0) and r.accuracy == pytest.approx(50.0)
    assert r.mae == pytest.approx((5 + 4 + 5) / 3) and r.days_tracked == 2
    only_zero = R.accuracy(df.where("actual_quantity = 0")).first()
    assert only_zero.mape == 0.0 and only_zero.accuracy == 100.0


def test_outliers_need_four_rows_and_variation(spark):
    base = [("x", "Monday", "all_day", "normal", False, False, None, None, False)]
    rows = []
    for i, q in enumerate([1, 1, 1, 1, 1, 1, 1, 1, 1, 40]):
        rows.append((0, d("2024-01-01") + dt.timedelta(days=7 * i), q * 1.0, *base[0]))
    rows += [(0, d("2024-01-02"), 5.0, "y", "Tuesday", "all_day", "normal", False, False, None, None, False)] * 3
    schema = ("business_id long, date date, quantity double, item_name string, day_of_week string, "
              "time_block string, weather_type string, is_holiday boolean, has_sports boolean, "
              "holiday_name string, sports_event string, is_payday boolean")
    out = Q.grouped_outliers(spark.createDataFrame(rows, schema)).collect()
    assert [(r.item, r.quantity) for r in out] == [("x", 40)]


def test_orders_without_items_and_square_strings(spark):
    docs = spark.createDataFrame([
        ('{"id":"A","created_at":"2024-01-01T10:00:00Z","state":"COMPLETED","total_money":{"amount":1250},'
         '"line_items":[{"name":"Tea","quantity":"2","base_price_money":{"amount":300},"total_money":{"amount":600}},'
         '{"quantity":"1"}]}',),
        ('{"id":"B","created_at":"2024-01-02T10:00:00Z","state":"COMPLETED","total_money":{"amount":999}}',),
        ('{"id":"C","created_at":"2024-01-02T10:00:00Z","state":"OPEN"}',)], "payload string")
    orders = P.flatten_square_orders(docs)
    assert orders.count() == 2
    sales = {(r.order_id, r.item_name): (r.quantity, r.total_price) for r in P.orders_to_sales(orders).collect()}
    assert sales[("A", "Tea")] == (2.0, 6.0)
    assert sales[("A", "Unknown")] == (1.0, 0.0)
    assert sales[("B", "All Items")] == (1.0, 9.99)


def test_keep_latest_and_upsert(spark):
    df = spark.createDataFrame([("k", 1, "old"), ("k", 3, "new"), ("j", 2, "only")], "key string, id int, v string")
    assert {r.key: r.v for r in M.keep_latest(df, ["key"], "id").collect()} == {"k": "new", "j": "only"}
    old = spark.createDataFrame([(1, d("2024-01-01"), "a", 5, 7)],
                                "model_id long, prediction_date date, item_name string, predicted_quantity int, "
                                "actual_quantity int")
    new = spark.createDataFrame([(1, d("2024-01-01"), "a", 9), (1, d("2024-01-02"), "a", 4)],
                                "model_id long, prediction_date date, item_name string, predicted_quantity int")
    got = {r.prediction_date: (r.predicted_quantity, r.actual_quantity)
           for r in M.upsert_predictions(old, new).collect()}
    assert got == {d("2024-01-01"): (9, 7), d("2024-01-02"): (4, None)}


def test_scalar_helpers(spark):
    df = spark.createDataFrame([(2.5, 12.5, 1.0, 0.0, "rolling_7_avg")], "a double, m double, s double, z double, n string")
    r = df.select(X.round_prediction("a").alias("p"), X.expected_range("m", "s").alias("er"),
                  X.weather_description(F.lit(99)).alias("w"), X.weather_description(F.lit(7)).alias("u"),
                  X.display_name("n").alias("dn"), X.display_name(F.lit("is_payday")).alias("dp")).first()
    assert r.p == 2 and r.er == "10 - 14" and r.w == "Thunderstorm with heavy hail" and r.u == "Unknown"
    assert r.dn == "Rolling 7 Avg" and r.dp == "Payday"


def test_null_nonfinite(spark):
    df = spark.createDataFrame([(float("nan"), [1.0, float("inf")])], "x double, xs array<double>")
    r = null_nonfinite(df).first()
    assert r.x is None and r.xs == [1.0, None]


def test_top_k_window_group_limit_plan(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    plan = R.top_k(df, ["g"], [F.col("v").desc()], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_header_mapping_rules(spark):
    from tillcast.sources import files as FL

    df = spark.createDataFrame([("1", "2", "3", "4", "5")], "a string, b string, c string, d string, e string")
    df = df.toDF(" Order Date", "Order_Time", "hour", "Qty", "QTY")
    n = FL.normalize_headers(df)
    assert n.columns == ["order_date", "order_time", "hour", "qty", "qty_2"]
    assert FL.apply_column_mapping(n).columns == ["date", "time", "hour", "quantity", "qty_2"]
    # a column already carrying the standard name wins over aliases
    assert FL.resolve_mapping(["hour", "time"]) == {}


def test_catalogue_mapping(spark):
    from tillcast.sources import files as FL

    cat = spark.createDataFrame([("f1", "qty"), ("f1", "product"), ("f1", "weird"), ("f2", "date")],
                                "file string, column string")
    al = FL.alias_table(spark)
    got = {(r.file, r.column): r.standard for r in FL.suggest_mapping(cat, al).collect()}
    assert got == {("f1", "qty"): "quantity", ("f1", "product"): "item_name", ("f2", "date"): "date"}
    assert [r.column for r in FL.unmapped_theirs(cat, al).collect()] == ["weird"]
    ours = {r.standard for r in FL.unmapped_ours(cat, al).where("file = 'f2'").collect()}
    assert "date" not in ours and "quantity" in ours and len(ours) == len(FL.STANDARD_COLUMNS) - 1
    rel = {(r.file, r.alias) for r in FL.relevant_mapping(cat, al).collect()}
    assert ("f1", "qty") in rel and ("f1", "weird") not in rel


def test_dataset_level_date_order(spark):
    from tillcast.sources import files as FL

    df = spark.createDataFrame([("03/04/2024",), ("12/31/2024",), ("bad",)], "date string")
    good, bad = FL.parse_sales_dates(df, day_first=True)
    assert sorted(r.date for r in good.collect()) == [d("2024-03-04"), d("2024-12-31")]
    assert bad.count() == 1


def test_business_type_line_measures_football(spark):
    df = spark.createDataFrame([("retail", 12.5, 7.25, 3, d("2024-09-08"), False),
                                ("bakery", 1.0, 0.5, 1, d("2024-02-11"), True)],
                               "t string, p double, c double, q int, day date, hol boolean")
    rows = df.select(X.valid_business_type("t").alias("ok"),
                     *[v.alias(k) for k, v in X.line_measures("p", "c", "q").items()],
                     D.event_label("hol", D.football_day("day")).alias("label")).collect()
    assert rows[0].ok is True and rows[1].ok is False
    assert (rows[0].line_revenue, rows[0].line_cost, rows[0].gross_margin) == (37.5, 21.75, 15.75)
    assert rows[0].label == "Football" and rows[1].label == "Holiday"


def test_stream_window_drops_and_counts_late_rows(spark):
    import datetime as dtm

    from tillcast.session import scratch_path
    from tillcast.streaming import orders as X

    schema = "ts timestamp_ntz, item string, v double"
    landing = scratch_path(spark, "late-landing")
    t0 = dtm.datetime(2024, 1, 1, 12)
    first = [(t0 + dtm.timedelta(days=k), "a", 1.0) for k in range(6)]
    spark.createDataFrame(first, schema).write.parquet(landing + "/b1")
    stream = X.order_feed(spark, landing + "/*", spark.createDataFrame([], schema).schema,
                          max_files_per_trigger=1)
    agg = X.daily_item_stream(stream, "ts", "item", "v", "1 day")
    sink, ck = scratch_path(spark, "late-sink"), scratch_path(spark, "late-ckpt")
    X.run_available_now(agg, sink, ck)
    # a second run sees one on-time row and one row far behind the watermark
    late = [(t0 + dtm.timedelta(days=6), "a", 1.0), (t0 - dtm.timedelta(days=10), "a", 5.0)]
    spark.createDataFrame(late, schema).write.parquet(landing + "/b2")
    q = X.run_available_now(agg, sink, ck)
    out = spark.read.parquet(sink)
    assert out.where(F.col("date") == F.lit("2023-12-22").cast("date")).count() == 0
    assert X.late_rows(q) >= 1
    # closed windows are emitted exactly once
    assert out.groupBy("date").count().where("count > 1").count() == 0


def test_forecast_lags_calendar_lookups_and_fallbacks(spark):
    from tillcast.plans import forecast as FC

    daily = spark.createDataFrame(
        [(0, d("2024-03-01"), "a", 4.0), (0, d("2024-03-05"), "a", 8.0), (0, d("2024-01-01"), "b", 10.0)],
        "business_id long, date date, item_name string, quantity double")
    grid = spark.createDataFrame(
        [(0, d("2024-03-06"), "a"), (0, d("2024-03-12"), "a"), (0, d("2024-03-06"), "b")],
        "business_id long, date date, item_name string")
    fb = spark.createDataFrame([(0, "b", 3.0)], "business_id long, item_name string, fallback_qty double")
    got = {(r.item_name, r.date): r for r in FC.forecast_lags(grid, daily, fb).collect()}
    a6 = got[("a", d("2024-03-06"))]
    assert a6.lag_1 == 8.0                      # value on d-1
    assert a6.lag_7 == 8.0                      # nothing on d-7 -> lag_1
    assert a6.rolling_7_avg == 6.0              # 03-01 and 03-05 inside [d-7, d)
    assert a6.rolling_7_std == pytest.approx(2 ** 0.5 * 2)
    a12 = got[("a", d("2024-03-12"))]
    assert a12.lag_1 == 8.0                     # no d-1: most recent value
    assert a12.rolling_7_avg == 8.0             # only 03-05 in the window
    assert a12.rolling_7_std == pytest.approx(1.6)   # one row: 0.2 x mean
    b6 = got[("b", d("2024-03-06"))]            # b's only sale is older than the 60-day history
    assert (b6.lag_1, b6.rolling_30_avg) == (3.0, 3.0)
    assert b6.rolling_7_std == pytest.approx(0.6)


def test_merges_last_entry_wins_and_null_overwrites(spark):
    key = "model_id long, prediction_date date, item_name string"
    old = spark.createDataFrame([(1, d("2024-01-01"), "a", 5, 4)], f"{key}, predicted_quantity int, actual_quantity int")
    new = spark.createDataFrame([(1, d("2024-01-01"), "a", 9, 0), (1, d("2024-01-01"), "a", 7, 1)], f"{key}, predicted_quantity int, seq int")
    assert [tuple(r)[3:] for r in M.upsert_predictions(old, new, "seq").collect()] == [(7, 4)]
    models = spark.createDataFrame([(1, 1, d("2024-01-02"), True)], "model_id long, business_id long, created_at date, is_active boolean")
    entries = spark.createDataFrame([(1, d("2024-01-01"), "a", 90, 0), (1, d("2024-01-01"), "a", 2, 1)],
                                    "business_id long, date date, item_name string, actual_quantity int, entry_seq int")
    assert [r.actual_quantity for r in M.save_actuals(old, models, entries).collect()] == [2]
    cols = "integration_id long, external_id string, business_id long, name string, category string, sku string, price double"
    stored = spark.createDataFrame([(1, "p", 1, "old", "cat", "sku", 2.0, True, None), (1, "q", 1, None, None, None, None, True, None)],
                                   f"{cols}, is_active boolean, updated_at timestamp")
    sent = spark.createDataFrame([(1, "p", 1, "first", "cat", "s1", 3.0, 0), (1, "p", 1, "last", None, None, None, 1), (1, "q", 1, "named", None, None, 1.0, 0),
                                  (1, "r", 1, "new", None, None, None, 0)], f"{cols}, seq int").withColumn("synced_at", F.lit(None).cast("timestamp"))
    got = {r.external_id: (r.name, r.category, r.sku, r.price, r.is_new) for r in M.upsert_products(stored, sent, seq_col="seq").collect()}
    assert got == {"p": ("last", None, None, None, False), "q": ("named", None, None, 1.0, False), "r": ("new", None, None, None, True)}


def test_listing_limit_is_refused(spark):
    df = spark.range(3).withColumnRenamed("id", "ts")
    with pytest.raises(ValueError):
        M.newest(df, "ts", 101)
    assert M.newest(df, "ts", 2).count() == 2


def test_csv_quotes_line_breaks_and_rejects(spark, tmp_path):
    (tmp_path / "a.csv").write_text('item,note,qty\n"12"" pizza","line1\nline2",2\n"x, y", z ,3\ntoo,many,fields,here\n')
    good, bad = FL.read_csv_checked(spark, str(tmp_path / "a.csv"))
    assert [tuple(r) for r in good.collect()] == [('12" pizza', "line1\nline2", "2"), ("x, y", " z ", "3")]
    assert good.count() == 2 and bad.count() == 1 and bad.first()._corrupt_record == "too,many,fields,here"


def test_csv_records_from_byte_ranges(spark, tmp_path):
    """However a file is cut, the records are those of Python's own reader."""
    import csv
    import random

    from tillcast.sources import records as RC
    rng = random.Random(9)
    piece = lambda: rng.choice(['a', 'bc', '"', ',', '\n', '\n\n', 'ü', ' ', '5" pipe', '""', '\r\n'])
    want = [(str(k), "".join(piece() for _ in range(rng.randrange(0, 30))) or "x", "z" * rng.randrange(1, 20)) for k in range(300)]
    for name, rows in (("a", want[:200]), ("b", want[200:])):
        with open(tmp_path / f"{name} 1.csv", "w", newline="", encoding="utf-8") as f:
            w = csv.writer(f, lineterminator="\n" if name == "a" else "\r\n")
            w.writerow(["id", "te\nxt", "z"])
            w.writerows(rows)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    try:
        for size in (97, 1000, 10**7):
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
            good, bad = FL.read_csv_checked(spark, str(tmp_path))
            assert good.columns == ["id", "te\nxt", "z"] and bad.count() == 0
            assert sorted(map(tuple, good.collect())) == sorted(want)
            files = RC.layouts(spark, str(tmp_path))[0][1]
            assert len(files) == 2 and (RC.records(spark, files).rdd.getNumPartitions() > 20) == (size < 1000)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_quotes_count_where_a_field_begins():
    from tillcast.sources.records import ends_inside
    assert not ends_inside('5" pipe,a"b,c', False) and ends_inside('a,"b', False) and not ends_inside('a,"b ""c"" d",e', False)
    assert ends_inside('a,"b"",c', False) and not ends_inside('x",y', True) and ends_inside('x"",y', True) and ends_inside('x","y', True)


def test_uploads_are_read_by_their_own_header(spark, tmp_path):
    (tmp_path / "1.csv").write_text("Date,Product,Qty\n2024-01-02,tea,3\n")
    (tmp_path / "2.csv").write_text("Qty,Date,Product\n7,2024-01-03,cake\n")
    (tmp_path / "3.csv").write_text("order date,ITEM,notes\n2024-01-04,pie,n\n2024-01-05,pie,n,surplus\n")
    (tmp_path / "4.csv").write_text("")
    sales, rejects = FL.load_sales(spark, str(tmp_path))
    assert sorted((r.date, r.item_name, r.quantity, r.notes) for r in sales.collect()) == [
        (d("2024-01-02"), "tea", 3.0, None), (d("2024-01-03"), "cake", 7.0, None), (d("2024-01-04"), "pie", 1.0, "n")]
    assert rejects.count() == 0 and FL.read_csv_checked(spark, str(tmp_path))[1].count() == 1


def test_auto_compare_reads_only_what_it_touches(spark, tmp_path):
    """Entries and predictions of other months can be unreadable: a batch does not open them. A replayed batch changes nothing."""
    from tillcast.streaming import orders as X
    schema = "business_id long, date date, item_name string, quantity double"
    models = spark.createDataFrame([(1, 1)], "model_id long, business_id long")
    X.write_version(spark.createDataFrame([(1, d("2024-01-01"), "a", 5, None), (1, d("2024-03-01"), "a", 5, None)],
                                          "model_id long, prediction_date date, item_name string, predicted_quantity int, actual_quantity int"),
                    f"{tmp_path}/p", 0)

    def run(row, ck):
        spark.createDataFrame([row], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        feed = X.order_feed(spark, f"{tmp_path}/in", spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
        X.auto_compare_stream(feed, models, f"{tmp_path}/p", f"{tmp_path}/ledger", f"{tmp_path}/log", f"{tmp_path}/{ck}/ck")

    run((1, d("2024-01-01"), "a", 5.0), "one")
    for top in ("p/month=202401", "ledger/month=202401"):
        for f in (tmp_path / top).rglob("part-*"):
            f.write_bytes(b"lost")
        for f in (tmp_path / top).rglob(".part-*"):
            f.write_bytes(b"")
    run((1, d("2024-03-01"), "a", 4.0), "one")
    march = X.current_predictions(spark, f"{tmp_path}/p", [202403])
    assert march.first().actual_quantity == 4
    X.auto_compare_stream(X.order_feed(spark, f"{tmp_path}/in", march.sparkSession.createDataFrame([], schema).schema).where(
        "date = '2024-03-01'"), models, f"{tmp_path}/p", f"{tmp_path}/ledger", f"{tmp_path}/log", f"{tmp_path}/two/ck")
    assert X.current_predictions(spark, f"{tmp_path}/p", [202403]).first().actual_quantity == 4  # its batch 0 replaces batch 0 of this run


def test_auto_compare_does_not_depend_on_batches_or_checkpoints(spark, tmp_path):
    """The same key in several batches adds up; a second checkpoint goes on from the newest version; a failure is logged whole."""
    from tillcast.streaming import orders as X
    schema = "business_id long, date date, item_name string, quantity double"
    models = spark.createDataFrame([(1, 1)], "model_id long, business_id long")
    X.write_version(spark.createDataFrame([(1, d("2024-01-01"), "a", 5, None), (1, d("2024-03-01"), "a", 5, None)],
                                          "model_id long, prediction_date date, item_name string, predicted_quantity int, actual_quantity int"),
                    f"{tmp_path}/p", 0)

    def run(rows, ck, models=models):
        for r in rows:
            spark.createDataFrame([r], schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in-{ck}")
        feed = X.order_feed(spark, f"{tmp_path}/in-{ck}", spark.createDataFrame([], schema).schema, max_files_per_trigger=1)
        X.auto_compare_stream(feed, models, f"{tmp_path}/p", f"{tmp_path}/ledger", f"{tmp_path}/log", f"{tmp_path}/{ck}")
        return {r.prediction_date: r.actual_quantity for r in X.current_predictions(spark, f"{tmp_path}/p").collect()}

    assert run([(1, d("2024-01-01"), "a", 5.0), (1, d("2024-01-01"), "a", 2.0)], "one") == {d("2024-01-01"): 7, d("2024-03-01"): None}
    assert run([(1, d("2024-03-01"), "a", 4.0), (1, d("2024-01-01"), "a", 1.0)], "two") == {d("2024-01-01"): 8, d("2024-03-01"): 4}
    log = spark.read.parquet(f"{tmp_path}/log")
    assert sorted(r.status for r in log.collect()) == ["completed"] * 4
    assert log.agg(F.sum("late_rows")).first()[0] == 1      # January's row came after March's
    with pytest.raises(Exception):
        run([(1, d("2024-03-01"), "a", 4.0)], "three", models.select("model_id"))
    failed = spark.read.parquet(f"{tmp_path}/log").where("status = 'failed'").first()
    assert failed is not None and len(failed.error) > 0


def test_shared_folder_is_required_on_a_cluster():
    from tillcast import session
    with pytest.raises(RuntimeError):
        session._require_local("spark://host:7077")
    with pytest.raises(RuntimeError):
        session._require_local("local-cluster[3,2,1024]")
    session._require_local("local[8]")


def test_codes_stay_when_a_new_item_joins(spark, tmp_path):
    """A saved model scores with the codes it was fitted on; items it has not seen borrow a similar item's or the best seller's."""
    from tillcast.plans import training as TR
    rows = [(1, d("2024-01-01") + dt.timedelta(days=k), item, q, item[0]) for k in range(60) for item, q in (("a tea", 9.0), ("c cake", 2.0))]
    sales = spark.createDataFrame(rows, "business_id long, date date, item_name string, quantity double, type string").withColumn("order_id", F.lit("o"))
    res = TR.train(TR.training_frame(sales, pooled=False), tune=False, params={"maxIter": 3, "maxDepth": 2}, n_folds=2, sales=sales)
    TR.save_model(res.artefact, f"{tmp_path}/m")
    art = TR.load_model(spark, f"{tmp_path}/m")
    assert {r.item_name: r.item_encoded for r in art.codes.collect()} == {"a tea": 0, "c cake": 1}
    wanted = spark.createDataFrame([(1, "a tea"), (1, "b new"), (1, "c cake"), (1, "c cake xl")], "business_id long, item_name string")
    codes = I.item_code_lookup(wanted.withColumnRenamed("item_name", "name"), art.codes, art.known, art.averages)
    assert {r.name: r.item_encoded for r in codes.collect()} == {"a tea": 0, "b new": 0, "c cake": 1, "c cake xl": 1}
    base = {(r.prediction_date, r.item_name): r.predicted_quantity for r in TR.forecast(art, days=3).collect()}
    more = {(r.prediction_date, r.item_name): r.predicted_quantity for r in TR.forecast(art, days=3, items=wanted).collect()}
    assert len(base) == 8 and len(more) == 16 and base.items() <= more.items()


def test_a_forecast_reads_the_written_tables_and_not_the_sales(spark, tmp_path):
    """The tables beside a model are written once: no branch of a forecast or of a save joins the sales again."""
    from tillcast.plans import training as TR
    rows = [(1, d("2024-01-01") + dt.timedelta(days=k), item, q, item[0], "s", 2.0) for k in range(60) for item, q in (("a tea", 9.0), ("c cake", 2.0))]
    spark.createDataFrame(rows, "business_id long, date date, item_name string, quantity double, type string, size string, unit_price double").withColumn(
        "order_id", F.lit("o")).write.parquet(f"{tmp_path}/sales")
    sales = spark.read.parquet(f"{tmp_path}/sales")
    res = TR.train(TR.training_frame(sales, pooled=False), tune=False, params={"maxIter": 2, "maxDepth": 2}, n_folds=2, sales=sales)
    art = res.artefact
    assert art is res.artefact
    out = TR.forecast(art, days=2, items=sales.select("business_id", "item_name"))
    for df in (out, art.metadata, art.known, art.category_avg, art.codes, art.averages, art.history):
        assert df.count() > 0 and not any(f"{tmp_path}/sales" in f for f in df.inputFiles())
    assert {(r.item_name, r.category, r.primary_size, r.unit_price) for r in art.metadata.collect()} == {
        ("a tea", "a", "s", 2.0), ("c cake", "c", "s", 2.0)}


def test_each_date_text_and_record_is_read_once(spark, tmp_path):
    """Dates are read once a distinct text; a record is parsed once, and files without open ranges are read once."""
    (tmp_path / "a.csv").write_text("Day,Product\n13/01/2024,tea\n13/01/2024,\"a\nb\"\n,none\nsoon,late\n02/01/2024,tea,more\n\n02/01/2024,cake\n")
    good, bad = FL.load_sales(spark, str(tmp_path / "a.csv"))
    plan = good._jdf.queryExecution().executedPlan().toString()
    assert "gettimestamp" not in plan.lower() and plan.count("FileScan text") == 1 and plan.count("from_csv") <= 2, plan
    assert sorted((str(r.date), r.item_name) for r in good.collect()) == [
        ("2024-01-02", "cake"), ("2024-01-13", "a\nb"), ("2024-01-13", "tea")]
    assert sorted((r.date or "", r.item_name) for r in bad.collect()) == [("", "none"), ("soon", "late")]


def test_large_uploads_are_several_files(spark, tmp_path, monkeypatch):
    """No task writes more than a file's worth of the texts; every file is still read by more than one task."""
    from tillcast.registry import ingest
    monkeypatch.setattr(ingest, "FILE_BYTES", 20_000)
    docs = [(k, f'say "{k}",\n' * 100) for k in range(60)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    files = []
    write = ingest.P.write_sales_csv
    monkeypatch.setattr(ingest.P, "write_sales_csv", lambda df, path: (write(df, path), files.extend(spark.read.text(path).inputFiles())))
    out = ingest.one_large_file(spark, str(tmp_path))
    assert sorted((r.doc_id, r.text) for r in out.collect()) == docs and out.where("by_many_tasks").count() == 60
    assert len(files) > 2


def test_spread_parts_are_not_broadcast_to_the_sales(spark, tmp_path):
    """A part table that is small on disk is large once broadcast."""
    from tillcast.sources import tables as T
    for name, ddl, rows in (
            ("region", "r_regionkey int", [(0,)]), ("nation", "n_nationkey int, n_regionkey int", [(0, 0)]),
            ("supplier", "s_suppkey long, s_nationkey int", [(1, 0)]),
            ("part", "p_partkey long, p_brand string, p_type string, p_size int, p_retailprice double", [(1, "b", "t", 1, 2.0)]),
            ("lineitem", "l_orderkey long, l_partkey long, l_suppkey long, l_quantity double, l_extendedprice double, l_shipdate timestamp",
             [(1, 1, 1, 2.0, 3.0, dt.datetime(2024, 1, 1))])):
        spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{name}.parquet")
    plan = T.sales(spark, str(tmp_path), spread_parts=True)._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [l_partkey" in plan
    assert T.sales(spark, str(tmp_path), spread_parts=True).collect() == T.sales(spark, str(tmp_path)).collect()


def test_search_candidates_are_distinct_and_empty_folds_do_not_win(spark):
    from tillcast.plans import training as TR
    grid = {"maxDepth": [1, 2], "maxIter": [1, 2, 3]}
    cands = TR.sample_candidates(grid, 20)
    assert len(cands) == 6 and len({str(c) for c in cands}) == 6
    assert TR.sample_candidates(TR.SEARCH_GRID, 5) == TR.sample_candidates(TR.SEARCH_GRID, 5)


def test_forecast_lags_need_few_exchanges(spark):
    from tillcast.plans import forecast as FC
    daily = spark.createDataFrame([(1, d("2024-03-01"), "a", 2.0)], "business_id long, date date, item_name string, quantity double")
    grid = FC.forecast_grid(daily, 3).withColumnRenamed("prediction_date", "date")
    plan = FC.forecast_lags(grid, daily)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Generate explode") <= 4  # the grid's own and one history expansion


def test_prices_below_a_cent_count(spark):
    rows = [(1, d("2024-01-01"), "a", q, "s", 0.004, "t", f"o{k}") for k, q in enumerate((1.0, 2.0))]
    sales = spark.createDataFrame(rows, "business_id long, date date, item_name string, quantity double, size string, unit_price double, type string, order_id string")
    pred = spark.createDataFrame([(1, "a", 10)], "business_id long, item_name string, predicted_quantity int")
    r = I.expand_by_size(pred, I.item_profile(sales), I.size_profile(sales)).first()
    assert r.unit_price == 0.0 and r.predicted_revenue == 0.04
    one = spark.createDataFrame([(1,)], "k int").select(*[
        I.money(F.lit(t).cast("decimal(28,6)"), F.lit(n)).alias(f"c{i}")
        for i, (t, n) in enumerate((("0.05", 2), ("0.03", 2), ("3.044999", 3), ("-0.05", 2)))]).first()
    assert tuple(one) == (0.02, 0.02, 1.01, -0.02)


def test_profiles_hash_aggregate_raw_rows(spark):
    sales = spark.createDataFrame([], "business_id long, date date, item_name string, type string, order_id string, size string, quantity double, unit_price double, time string")
    for df in (I.hourly_patterns(sales), I.item_size_stats(sales)):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "SortAggregate" not in plan and "Expand" not in plan
    raw = I.item_category(sales)._jdf.queryExecution().sparkPlan().toString()
    assert raw.count("SortAggregate") <= 2      # the one day's pick, partial and final


def test_small_search_and_training_job(spark):
    """The whole job on a small grid: search, evaluation, refit, artefact."""
    from tillcast.plans import training as TR
    rows = [(1, d("2024-01-01") + dt.timedelta(days=k), item, q + k % 7) for k in range(80) for item, q in (("a", 9.0), ("b", 2.0))]
    sales = spark.createDataFrame(rows, "business_id long, date date, item_name string, quantity double")
    frame = TR.training_frame(sales, pooled=False)
    names = TR.model_features(frame)
    res = TR.random_search(TR.prepare(frame, names), names, n_iter=3, n_folds=2, grid={"maxDepth": [1, 2], "maxIter": [1, 2]})
    assert len(res.candidates) == 3 and res.best_params in [c for c, _ in res.candidates] and len(res.fold_maes) == 2
    assert min(s for _, s in res.candidates) == pytest.approx(sum(res.fold_maes) / 2)
