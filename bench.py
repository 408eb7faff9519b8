"""Benchmark: run the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (every row is produced,
nothing is collected to the driver). Prints ONE JSON line:
{"metric": ..., "value": total_seconds, "unit": "sec", "queries": {...}, "sf": ...}

Set BENCH_ALL=1 to time every registered query instead of the headline set.
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tillcast.registry import load_all  # noqa: E402
from tillcast.session import get_spark  # noqa: E402

# The end-to-end operators of the reference's main jobs: series + lags
# (training input), full feature frame, item profiles, size expansion,
# anomalies, merges and accuracy reports, lookups, streaming, CSV, training
# (100 trees, 3 folds, evaluation, refit) and the forecast with the trained model.
HEADLINE = (
    "A01_daily_item_sales",
    "W01_W06_lag_features",
    "M01_build_features",
    "W09_weather_fill",
    "J07_F12_days_to_holiday",
    "A14_A15_hourly_patterns",
    "P01_P04_F26_expand_by_size",
    "J22_similar_items",
    "W10_F07_F13_F14_grouped_outliers",
    "M14_F15_F16_quality_summary",
    "J14_upsert_predictions",
    "J16_save_actuals",
    "A16_forecast_accuracy",
    "A18_period_comparison",
    "A28_keep_latest",
    "S25_orders_to_sales",
    "X03_stream_daily_item_sales",
    "S01_S26_text_roundtrip",
    "J15_auto_compare",
    "X04_stream_auto_compare",
    "M04_M07_train_evaluate",
    "M09_forecast",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    m = re.search(r"sf([0-9.]+)", sf_dir)
    sf = float(m.group(1)) if m else None
    spark = get_spark(f"local[{cpus}]", int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", cpus)), app_name="tillcast-bench")
    queries, _ = load_all()
    names = sorted(queries) if os.environ.get("BENCH_ALL") else [n for n in HEADLINE if n in queries]

    # warm-up: JVM, parquet footers, codegen caches
    queries["A01_daily_item_sales"](spark, sf_dir).write.format("noop").mode("overwrite").save()

    timings: dict[str, float] = {}
    for name in names:
        t0 = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)
    total = round(sum(timings.values()), 3)
    print(json.dumps({"metric": "headline_queries_total_sec", "value": total, "unit": "sec",
                      "queries": timings, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
