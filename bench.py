"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from fareloom.plans.catalog import all_queries  # noqa: E402
from fareloom.session import build_session  # noqa: E402

HEADLINE = [
    "hourly_demand", "daily_supply_demand", "peak_hours_price_vs_cost", "grid_top5",
    "cost_diff_by_duration_quintile", "cost_comparison_summary", "weekday_hour_heatmap",
    "price_by_weather", "correlation_matrix", "price_histogram", "cost_diff_histogram",
    "shift_utilization_by_chauffeur", "training_labels", "similar_auctions", "decision_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8, app="bench",
        **{"spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"), "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.python.sql.dataFrameDebugging.enabled": "false",
           "spark.sql.adaptive.coalescePartitions.minPartitionSize": "64k"})
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    queries["supply_daily"](spark, folder).toPandas()  # start the JVM's code paths
    seconds = {}
    for name in HEADLINE:
        started = time.perf_counter()
        queries[name](spark, folder).toPandas()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
