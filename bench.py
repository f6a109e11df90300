"""Headline queries, timed: one JSON line on stdout.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores (default 8), BENCH_REPEATS the timed runs
after one warm-up (default 3, the median is reported). ``input_*`` entries build the shared inputs from the tables,
cold, once; the other queries read them. ``end_to_end`` goes from the tables to the inventory indicators without any
shared input, every time.
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfcast.operators import inventory
from shelfcast.operators.etl import clean_inventory
from shelfcast.plans import base, registry
from shelfcast.session import build_session
from shelfcast.sources import feeds

HEADLINE = (
    "etl_clean", "inventory_kpis", "abc_classes", "category_quantiles", "vendor_scores", "eoq_by_category", "iqr_outliers",
    "pearson_pairs", "kruskal_by_vendor", "demand_features", "feature_table", "dataset_statistics", "forecast_naive",
    "forecast_trend_harmonics", "forecast_seasonal_trend", "forecast_ridge", "forecast_seasonal_ar", "walk_forward_naive",
    "hierarchy_levels", "ks_statistics", "psi_equal_width", "concept_drift", "capacity_feasibility", "demand_spikes",
    "scenario_kpis", "quality_demand_suite", "run_status", "window_health", "nearest_neighbours", "stream_request_metrics",
)
INPUTS = {"input_inventory": base.classified, "input_brand_demand": base.brand_demand, "input_sku_daily": base.sku_daily}


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def end_to_end(spark, folder):
    return inventory.kpis(inventory.health(clean_inventory(feeds.raw_inventory(spark, folder))))


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=cpus)
    spark.sparkContext.setLogLevel("FATAL")
    times: dict[str, float] = {}
    for name, build in INPUTS.items():
        start = time.perf_counter()
        run(build(spark, folder))
        times[name] = round(time.perf_counter() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    queries = registry.queries() | {"end_to_end": end_to_end}
    for name in (*HEADLINE, "end_to_end"):
        taken = []
        for i in range(repeats + 1):
            start = time.perf_counter()
            run(queries[name](spark, folder))
            if i:
                taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": float(scale.group(1).rstrip(".")) if scale else None, "cores": cpus, "spark": spark.version,
        "shuffle_partitions": cpus, "driver_memory": spark.conf.get("spark.driver.memory", ""),
    }))


if __name__ == "__main__":
    main()
