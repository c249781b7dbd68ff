"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the table folder (default sf0.1), BENCH_CPUS the local cores (default 8) and
BENCH_QUERIES, if set, a comma-separated choice of queries. Results go to a sink that reads every row and
column. One small query runs first so that JVM start-up is not counted.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from ridgewater.plans import registry  # noqa: E402
from ridgewater.session import local_session  # noqa: E402

HEADLINE = [
    "zone_status",
    "nearest_polygon",
    "nearest_k_shelters",
    "radius_join",
    "trailing_totals",
    "forecast_outlook",
    "district_days",
    "relative_predictors",
    "roc_auc",
    "rarity_other_years",
    "fixed_false_alarm_loyo",
    "best_tss_loyo",
    "event_episodes",
    "report_lifecycle",
    "ffpi_bands",
    "flow_accumulation",
    "road_edges",
    "edge_hazard_overlay",
    "nearest_by_cost",
    "cause_classes",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    chosen = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or HEADLINE
    spark = local_session("bench", cores, shuffle_partitions=int(cores))
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.all_queries()
    queries["layer_health"][0](spark, sf_dir).collect()
    times = {}
    for name in chosen:
        start = time.time()
        queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
