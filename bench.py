"""Headline queries at one scale, printed as one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma-separated
names). Each query is run once to warm up and then BENCH_RUNS times (default 2); the best time counts.
Results go to the no-op sink, so every row is produced and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shelfline.plans import registry  # noqa: E402
from shelfline.session import local_session  # noqa: E402

HEADLINE = [
    "A01_daily_sales",
    "A02_customer_value",
    "A03_ad_product_performance",
    "A08_performance_build",
    "A26_demand_profile",
    "A35_journey_patterns",
    "A55_product_share",
    "E05_feature_set",
    "J03_full_outer_daily",
    "J06_campaign_url_join",
    "K05_kpi_status",
    "M04_time_decay",
    "M05_recency_decay",
    "M08_attribution_windows",
    "Q06_all_checks",
    "R01_current_inventory",
    "R03_unified_marketing_inventory",
    "R05_six_week_reorder",
    "R21_unified_recommendations",
    "S09_keyed_upsert",
    "T04_stream_daily_totals",
    "V11_issue_totals",
    "W02_daily_rankings",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = local_session(cpus, "shelfline-bench")
    queries = registry.all_queries()
    times = {}
    for name in names:
        best = None
        for i in range(runs + 1):
            t0 = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t0
            if i:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
