"""Time the headline queries: prints one JSON line.

BENCH_SF_DIR names the input folder, BENCH_CPUS the local cores. Every query is run to a no-op
sink; the best of two runs counts, so that JVM start-up is not measured.
"""

from __future__ import annotations

import json
import os
import time

from tradebook.plans import catalog
from tradebook.session import build_session

HEADLINE = [
    "count_by_state", "clean_business", "validate_business", "input_totals", "dedup_businesses", "business_kpis",
    "clean_text", "relevance_score", "top_results", "resolve_results", "name_mentions", "extract_cascade",
    "metrics_by_interval", "limit_rate", "lockouts", "alerts_with_dedup", "match_pattern", "node_uptime",
    "consecutive_errors", "cache_lookup", "evict_lru", "threshold_rules",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = build_session("bench", cpus=int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            t0 = time.perf_counter()
            catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(min(runs), 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
