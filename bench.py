"""Time the headline queries; prints one JSON line.

Environment: BENCH_SF_DIR (default sf0.1), BENCH_CPUS (default 8), BENCH_QUERIES (comma list or ``all``).
Every query runs once to warm up and then RUNS times; the best wall-clock is reported and each
result is consumed completely by a noop write.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "operational_shortlist", "diagnostics_grouping_sets", "top_per_category", "segments_multi_label", "taxonomy_first_match",
    "dedupe_first_seen", "best_award_per_tender", "link_semi_join", "link_sets", "award_consolidation", "evidence_funnel",
    "branch_cascade", "master_projects", "home_kpis_branch", "data_quality_issues", "snapshot_delta", "faceted_search", "page_features",
]
RUNS = int(os.environ.get("BENCH_RUNS", "2"))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from cantiere.session import get_session
    from cantiere.plans import catalog

    spark = get_session(f"local[{cpus}]", "bench", **{
        "spark.ui.enabled": "false", "spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.sql.shuffle.partitions": cpus,
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.queries()
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(queries) if chosen == "all" else ([n for n in chosen.split(",") if n] or HEADLINE)
    times = {}
    for name in names:
        best = None
        for i in range(RUNS + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - start
            if i:
                best = took if best is None else min(best, took)
        times[name] = round(best, 3)
        if os.environ.get("BENCH_VERBOSE"):
            print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir).removeprefix("sf")}))


if __name__ == "__main__":
    main()
