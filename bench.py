"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR    data folder (default /root/testdata/sf0.1)
BENCH_CPUS      local cores (default 8)
BENCH_RUNS      timed runs per query after one warm-up; the median counts (default 2)
BENCH_QUERIES   comma-separated names, instead of the headline list
"""

from __future__ import annotations

import json
import os
import statistics
import tempfile
import time

from shelfwatch.session import build_session
from shelfwatch.workloads import load

HEADLINE = [
    "extract_urls_strict",
    "entity_extraction",
    "new_urls_per_domain",
    "guard_classes",
    "accepted_baseline",
    "snapshot_check",
    "entity_changes",
    "entity_changes_shared_urls",
    "keyword_top10",
    "unified_report_domains",
    "games_per_domain_top20",
    "top_games",
    "nested_games",
    "new_per_day",
    "orphans",
    "full_run",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = os.environ.get("BENCH_QUERIES", "")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.checkpoint.dir": f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    seconds: dict[str, float] = {}
    for name in names.split(",") if names else HEADLINE:
        times = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:] or times), 3)
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
