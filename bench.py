"""Seconds per headline query at $BENCH_SF_DIR on local[$BENCH_CPUS]; one JSON line.

Every query runs to a sink that takes all rows and keeps none, so nothing is
collected. The first run of the session warms the JVM and is not counted;
each query reports the better of $BENCH_RUNS runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from hindcast.plans.queries import QUERIES  # noqa: E402

HEADLINE = [
    "event_scan", "storage_stats", "select_displays", "search_newest", "search_kind_app", "search_relevance",
    "search_ranked", "search_ranked_scan", "search_any", "postings_build", "search_fold", "search_excerpt",
    "cap_text", "list_apps", "list_windows", "app_time", "timeline", "sessions", "digest_topk",
    "bleed_coverage", "label_origin", "turns_all", "transcript", "prune_size", "prune_combined", "orphans",
    "compress_plan", "reconcile", "verify_psnr", "compress_report", "stream_sessions", "levels_batch",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    names = sys.argv[1:] or HEADLINE
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("hindcast-bench")
             .config("spark.ui.enabled", "false").config("spark.driver.memory", "16g")
             .config("spark.sql.shuffle.partitions", str(max(8, int(cpus)))).getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["list_apps"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - start
            best = seconds if best is None else min(best, seconds)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec",
                      "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
