"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up, then $BENCH_RUNS times (3); its time is the median. Results go to the noop sink, so
every row and column is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from tipwatch.plans.catalog import QUERIES
from tipwatch.session import build_session, clear_scratch

HEADLINE = [
    "regression_verdict",
    "metric_stats",
    "average_ranks",
    "arch_slices",
    "clean_measurements",
    "strip_suite_prefix",
    "scrub_text",
    "redaction_totals",
    "panic_marker",
    "crash_match",
    "silent_gaps",
    "group_streams",
    "vm_outcomes",
    "run_summary",
    "failure_excerpts",
    "stage_stats",
    "manifest_ready_missing",
    "build_report_row",
    "node_outcome",
    "claim_once",
    "resolve_build_id",
    "plan_runs",
    "changed_objects",
    "job_intake",
    "run_state",
    "write_summary",
    "write_report_doc",
    "land_measurements",
]


def timed(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench", **{"spark.master": f"local[{cpus}]", "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "16g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in names:
        timed(spark, name, sf_dir)
        seconds[name] = round(statistics.median(timed(spark, name, sf_dir) for _ in range(runs)), 3)
    clear_scratch(spark)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    line = {"metric": "total_seconds_of_median_warm_runs", "value": round(sum(seconds.values()), 3), "unit": "sec"}
    print(json.dumps({**line, "queries": seconds, "sf": float(sf) if sf.replace(".", "").isdigit() else sf, "cpus": int(cpus)}))


if __name__ == "__main__":
    main()
