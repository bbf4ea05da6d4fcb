"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Like the reference's own timing harness (one cold run, then warm runs), the
JVM is warmed up first by running the same queries on the smallest data set;
then every query runs once at the target scale and is timed to full
materialisation (``noop`` sink, so nothing is collected to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from deltapath.catalog import QUERIES  # noqa: E402
from deltapath.session import local_session  # noqa: E402

HEADLINE = [
    "sssp",
    "sssp_tree",
    "sssp_events",
    "hop_count",
    "pregel_min",
    "hop_distances",
    "update_edge_batch",
    "upsert_edges",
    "sssp_after_update",
    "sssp_after_insert",
    "hop_distances_after_update",
    "count_disturbed",
    "stream_sssp",
]
WARMUP_DIR = "/root/testdata/sf0.001"


def run(spark, name: str, sf_dir: str) -> float:
    spark.catalog.clearCache()  # no query is timed on what another one has cached
    t0 = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - t0


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores=cpus, shuffle_partitions=cpus, app="deltapath-bench")
    if os.path.isdir(WARMUP_DIR) and os.environ.get("BENCH_WARMUP", "1") != "0":
        for name in names:
            run(spark, name, WARMUP_DIR)
    times = {}
    for name in names:
        times[name] = round(run(spark, name, sf_dir), 3)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
        "cpus": cpus,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
