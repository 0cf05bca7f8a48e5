"""Headline queries, timed one by one; prints one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py [name ...]
"""

from __future__ import annotations

import json
import os
import sys
import time

from tidemark.plans import QUERIES
from tidemark.session import local_session

HEADLINE = [
    "prices_panel", "momentum_topk_monthly", "technical_features", "pit_universe", "investible_targets", "asof_fundamentals",
    "total_return_close", "stale_marks", "monthly_ic", "topk_metrics", "drift_moments", "ks_wasserstein", "pairwise_covariance", "turnover",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores, int(cores) if cores.isdigit() else 8)
    # Start the JVM's readers and code generation on the smallest query, outside the timings.
    QUERIES["prices_panel"](spark, folder).write.format("noop").mode("overwrite").save()
    times = {}
    for name in sys.argv[1:] or HEADLINE:
        started = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - started, 3)
    print(json.dumps({
        "metric": "total seconds of headline queries", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
