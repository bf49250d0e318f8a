"""Headline benchmark: prints one JSON line with per-query seconds.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8).
Each query is forced with a full collect of its (small) result.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tabprobe.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    # shuffle partitions = cores locally (AQE coalesces further); on a cluster size them to the data instead
    parts = int(os.environ.get("BENCH_SHUFFLE", cpus if cpus.isdigit() else "8"))
    spark = local_session(cpus, shuffle_partitions=parts, app="tabprobe-bench")
    from tabprobe.plans import headline

    # JIT / codegen warm-up on the smallest tables, not timed (set BENCH_WARMUP=0 to skip)
    warm_dir = os.environ.get("BENCH_WARMUP_DIR", "/root/testdata/sf0.001")
    if os.environ.get("BENCH_WARMUP", "1") == "1" and os.path.isdir(warm_dir):
        for fn in headline.QUERIES.values():
            fn(spark, warm_dir)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times = {}
    for name, fn in headline.QUERIES.items():
        t0 = time.time()
        fn(spark, sf_dir)
        times[name] = round(time.time() - t0, 3)
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "total_query_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()
