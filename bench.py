"""Times the TPC-H queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then three times; its figure is the median. Results are collected, as a client
would; all of them are small.
"""

from __future__ import annotations

import json
import os
import sys
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))


def main() -> None:
    from siltstone.plans import registry
    from siltstone.session import build_session

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 8))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        {"spark.sql.shuffle.partitions": str(cpus), "spark.ui.enabled": "false", "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name, run in registry.queries().items():
        if not name.startswith("tpch_"):
            continue
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            run(spark, sf_dir).collect()
            runs.append(time.perf_counter() - began)
        took[name.removeprefix("tpch_")] = round(median(runs[1:]), 4)
    print(json.dumps({"metric": "tpch_total", "value": round(sum(took.values()), 4), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
