"""Median seconds of the headline queries, as one JSON line.

Reads $BENCH_SF_DIR and runs on local[$BENCH_CPUS]. Results go to the noop
sink, so every row is made and none is collected.
"""

import json
import os
import time
from statistics import median

from tidemark.plans.catalogue import run
from tidemark.session import local_session

QUERIES = (
    "scan_lineitem", "filter_and_chain", "join_comma_equi", "join_three_way", "join_three_way_filter",
    "join_theta_self", "distinct_column", "distinct_self_theta_ne", "order_by_multi", "order_by_desc_unprojected",
)
REPEATS = 3


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="bench")
    seconds = {}
    for name in QUERIES:
        times = []
        for _ in range(1 + REPEATS):
            began = time.perf_counter()
            run(name, spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - began)
        seconds[name] = round(median(times[1:]), 4)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 4), "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").rpartition("/sf")[2]}))


if __name__ == "__main__":
    main()
