"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the table folder, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed
runs per query after one warm-up (the median counts). Results go to the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from icetally.operators import plays as play_ops
from icetally.plans import play_queries
from icetally.plans.registry import REGISTERED

HEADLINE = [
    "on_off_share",
    "participant_summary",
    "attach_roster",
    "sparse_union",
    "versus_opponent",
    "rank_test",
    "impact_report",
    "tokenize_text",
    "page_text",
]


def session(cpus: str) -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


def seconds(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    cases = {name: (lambda q=REGISTERED[name][0]: q(spark, sf_dir)) for name in HEADLINE}
    # The shape of one filtered frame per event code, for comparison with sparse_union.
    cases["sparse_union_by_branch"] = lambda: play_ops.sparse_union_by_branch(
        play_queries.detailed_plays(spark, sf_dir)
    )
    timings = {}
    for name, make in cases.items():
        seconds(make)
        timings[name] = round(statistics.median(seconds(make) for _ in range(runs)), 3)
    total = sum(timings[name] for name in HEADLINE)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(total, 3),
                "unit": "sec",
                "queries": timings,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
