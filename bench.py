"""Benchmark the headline queries.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query runs once to warm up, then ``BENCH_RUNS`` times (default 3) into
the ``noop`` sink; the median is reported. Prints ONE JSON line.
``BENCH_ALL=1`` times every registered query instead of the headline set.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tidewater.operators import range_stats  # noqa: E402
from tidewater.plans import QUERIES  # noqa: E402
from tidewater.session import get_spark  # noqa: E402

HEADLINE = [
    "range_stats", "column_stats", "group_sum_avg", "agg_by_map", "conditional_counts",
    "csv_infer_scan", "csv_schema_scan", "word_count", "split_explode", "tail_n_per_key", "latest_by_key",
    "reconcile", "upsert_by_key", "stale_rows", "rewrite_links", "normalize_status",
    "validate_events", "retention_filter", "rollup_totals", "status_metrics",
    "stream_bronze", "stream_running_agg", "sql_join_topk", "sql_range_join",
    "sql_rank", "sql_frames", "sql_cube", "sql_scalar_subquery",
    "rank_per_key", "frames_per_key", "stream_validate", "stream_decode", "range_join",
    "delete_by_key",
]


def run_once(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = get_spark("tidewater-bench", {
        "spark.sql.shuffle.partitions": str(max(8, 2 * cpus)),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.session.timeZone": "UTC",
        "spark.driver.memory": "8g",
    }, master=f"local[{cpus}]")
    spark.sparkContext.setLogLevel("ERROR")

    names = list(QUERIES) if os.environ.get("BENCH_ALL") == "1" else HEADLINE
    jobs = {name: (lambda n=name: QUERIES[n](spark, sf_dir)) for name in names}
    # The range operator at 10^5 and 10^8 rows: one aggregate over a sequence
    # generated on the executors.
    jobs["range_1e5"] = lambda: range_stats(spark, 100_000, 10)
    jobs["range_1e8"] = lambda: range_stats(spark, 100_000_000)

    timings: dict[str, float] = {}
    for name, build in jobs.items():
        samples = []
        for i in range(runs + 1):
            t0 = time.perf_counter()
            run_once(build())
            if i > 0:
                samples.append(time.perf_counter() - t0)
        timings[name] = round(statistics.median(samples), 4)

    sf = os.path.basename(sf_dir).replace("sf", "")
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(timings.values()), 4),
        "unit": "sec",
        "queries": timings,
        "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
        "cpus": cpus,
        "runs": runs,
    }))


if __name__ == "__main__":
    main()
