"""Time the headline queries; prints one JSON line.

    BENCH_SF_DIR   input folder (default /root/testdata/sf0.1)
    BENCH_CPUS     threads (default 8)

Every query is run once to warm up and then timed as the best of two runs. Results are
written to the no-op sink, so that the whole result is computed and nothing is collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession

from tickbars.queries import all_queries

HEADLINE = (
    "bars_1h",
    "bars_all_periods",
    "bars_gapfilled",
    "bars_late_dropped",
    "bars_with_clock",
    "bars_seeded",
    "audit_full_outer",
    "audit_summary",
    "continuity_audit",
    "upsert_bars",
    "latest_bar_per_key",
    "backfill_batches",
    "parse_single_stream",
    "parse_logs",
    "log_sessions",
    "trace_stats",
    "span_paths",
    "smoothed_delay",
    "stream_bars_exact",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("tickbars-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def timed(spark: SparkSession, query, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = session(cpus)
    queries = all_queries()
    seconds = {}
    for name in names:
        timed(spark, queries[name], sf_dir)
        seconds[name] = round(min(timed(spark, queries[name], sf_dir) for _ in range(2)), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total seconds over headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(os.path.basename(sf_dir.rstrip("/")).removeprefix("sf") or 0),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
