"""Headline queries, timed one by one; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores. Results go to
Spark's no-op sink, so the whole plan runs and nothing is gathered on the driver.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "window_changes", "entity_rollup", "presence_audit", "threshold_episodes", "exposure_summary", "nearest_unique_match", "joint_intervals",
    "steps", "regime_classes", "event_aligned_curve", "mask_turnover", "territory_overlap", "contacts", "pair_correlations", "robust_trend",
    "rhythm_screen", "corrected_families", "anchored_windows", "stream_window_rollup", "declared_contrasts", "pool_recordings", "gap_measurement_additions",
]
#: Queries that are also timed with every key held to be heavy, so that the two-level plans are measured.
TWO_LEVEL = ["steps"]


def main() -> None:
    from pyspark.sql import SparkSession

    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("lapsegrid-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "16g")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.checkpoint.dir", "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    from lapsegrid import workload
    from lapsegrid.plans.heavy import LIMIT_SETTING

    calls = workload.callables()
    seconds = {}

    def timed(name: str) -> float:
        start = time.perf_counter()
        calls[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    timed("entity_rollup")  # the first query loads classes and compiles
    for name in HEADLINE:
        seconds[name] = timed(name)
    spark.conf.set(LIMIT_SETTING, "1000")
    for name in TWO_LEVEL:
        seconds[f"{name}_two_level"] = timed(name)
    spark.conf.unset(LIMIT_SETTING)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
