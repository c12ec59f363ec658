"""Time the headline queries: one JSON line on stdout.

    BENCH_SF_DIR  folder with the parquet tables (default /root/testdata/sf0.1)
    BENCH_CPUS    local cores (default 8)
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from lanternfish.plans.catalog import QUERIES  # noqa: E402
from lanternfish.session import build_session  # noqa: E402

# One or two of every job: conform, describe, join, validate, merge, ingest, forecast, extract.
HEADLINE = [
    "recovery_by_year",
    "split_number_title",
    "canonicalize_date",
    "first_match_label",
    "holiday_flag",
    "search_archive",
    "map_clusters",
    "place_detail",
    "recent_activity",
    "nearest_k",
    "nearest_in_time",
    "dup_exact_flag",
    "validation_summary",
    "survivorship_merge",
    "classify_changes",
    "merge_upsert",
    "next_state",
    "kernel_activity_index",
    "kernel_zone_priors",
    "calendar_affinity",
    "backtest_exact_place",
    "daily_briefing",
    "page_record",
    "place_from_prose",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]",
        "lanternfish-bench",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g",
           "spark.checkpoint.dir": tempfile.mkdtemp(prefix="run-")},
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the engine once; every query is then timed as it is
    spark.read.parquet(f"{folder}/region.parquet").groupBy("r_name").count().collect()
    seconds = {}
    for name in sys.argv[1:] or HEADLINE:
        start = time.perf_counter()
        # the whole result is produced, nothing is sent to the driver
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "cpus": int(cpus),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
