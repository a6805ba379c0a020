"""Headline timings: one JSON line. BENCH_SF_DIR and BENCH_CPUS choose data and cores."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidegauge.functions.sizing import remove_settled
from tidegauge.plans.catalog import QUERIES
from tidegauge.plans.workbench import workbench

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

# Chunks to records, records to levels and dashboards, scores, load shape, SQL, streams.
HEADLINE = (
    "record_build", "itl_gaps", "eval_backfill", "level_summary", "reliability", "goodput", "pct_object", "dash_default",
    "panel_pivot", "in_flight", "load_peaks", "replay_prefix", "ttft_cdf", "score_replies", "dedup_tool_calls",
    "adhoc_sql", "adhoc_p99", "stream_levels", "stream_assemble",
)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    bench = workbench(spark, FOLDER)
    bench.fx.table("lineitem").count()
    times: dict[str, float] = {}

    def timed(name: str, run) -> None:
        began = time.perf_counter()
        run()
        times[name] = round(time.perf_counter() - began, 3)

    # The tables every later query reads: written once, timed on their own.
    timed("write_records", lambda: bench.records)
    timed("write_scored", lambda: bench.scored)
    for name in HEADLINE:
        timed(name, lambda: QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save())
    total = round(sum(times.values()), 3)
    scale = os.path.basename(FOLDER.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline queries, total wall time", "value": total, "unit": "sec", "queries": times, "sf": scale}))
    remove_settled(spark)
    spark.stop()


if __name__ == "__main__":
    main()
