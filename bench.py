"""Time the headline queries: ``BENCH_SF_DIR`` and ``BENCH_CPUS`` choose data and cores.

Each query is planned, including its size checks, and run to the end into a sink that drops
the rows. Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from sitehazard.plans.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "forecast_json_flatten",
    "clean_weather",
    "clean_hazards",
    "hazard_bands",
    "nearest_hazard",
    "quakes_near",
    "hazard_map_top50",
    "trend_features",
    "hourly_resample",
    "asof_air_quality",
    "bulk_row_scoring",
    "risk_scores",
    "explanations",
    "current_risk",
    "place_lookup",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # plans build faster
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "12g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    wanted = sys.argv[1:] or HEADLINE
    # Start the JVM's and the readers' machinery outside the timings.
    spark.read.parquet(f"{folder}/events.parquet").groupBy("event_type").count().collect()
    seconds: dict[str, float] = {}
    for name in wanted:
        start = time.time()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.time() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")),
                "cpus": int(cpus),
            }
        )
    )


if __name__ == "__main__":
    main()
