"""Times the headline queries; prints one JSON line.

Each query is run in full: all rows and columns are produced and dropped by the noop
sink. Stage tables are shared between the queries of one run, as services share topics,
so the time to fill them is reported as its own entry.
"""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tidewatch.catalog import queries

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "flow_window_totals",
    "flow_per_ip",
    "bidirectional_flows",
    "iat_ttl",
    "stealth_labels",
    "dga_flags",
    "minhash_signature",
    "spatial_jaccard",
    "spatial_fanout",
    "kinematics",
    "renyi_tumbling",
    "renyi_trailing",
    "offline_features",
    "spike_alerts",
    "stability_check",
    "unified_features",
    "bayes_posterior",
    "verdicts",
    "alerts",
    "latest_per_ip",
    "sanitized_batch",
    "adaptive_training_set",
    "balanced_lines",
    "point_adjusted_metrics",
    "roc_auc",
    "regression_metrics",
    "json_decode",
    "csv_flows",
    "frame_decode",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("tidewatch-bench")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM paths and the Python workers outside of the timings
    spark.range(1000).selectExpr("sum(id)").collect()

    timings = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run()
        timings[name] = round(time.perf_counter() - start, 3)

    timed("stage_scored_windows", lambda: queries.scored_windows(spark, FOLDER))
    timed("stage_events", lambda: queries.events_table(spark, FOLDER))
    for name in HEADLINE:
        frame = queries.REGISTRY[name]
        timed(name, lambda: frame(spark, FOLDER).write.format("noop").mode("overwrite").save())
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": FOLDER.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
