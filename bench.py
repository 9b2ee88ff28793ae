"""Time the headline queries and print one JSON line.

Each query runs once to warm up and three times for the median, its whole
result written to the no-op sink.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from claimbook.catalog import all_queries

HEADLINE = (
    "loss_cost_by_maturity",
    "loss_cost_at_common_valuation",
    "latest_diagonal_by_coverage",
    "combined_ceded_losses",
    "developed_losses",
    "latest_snapshots",
    "report_lag",
    "corrected_loss_dates",
    "claimants_per_claim",
    "exposure_by_year",
    "implausible_speed",
    "box_statistics",
    "column_summary_losses",
    "histogram_two_facets",
    "histogram_share_of_all",
    "null_profile",
    "keys_with_several_features",
    "decompose_claim_counts",
    "paid_history_wide",
    "claim_counts_wide",
    "merged_experience",
    "modelling_table",
    "state_distribution",
    "correlation_matrix",
    "component_scores_two_columns",
    "logistic_one_category",
    "variance_inflation",
    "confusion_statistics",
    "lasso_error_curve",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    chosen = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("claimbook-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="claimbook-bench-"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered, timings = all_queries(), {}
    for name in chosen:
        runs = []
        for i in range(repeats + 1):
            start = time.perf_counter()
            registered[name].build(spark, sf_dir).write.format("noop").mode("overwrite").save()
            if i:
                runs.append(time.perf_counter() - start)
        timings[name] = round(statistics.median(runs), 3)
        print(f"{name}: {timings[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds_headline_queries",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1],
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
