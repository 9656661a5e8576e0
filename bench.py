"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import SparkSession  # noqa: E402

from waymark.plans import registry  # noqa: E402

HEADLINE = [
    "A1_cluster_metrics", "P15_feature_rows", "J16_leg_matrix", "J23_nested_assembly", "A20_service_health", "W3_gap_and_overlap", "U1_plan_diff",
    "C12_audit_report", "C14_cost_range", "G2_aggregation_rules", "G11_total_score", "G9_day_fill", "G12_day_clusters", "A23_document_frequency",
    "R1_hash_embedding", "R7_bm25", "R9_rerank", "Q1_contract_engine", "ST2_daily_counts", "M3_ranking_metrics",
]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("waymark-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.all_queries()
    spark.read.parquet(f"{root}/nation.parquet").count()
    seconds = {}
    for key in HEADLINE:
        started = time.perf_counter()
        queries[key](spark, root).write.format("noop").mode("overwrite").save()
        seconds[key] = round(time.perf_counter() - started, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": float(Path(root).name.removeprefix("sf") or 0),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
