"""Headline queries on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from vigilflow.catalog import QUERIES
from vigilflow.session import build_session

HEADLINES = [
    "F4_engineered_features",
    "A1_headline_stats",
    "A1_stats_single_scan",
    "A4_timeline_hour",
    "J2_unalerted_attacks",
    "A18_M10_report_per_phase",
    "M1_cleaning",
    "M6_F21_hierarchical_rules",
    "M7_M8_learned_scoring",
    "M8_prediction_rows",
    "P12_alert_suppression",
    "S7_netflow_v5",
    "S8_J6_netflow_v9",
    "T1_T2_live_detection",
    "T5_suppression_ttl_1day",
    "T7_packets_to_flows",
    "W1_per_file_split",
    "W2_class_balance",
]
REPEATS = 3


def run(spark, name: str, folder: str) -> float:
    """Seconds to compute every output row (written to a sink that drops them)."""
    begin = time.perf_counter()
    QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in HEADLINES:
        run(spark, name, folder)  # warm-up: code generation and file listing
        times[name] = round(statistics.median(run(spark, name, folder) for _ in range(REPEATS)), 3)
    flows = spark.read.parquet(f"{folder}/lineitem.parquet").count()
    print(
        json.dumps(
            {
                "metric": "sum of median query times", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
                "scored_flows_per_sec": int(flows / times["M8_prediction_rows"]),
            }
        )
    )


if __name__ == "__main__":
    main()
