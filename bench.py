"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default ``/root/testdata/sf0.1``) and
``BENCH_CPUS`` the number of local cores (default 8).  Every query is run once
to warm up and then ``BENCH_REPEAT`` times (default 2); the best time counts,
from building the plan to the last row.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from verification.registry import QUERIES  # noqa: E402

HEADLINE = (
    "j2_master",
    "k1_exec_kpis",
    "k2_exec_kpis_fanned",
    "k5_on_time_orders",
    "k8_median_order_value",
    "v1_monthly_revenue",
    "v3_top_states",
    "v6_waterfall",
    "v10_top_categories",
    "v14_category_margin",
    "w1_monthly_growth",
    "w2_category_trends",
    "c3_nps_order",
    "c9_retention",
    "c13_value_quartiles",
    "c19_rfm_segments",
    "c21_time_to_second_row",
    "l5_seller_performance",
    "l6_seller_segments",
    "l9_category_opportunity",
    "d1_logistics_kpis",
    "d7_state_performance",
    "d11_sla",
    "g1_per_capita",
    "g7_supply_demand",
    "p4_category_metrics",
    "p8_price_tiers",
    "f3_window",
    "q6_fanout",
    "q8_roi_marketing",
)


def session(cpus: str) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def main() -> None:
    directory = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    repeat = int(os.environ.get("BENCH_REPEAT", "2"))
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    times: dict[str, float] = {}
    for name in HEADLINE:
        best = float("inf")
        for attempt in range(repeat + 1):
            start = time.perf_counter()
            QUERIES[name](spark, directory).collect()
            if attempt:
                best = min(best, time.perf_counter() - start)
        times[name] = round(best, 3)
    sf = os.path.basename(directory.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
