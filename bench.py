"""Time the headline queries and print one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS (default 8) the
cores, BENCH_QUERIES (comma-separated names) another choice of queries. Every query is run
to the end; its result is written nowhere.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from plumbline.plans import views  # noqa: E402
from plumbline.plans.catalog import QUERIES  # noqa: E402
from plumbline.plans.queries_kpi import kpi_reports  # noqa: E402
from plumbline.session import build_session  # noqa: E402

HEADLINE = [
    "E01_prepare_dataset",
    "P12_percentile_threshold",
    "A01_column_profile",
    "A02_category_distribution",
    "A08_group_proxy_summary",
    "W01_keep_last_per_key",
    "M10_threshold_sweep",
    "M15_subgroup_metrics",
    "M17_model_comparison",
    "E06_subgroup_gap_analysis",
    "D03_numeric_shift",
    "D02_category_shift",
    "D05_equal_count_time_bins",
    "D06_stratified_split",
    "X10_possible_worlds",
    "X12_scenario_catalogue",
    "A15_fairness_disparity",
    "E16_risk_proxies",
    "E17_kpi_export",
    "F07_random_forest_balanced",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES")
    names = chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "plumbline-bench",
        master=f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()
    seconds = {}

    def timed(name: str, run) -> None:
        start = time.perf_counter()
        run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(f"{name} {seconds[name]}", file=sys.stderr, flush=True)

    # The shared tables are written once; their time is told apart from that of the queries.
    shared = {
        "view_prepared": views.prepared,
        "view_scored": views.scored,
        "view_kpi_reports": lambda s, d: kpi_reports(s, d)[0].table,
    }
    for name, view in shared.items():
        timed(name, view)
    for name in names:
        timed(name, QUERIES[name])
    result = {
        "metric": "total seconds of the headline queries",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": sf_dir.rsplit("sf", 1)[-1],
    }
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
