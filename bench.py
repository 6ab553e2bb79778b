"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local
cores, ``BENCH_RUNS`` how often each query runs after a first untimed run; the
median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from spendlens.session import build_session  # noqa: E402
from workload.queries import QUERIES  # noqa: E402

HEADLINE = [
    "trend_top5_total_sales",
    "trend_top5_roas",
    "campaign_card",
    "sku_daily",
    "campaign_overview",
    "metric_profile",
    "share_campaign_top5",
    "share_sku_top5",
    "metric_ranks",
    "sales_contribution",
    "flag_promoted",
    "flow_links",
    "flow_links_by_sku",
    "score_sku",
    "placement_share",
    "placement_daily",
]


def seconds(query, spark, sf_dir: str) -> float:
    """Plan, run and drop the whole result."""
    begin = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - begin


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus,
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "16g",
    })
    spark.sparkContext.setLogLevel("ERROR")
    for name in HEADLINE:  # start-up and code generation are not timed
        seconds(QUERIES[name], spark, sf_dir)
    times = {
        name: round(statistics.median(seconds(QUERIES[name], spark, sf_dir) for _ in range(runs)), 3)
        for name in HEADLINE
    }
    print(json.dumps({
        "metric": "total_query_time",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(sf_dir.rstrip("/").rsplit("sf", 1)[-1]),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
