"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose data and cores.
"""

from __future__ import annotations

import json
import os
import time

from stratapanel.plans.catalog import QUERIES
from stratapanel.runtime import local_session

HEADLINE = [
    "session_position", "rolling_liquidity", "prior_volume_baseline", "interval_panel_pit", "interval_panel", "interval_panel_strict",
    "cross_sectional_rank", "rank_ic_daily", "ic_summary_pooled", "pooled_bucket_stats", "tail_analysis", "nonoverlap_offsets",
    "winsorize_same_date", "interval_event_crossing", "event_study", "sector_daily_return", "distribution_summary", "pairwise_correlation",
    "leave_one_entity_out", "residualize_same_date", "block_bootstrap_ci", "bars_from_minutes", "table_reconcile", "event_safe_targets",
    "hysteresis_select", "drawdown_attribution",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the JVM before the clock runs
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    main()
