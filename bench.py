"""Headline queries, timed cold once per query; prints one JSON line.

Environment: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default all cores).
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelloom.plans import load_registry
from panelloom.session import build_session

HEADLINE = (
    "factor_latest_panel", "returns_dense", "price_upsert_last_wins", "weekly_friday_compound", "vol_target",
    "strip_single_factor", "rolling_slope_156w", "core_factor_layer", "cross_section_ranks", "rank_whole_table",
    "exposure_grid_fixed", "exposure_grid_elastic_net", "factor_cov", "risk_decomposition", "composite_screen",
    "selection_monthly", "shrink_means", "factor_risk_matrix", "greedy_max_return", "constraint_audit",
    "replay_daily", "performance_stats", "block_bootstrap",
)


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS") or str(os.cpu_count() or 4)
    spark = build_session(
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    registry, times, rows = load_registry(), {}, {}
    for name in HEADLINE:
        start = time.perf_counter()
        # every output column is computed and counted on the executors
        out = registry[name].run(spark, sf)
        rows[name] = out.selectExpr(f"xxhash64({', '.join('`' + c + '`' for c in out.columns)}) AS h").selectExpr("count(h) AS n").first()[0]
        times[name] = round(time.perf_counter() - start, 3)
    fits = rows["exposure_grid_elastic_net"] / times["exposure_grid_elastic_net"]
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "rows": rows,
        "elastic_net_fits_per_sec": round(fits, 1), "sf": os.path.basename(sf.rstrip("/")), "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
