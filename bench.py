"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from barloom.catalog import load  # noqa: E402
from barloom.session import get_session  # noqa: E402

HEADLINE = [
    "p2_densify_daily", "w1_momentum", "w3_sma_daily", "w10_rolling_beta", "w13_percentile_rank", "w15_ewm", "w17_gaussian", "w19_latch", "j2_pit_asof", "j9_reconcile_providers",
    "c1_xs_rank_suppliers", "c3_bottom_n_suppliers", "c7_cap_weights", "c15_trailing_covariance", "a16_summary", "a18_correlation_matrix", "b5_borrow_and_interest", "b8_capacity",
    "g9_xs_momentum", "g17_quality_growth", "g22_trend_plus_vol_target", "g43_supertrend", "m1_ridge_scores", "v1_walk_forward_returns", "v2_block_bootstrap", "v4_permutation_drawdowns",
    "v7_deflated_sharpe", "r4_hurdle_and_verdict", "q3_quality_gate", "s13_read_sessions", "s25_quarter_rows", "study_momentum_net",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_session(f"local[{cpus}]", "barloom-bench", int(cpus) if cpus.isdigit() else 8)
    queries, _ = load()
    queries["a1_total_return"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start the JVM and the workers once
    times = {}
    for key in HEADLINE:
        t = time.perf_counter()
        queries[key](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[key] = round(time.perf_counter() - t, 3)
        print(f"{key} {times[key]}", file=sys.stderr, flush=True)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
