"""Times the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables, BENCH_CPUS the local cores. ``grid_360`` is a grid run of the published
shape: one series of 8,761 bars, 360 parameter points. Stop and target widths do not change a run here, so these
are ``grid_runs`` = 60 computed runs; ``grid_runs_per_sec`` is the rate to compare.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import functions as F

from fxspark.operators import signals as sg
from fxspark.plans import load_all
from fxspark.plans.inputs import bars
from fxspark.plans.registry import QUERIES
from fxspark.session import build_session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = [
    "A1_hourly_score_statistics_v1", "A2_hourly_score_statistics", "A3_minute_score_statistics", "A4_merged_score_states", "A5_bias_rollup",
    "A6_decayed_currency_score", "A22_session_statistics", "A25_atr_volume_correlation", "A31_sharpe_and_drawdown", "A37_macro_risk",
    "W3_moving_averages", "W4_ema_recursive", "W7_rsi", "W8_macd", "W10_bollinger_bands", "W14_rolling_shape", "W15_fill_gaps", "W20_equity_and_drawdown",
    "W21_streaks", "S19_feature_table", "M1_walk_forward_splits", "M3_purged_splits", "M4_backtest_overfitting", "M9_hourly_anomalies",
    "M10_next_volume_forecast", "M14_transition_matrix", "M21_grid_metrics", "J1_backfill_actuals", "J6_macro_as_of", "J7_event_scores",
    "J13_nearest_vectors", "O4_best_per_run", "O6_latest_version", "O9_event_dedup", "P7_json_body", "P14_event_type", "P18_text_chunks", "W26_rank_numbers",
]
GRID = {"ma_type": ["sma", "ema"], "fast_window": [5, 10, 15, 20, 25, 30], "slow_window": [40, 60, 80, 100, 120],
        "sl_pct": [0.005, 0.01, 0.02], "tp_pct": [0.01, 0.02]}

GRID_RUNS = len(GRID["ma_type"]) * len(GRID["fast_window"]) * len(GRID["slow_window"])


def grid_360(spark, sf):
    one = bars(spark, sf).filter("symbol = 'view'").orderBy("ts").limit(8761)
    return sg.backtest(one, "trend_following", GRID)


def main() -> None:
    load_all()
    spark = build_session("fxspark-bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "20g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{SF_DIR}/events.parquet").groupBy("event_type").agg(F.sum("value")).collect()
    wanted = sys.argv[1:] or [*HEADLINE, "grid_360"]
    times = {}
    for name in wanted:
        fn = grid_360 if name == "grid_360" else QUERIES[name]
        t = time.perf_counter()
        fn(spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t, 3)
    more = {"grid_runs": GRID_RUNS, "grid_runs_per_sec": round(GRID_RUNS / times["grid_360"], 2)} if "grid_360" in times else {}
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")), **more}))
    spark.stop()


if __name__ == "__main__":
    main()
