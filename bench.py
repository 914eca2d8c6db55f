"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from stratocast.queries import QUERIES  # noqa: E402
from stratocast.session import build_session  # noqa: E402

HEADLINE = [
    "strategy_open_maker_base", "dataset_market_clock", "dataset_hourly_snapshots", "asof_latest_quote", "asof_nearest",
    "join_bracket_range", "win_dense_grid", "win_locf", "win_time_range_stats", "win_minutes_since_max", "win_run_islands",
    "win_equity_drawdown", "math_rules", "agg_partial_day_stats", "agg_threshold_sweep", "agg_auc", "edge_training_rows",
    "param_sweep", "view_decision_points", "stream_minute_candles",
]


def main():
    base = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    # One throw-away query, so that JVM start-up is not charged to the first entry.
    QUERIES["agg_freshness"](spark, base).write.format("noop").mode("overwrite").save()
    out = {}
    for name in sys.argv[1:] or HEADLINE:
        t = time.time()
        QUERIES[name](spark, base).write.format("noop").mode("overwrite").save()
        out[name] = round(time.time() - t, 3)
    sf = re.search(r"sf([0-9.]+)", base)
    print(json.dumps({"metric": "headline_total", "value": round(sum(out.values()), 3), "unit": "sec", "queries": out,
                      "sf": float(sf.group(1)) if sf else base}))


main()
