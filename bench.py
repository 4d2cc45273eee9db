"""Headline queries at one scale; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from factorlake import build_session  # noqa: E402
from factorlake.catalog import load_all  # noqa: E402

HEADLINE = ["bar_returns", "bar_trend", "bar_volatility", "bar_rsi_range", "bar_macd", "technicals_at_snapshots", "momentum_leaders", "forward_returns",
            "fixed_lag_features", "filing_date_features", "quant_scores", "classic_scores", "snapshot_baskets", "evaluation_summary", "top_n_sweep",
            "weight_sensitivity", "factor_ic", "screen_top", "holdings_consensus", "customer_concentration", "piotroski_altman", "percentile_scores"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "12g"), "spark.ui.enabled": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registered = load_all()
    seconds: dict[str, float] = {}
    spark.range(1).count()
    for name in HEADLINE:
        start = time.perf_counter()
        registered[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
