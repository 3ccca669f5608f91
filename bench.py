"""Wall-clock per headline query; prints one JSON line."""
from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from bourselake.plans import registry  # noqa: E402
from bourselake.session import build_session  # noqa: E402

HEADLINE = ("breadth_series", "sector_breadth", "features_panel", "indicator_snapshot",
            "ma_deviation_z", "constituent_metrics", "pair_self_join", "risk_metrics",
            "market_regime", "watchlist_topn", "perf_stats", "param_sweep", "forward_returns",
            "skill_metrics", "influence_edges", "news_items", "similar_signal_join",
            "option_prices", "flow_regime", "breadth_health", "macro_regime")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    runs = registry.queries()
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").limit(1).collect()
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        if name not in runs:
            continue
        started = time.perf_counter()
        runs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(seconds.values()), 3),
                      "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir)[2:]}))


if __name__ == "__main__":
    main()
