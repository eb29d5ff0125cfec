"""Headline queries, timed end to end; prints one JSON line.

BENCH_SF_DIR   folder of the stored tables (default /root/testdata/sf0.1)
BENCH_CPUS     local threads (default 8)
BENCH_QUERIES  optional comma-separated names
"""

from __future__ import annotations

import json
import os
import time

from undertow.plans import catalog
from undertow.session import build_session

HEADLINE = [
    "flagship_panel", "hourly_activity", "daily_sentiment", "daily_sentiment_ratio", "lexicon_sentiment", "mention_counts",
    "dq_timestamps", "rolling_stats_rows", "rolling_stats_time", "sentiment_price_join", "asof_join_nearest", "asof_join_backward",
    "market_series", "var_panel", "granger_pairwise", "lagged_corr_score", "fevd", "rolling_spillover", "pagerank",
    "backtest_compounding", "performance_report", "variance_break_bootstrap", "stratified_split_exact", "daily_features",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["daily_post_counts"](spark, folder).write.format("noop").mode("overwrite").save()  # warm the JVM
    times = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(folder.rstrip("/"))}))


if __name__ == "__main__":
    main()
