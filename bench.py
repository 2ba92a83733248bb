"""Time the registered queries and print one JSON line.

BENCH_SF_DIR    folder with the Parquet tables (default /root/testdata/sf0.1)
BENCH_CPUS      local threads (default 8)
BENCH_RUNS      timed runs per query after one warm-up; the median counts (default 3)
BENCH_QUERIES   comma-separated names; default: the headline queries, "all" for every one
BENCH_BUDGET    seconds after which a query gets one timed run only (default 240)
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from featlake.plans import QUERIES  # noqa: E402
from featlake.session import build_session  # noqa: E402

HEADLINE = (
    "infer_catalog", "model_input", "oob_audit", "pad_multihot", "build_history", "time_bucket",
    "time_bucket_hist", "seq_latest_k", "seq_mean_pool", "seq_stats", "time_gap_features",
    "embedding_lookup", "embedding_bag_mean", "vector_chunks", "split_tail", "assign_batches",
    "window_shuffle", "bce_loss", "focal_loss", "auc", "auc_by_user", "early_stop",
    "hard_examples", "predictions_last_wins", "leaderboard",
)


def run(spark, sf_dir: str, name: str) -> float:
    """Seconds to build the query and produce every row."""
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    budget = float(os.environ.get("BENCH_BUDGET", "240"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else list(HEADLINE)
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "16g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    started = time.perf_counter()
    seconds = {}
    for name in names:
        times = [run(spark, sf_dir, name)]
        for _ in range(runs):
            if len(times) > 1 and time.perf_counter() - started > budget:
                break
            times.append(run(spark, sf_dir, name))
        timed = times[1:] or times
        seconds[name] = round(statistics.median(timed), 4)
        print(f"{name}: {seconds[name]}", file=sys.stderr, flush=True)
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 4),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }
    print(json.dumps(result))
    spark.stop()


if __name__ == "__main__":
    main()
