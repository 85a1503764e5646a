"""Time the headline queries and print one JSON line.

BENCH_SF_DIR: table folder (default /root/testdata/sf0.1). BENCH_CPUS: local cores (default 4).
BENCH_RUNS: timed runs per query after one warm-up; the median counts (default 3).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from tidemark.registry import all_queries  # noqa: E402
from tidemark.session import build_session  # noqa: E402

HEADLINES = [
    "scan_parquet",
    "agg_conditional_sum",
    "agg_collect_list",
    "profile_percentiles",
    "join_condition_drop",
    "join_left_anti",
    "win_rank",
    "win_row_number",
    "win_range_week_max",
    "win_rows_vs_range",
    "win_median_partition",
    "pudf_series",
    "udf_fraction_reduce",
    "min_max_norm",
    "ml_capper",
    "job_word_count",
    "job_word_length",
    "job_commercial_ratio",
    "job_channel_ratio_weighted",
    "job_episode_roundtrip",
    "job_failure_rate",
    "job_reliable_drives",
    "job_modal_capacity",
    "job_coldest",
    "job_recipe_features",
    "job_recipe_model",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "4")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.driver.memory": "6g",
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()

    def timed(run) -> float:
        start = time.perf_counter()
        run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINES:
        timed(queries[name])
        seconds[name] = round(statistics.median(timed(queries[name]) for _ in range(runs)), 4)
    total = round(sum(seconds.values()), 4)
    print(json.dumps({"metric": "headline_queries_total", "value": total, "unit": "sec", "queries": seconds, "cpus": int(cpus), "sf": folder.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
