"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once untimed (class loading, code generation) and then three times; the median counts. Results go to
the "noop" sink, so every row is produced and nothing is collected.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import SparkSession

from runledger.plans import all_queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "agg_01_success_by_tolerance", "agg_03_stratify", "agg_06_describe", "agg_08_rank_percentile",
    "agg_11_failure_distribution", "agg_19_compare_configs", "sta_01_bootstrap_ci", "sta_01_bootstrap_ci_binomial",
    "sta_03_fdr_bh", "sta_05_kl_divergence", "sta_08_fit_gain_by_regime", "sta_15_ecdf", "sta_16_box_stats",
    "sta_17_kde_grid", "spl_02_stratified_split3", "spl_05_quota_sample", "spl_07_rekey", "win_01_running_success",
    "win_04_at_nearest_time", "jon_02_assign_range_join", "txt_04_parse_last6_documents", "txt_08_valid_format_documents",
    "txt_10_parse_run_log", "gen_01_mixture", "gen_03_binned", "src_04_results_jsonl", "str_02_stream_dedup",
    "flow_closed_loop", "flow_mixed_training_set",
]
REPEATS = int(os.environ.get("BENCH_REPEATS", "3"))


def run(query, spark) -> float:
    start = time.perf_counter()
    query(spark, SF_DIR).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS).config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g")).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    times = {}
    for name in names:
        run(queries[name], spark)
        times[name] = round(statistics.median(run(queries[name], spark) for _ in range(REPEATS)), 3)
        print(name, times[name], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
