"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is forced end to end with the ``noop`` sink (full computation, no
driver collect). One warm-up pass at sf0.001 compiles and caches code, then
each query runs $BENCH_REPEATS times (default 3) at the target scale; the
per-query figure is the median, so the first (cold) pass at the target scale
(JIT, page cache, code generation for new sizes) does not decide the number.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a1_sql_benchmark_summary",
    "h9_pair_scores",
    "a19_component_error_rate",
    "a2_model_approach_means",
    "a7_improvement_vs_raw",
    "a21_task_chart_dataset",
    "q2_join_group_sum_sort",
    "q4_monthly_growth_lag",
    "a12_a24_sentiment_counts",
    "u4_h25_translate_replay",
    "j6_h15_english_word_filter",
    "u3_sentiment_attempts",
    "w2_running_retry_count",
    "r2_usage_per_window",
    "u7_financial_json",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    from verity.plans import catalog
    from verity.session import local_session

    spark = local_session(cores=cpus, shuffle_partitions=max(int(cpus), 1) if cpus.isdigit() else 8,
                          app="verity-bench")
    catalog.load_all()

    def run(name, sf):
        t0 = time.perf_counter()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    for name in HEADLINE:
        run(name, "/root/testdata/sf0.001")
    times = {name: round(statistics.median(run(name, sf_dir) for _ in range(repeats)), 3) for name in HEADLINE}
    sf = sf_dir.rstrip("/").rsplit("sf", 1)[-1]
    print(json.dumps({"metric": "headline_total_seconds", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(sf) if sf.replace(".", "").isdigit() else sf_dir,
                      "cpus": cpus, "repeats": repeats}))


if __name__ == "__main__":
    main()
