"""Benchmark the headline queries.

Runs each query end to end (all rows produced, written to a no-op sink so
nothing is collected to the driver) on ``local[$BENCH_CPUS]`` against the
tables in ``$BENCH_SF_DIR`` and prints one JSON line.  One query warms up the
JVM first; a query's time is the median of up to three runs, fewer when it is
long (``BUDGET`` seconds for all its runs).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a06_top_selling",
    "a08_daily_aggregates",
    "a09_item_daily_sales",
    "a13_top_share",
    "c01e_rfm_playbook",
    "c03b_churn_features",
    "c04c_ltv_training",
    "g09_temporal_split",
    "b01_cooccurrence",
    "b04_recommend_cooccurrence",
    "b07_recommend_hybrid",
    "b14_search_docs",
    "q01_validate_transactions",
    "q03_profile",
    "l01_order_totals",
    "f01_forecast_features",
    "e01_regression_metrics",
    "c03c_train_churn",
    "c05b_choose_k",
    "f04_train_forecaster",
    "f06_rollout",
    "b11_factorize",
    "b15_search_vectors",
]
WARM_UP = "a10_overall_metrics"
RUNS, BUDGET = 3, 20


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    names = sys.argv[1:] or HEADLINE
    from tavola.plans import REGISTRY
    from tavola.session import get_spark
    spark = get_spark(f"local[{cpus}]", shuffle_partitions=max(8, 2 * cpus))
    # start the JVM-side machinery once so the first query is not charged for it
    def timed(name: str) -> float:
        t0 = time.perf_counter()
        REGISTRY[name].fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    timed(WARM_UP)
    times: dict[str, float] = {}
    for name in names:
        runs = [timed(name)]
        while len(runs) < RUNS and sum(runs) * (len(runs) + 1) / len(runs) <= BUDGET:
            runs.append(timed(name))
        times[name] = round(statistics.median(runs), 3)
        print(f"{name}: {times[name]}s (of {', '.join(f'{r:.1f}' for r in runs)})", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": float(m.group(1)) if m else sf_dir}))


if __name__ == "__main__":
    main()
