"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1) names the tables, BENCH_CPUS the local
cores. Each query runs to a sink that discards its rows; the figure is the median
of three runs in a started session.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from tallycast import workload  # noqa: E402
from tallycast.session import get_session  # noqa: E402

HEADLINE = [
    "i2_ols_cyclic_projects",  # lineitem joined to part, monthly rollup, 25 least-squares fits
    "i2_ols_cyclic_users",
    "e3_top_predicted_user",
    "d1_user_months",
    "d2_project_months",
    "d3_project_user_totals",
    "d6_mean_project",
    "d7_month_totals_expanded",
    "e1_top_user_per_month",
    "e2_top_user_per_project",
    "c3_fill_months",
    "e6_lag_windows",
    "b10_min_history_guard",
    "i1_ols_ordinal_users",
    "i3_ols_rebased_users",
    "i4_ols_standardised_users",
    "i5_pooled_hinges",
    "i5_pooled_trees",
    "i6a_seasonal_ar_users",
    "i6b_seasonal_arma",
    "i7_seasonal_trend_users",
    "i8_seasonal_trend_regressor",
    "i9_pooled_ar",
    "i11_backtest_users",
    "i13_compare_models",
    "j1_top_user_history_and_forecast",
    "j3_month_total_matrix",
    "m1_apportion",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    spark = get_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    spark.sparkContext.setLogLevel("ERROR")
    queries = workload.queries()

    def run(name: str) -> float:
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    run("i2_ols_cyclic_projects")  # start executors and compile
    seconds = {name: round(statistics.median(run(name) for _ in range(3)), 3) for name in HEADLINE}
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
