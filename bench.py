"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local cores. Each query runs
once untimed (class loading, code generation and compilation), then ``BENCH_RUNS``
times, and the best run counts. Building the plan is included, nothing is cached between runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from formbook import queries as registry  # noqa: E402
from formbook.session import local_session  # noqa: E402

HEADLINE = (
    "expected_metrics",
    "historical_comparables",
    "threshold_report",
    "threshold_sweep",
    "rolling_form",
    "rolling_allowed_fourth",
    "weekly_quantile_points",
    "summary_stats",
    "correlation_matrix",
    "points_from_list",
    "ols_interaction",
    "matchups_union_distinct",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1").rstrip("/")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), app="formbook-bench")
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.registered()

    def timed(name: str, where: str) -> float:
        start = time.perf_counter()
        queries[name](spark, where).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name in HEADLINE:
        timed(name, folder)
        seconds[name] = round(min(timed(name, folder) for _ in range(runs)), 3)
    spark.stop()
    result = {
        "metric": "headline_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(folder).removeprefix("sf"),
    }
    print(json.dumps(result))


if __name__ == "__main__":
    main()
