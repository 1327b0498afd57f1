"""Time headline queries and print one JSON line.

Each query is run once to warm up and then timed; the result is fully
computed and discarded.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from meterbook.queries.registry import load  # noqa: E402
from meterbook.session import local_session  # noqa: E402

HEADLINE = [
    "claude_responses",
    "price_responses",
    "session_usage",
    "turn_usage",
    "ledger_row",
    "merge_ledger",
    "combine_ledgers",
    "codex_model_carry",
    "codex_turns",
    "opencode_tree",
    "source_fingerprint",
    "usage_summary",
    "period_comparison",
    "project_summary",
    "spend_heatmap",
    "spend_by_day_family",
    "project_family_matrix",
    "token_traffic",
    "robust_scale",
    "session_day_segments",
    "month_bands",
    "concurrency_clusters",
    "velocity_scale",
    "health_report",
    "capture_health",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    names = sys.argv[1:] or HEADLINE
    spark = local_session("meterbook-bench", cpus)
    spark.sparkContext.setLogLevel("ERROR")
    registered = load()
    times: dict[str, float] = {}

    def once(name: str) -> float:
        began = time.perf_counter()
        registered[name].run(spark, folder).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, total wall time",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
