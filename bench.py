"""Time the headline queries; prints one JSON line.

Each query is planned, run and fetched in full. One untimed pass over the whole list
warms the JVM; the second pass is timed. The two budgets on a stored state are timed without
the write, which is an entry of its own.
"""

from __future__ import annotations

import json
import os
import sys
import time

from thermobox.catalog import BLENDED, GROUND, OVERFLOW, QUERIES, scaled_budget
from thermobox.plans.budget import run_budget
from thermobox.session import fresh_folder, local_session
from thermobox.sources.events_grid import events_state
from thermobox.sources.layout import read_state, write_state

HEADLINE = (
    "harmonise",
    "quality_report",
    "volume_weight_overflow",
    "wall_weight_overflow",
    "domain_mean_t",
    "surface_blend",
    "wall_faces",
    "budget",
    "budget_level",
    "budget_blended",
    "budget_many",
    "constant_t",
    "quantile_residual",
    "mass_direction",
    "hourly_view_24h",
    "daily_view",
)


def on_stored_state(spark, sf_dir: str) -> dict[str, float]:
    """Seconds to write a state and to take two budgets from it."""
    folder, seconds = fresh_folder(spark, "bench"), {}

    def timed(name, work) -> None:
        begin = time.perf_counter()
        work()
        seconds[name] = round(time.perf_counter() - begin, 3)

    timed("write_state", lambda: write_state(events_state(spark, sf_dir), folder, ("sp", "T2m", "u10", "v10")))
    for name, policy in (("budget_from_state", OVERFLOW), ("budget_from_state_blended", BLENDED)):
        timed(name, lambda: scaled_budget(run_budget(read_state(spark, folder), GROUND, policy)).collect())
    return seconds


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cpus, app="bench", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for timed in (False, True):
        for name in HEADLINE:
            begin = time.perf_counter()
            QUERIES[name](spark, sf_dir).collect()
            if timed:
                seconds[name] = round(time.perf_counter() - begin, 3)
        stored = on_stored_state(spark, sf_dir)
    seconds |= stored
    spark.stop()
    print(json.dumps({
        "metric": "headline_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))


if __name__ == "__main__":
    sys.exit(main())
