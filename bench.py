"""Time the headline queries and print one JSON line.

The league's tables are derived first, once, as a load step of its own; each query then runs
once to warm up and three times for the median.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from paddock import session
from paddock.plans import registry
from paddock.sources import testdata

HEADLINES = (
    "race_classification",
    "race_results",
    "driver_race_points",
    "driver_standings_long",
    "driver_standings",
    "constructor_standings",
    "penalty_points_table",
    "race_wins",
    "race_gap_sheet",
    "race_lineup_options",
    "report_rank",
    "open_reports",
    "incident_reports",
    "report_notification_feed",
    "unrostered_drivers",
    "season_lineup",
    "users_with_roles",
    "ingest_results",
    "apply_verdicts_entries",
    "apply_changes",
    "report_gate",
    "response_gate",
    "video_links",
    "parse_gap",
)


def timed(work) -> float:
    start = time.perf_counter()
    work()
    return time.perf_counter() - start


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session.build(
        f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "8g"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()

    def run(name: str) -> None:
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()

    load = timed(lambda: testdata.league(spark, folder).tables())
    seconds = {}
    for name in HEADLINES:
        run(name)
        seconds[name] = round(statistics.median(timed(lambda: run(name)) for _ in range(3)), 3)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of medians",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "load_sec": round(load, 3),
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
