"""Physical plans: no products, no Python, and filters at the scan."""

from __future__ import annotations

import re

import pytest
from conftest import TESTDATA
from pyspark.sql import functions as F

from paddock.operators import results
from paddock.operators.ranking import rank_bounded, season_ids
from paddock.plans import registry
from paddock.schema import UNIQUE_KEYS
from paddock.sources import tables, testdata

UNWANTED = ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "PythonUDF")
STREAMS = {"stream_report_gate", "stream_response_gate", "stream_notifications", "stream_report_numbers"}


def plan(frame) -> str:
    return frame._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in STREAMS])
def test_no_products_and_no_python(spark, name):
    shown = plan(registry.queries()[name](spark, TESTDATA))
    assert not [bad for bad in UNWANTED if bad in shown]
    assert "_block" not in shown, "a product by blocks is a product"
    # one row comes of one task: the list of seasons, and each table's count
    single = shown.count("SinglePartition")
    assert single <= shown.count("collect_set(id") // 2 or name == "load_league"


class Jobs:
    """Counts the jobs that begin."""

    def __init__(self, spark) -> None:
        self.tracker = spark.sparkContext.statusTracker()
        self.spark = spark

    def __call__(self, build) -> int:
        group = f"group-{id(self)}"
        self.spark.sparkContext.setJobGroup(group, "")
        build()
        return len(self.tracker.getJobIdsForGroup(group))


#: Queries of sinks, loads and streams, which write as they are built.
KEPT = {name for name in registry.queries() if name.endswith("_kept")}
WRITERS = {*STREAMS, *KEPT, "nested_json_sink", "load_league", "lookup"}


@pytest.mark.parametrize("name", [n for n in registry.queries() if n not in WRITERS])
def test_building_a_query_starts_no_job(spark, name):
    testdata.league(spark, TESTDATA).tables()  # the fixture is written once
    schemas = 2 if name in registry.TABLE_QUERIES else 0  # Spark reads a given file's schema in a job
    assert Jobs(spark)(lambda: registry.queries()[name](spark, TESTDATA)) <= schemas


# Exchanges planned without broadcasts and before any is reused: a guard against more.
EXCHANGES = {"incident_reports": 15, "driver_standings": 27, "dq_orphans": 9, "penalty_points_table": 16}


@pytest.mark.parametrize("name", EXCHANGES)
def test_exchanges_without_broadcasts(spark, name):
    testdata.league(spark, TESTDATA).tables()
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(registry.queries()[name](spark, TESTDATA))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shown.count("Exchange ") <= EXCHANGES[name]


def test_targets_deal_the_line_items_by_order_once(spark):
    """the pairs, the last supplier of an order and the join are dealt alike; penalties and responses join nothing."""
    source = testdata._Folder(spark, TESTDATA)
    league = testdata.league(spark, TESTDATA)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        shown = plan(testdata._targets(source, league.reports))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert shown.count("Exchange ") <= 3
    for table in (league.penalties, league.report_responses):
        assert all("/report_targets-" in f for f in table.inputFiles())


def test_scans_read_only_needed_columns(spark):
    shown = plan(results.race_wins(testdata.league(spark, TESTDATA)))
    assert "plus_laps" not in shown and "content" not in shown


def test_season_filter_reaches_the_scan(spark):
    league = tables.of_season(testdata.league(spark, TESTDATA), "Season 1998")
    assert "EqualTo(name,Season 1998)" in plan(results.race_classification(league))


def test_skewed_join_is_split(spark):
    """A join whose one key holds most rows is cut into pieces while it runs."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "20000",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        entries = spark.range(200_000, numPartitions=8).select(
            F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 50).alias("race_id"), F.col("id").alias("driver_id")
        )
        races = spark.range(50).select(F.col("id").alias("race_id"), (F.col("id") % 3).alias("season_id"))
        joined = entries.join(races, "race_id").groupBy("season_id").agg(F.sum("driver_id").alias("total"))
        assert sum(r.total for r in joined.collect()) == 200_000 * 199_999 // 2
        assert "skew=true" in plan(joined)
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_top_places_need_no_full_sort(spark):
    rows = testdata.league(spark, TESTDATA).races_drivers
    first = rank_bounded(rows, ["race_id"], [F.col("time").asc_nulls_last(), F.col("driver_id").asc()], "rank")
    assert "WindowGroupLimit" in plan(first.filter("rank <= 10"))


def test_list_of_seasons(spark):
    seasons = testdata.league(spark, TESTDATA).seasons
    rows = spark.range(1).select(season_ids(seasons).alias("ids")).first().ids
    assert rows == sorted(r.id for r in seasons.collect())


def test_json_sink_is_compressed(spark, tmp_path):
    """F8: the text lines are gzip files, which readers open as they are; plain text is a choice."""
    rows = spark.range(3).select("id", F.lit(None).cast("string").alias("none"))
    tables.write_json(rows, str(tmp_path / "a"))
    tables.write_json(rows, str(tmp_path / "b"), compression="none")
    assert list((tmp_path / "a").glob("*.json.gz")) and list((tmp_path / "b").glob("*.json"))
    for path in ("a", "b"):
        assert spark.read.schema(rows.schema).json(str(tmp_path / path)).count() == 3


def test_keys_are_counted_where_they_are_dealt(spark):
    league = testdata.league(spark, TESTDATA)
    shown = plan(registry.queries()["dq_duplicate_keys"](spark, TESTDATA))
    assert "REPARTITION_BY_NUM" in shown and "ENSURE_REQUIREMENTS" not in shown
    kinds = {tuple(getattr(league, t).schema[c].dataType.simpleString() for c in k) for t, ks in UNIQUE_KEYS.items() for k in ks}
    assert shown.count("REPARTITION_BY_NUM") == len(kinds)


def test_entries_are_summed_where_they_are_dealt(spark):
    shown = plan(testdata._entries(testdata._Folder(spark, TESTDATA)))
    summed = shown[shown.index("partial_sum(l_partkey") :]
    assert summed.index("REPARTITION_BY_NUM") < summed.index("Scan parquet")
    # the fastest lap takes no second grouping by race and driver: the sums' two steps are all
    assert len(re.findall(r"HashAggregate\(keys=\[race_id#\d+, driver_id#", shown)) == 2
