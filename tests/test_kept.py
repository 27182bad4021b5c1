"""Tables kept in parts: a change touches its own parts only, whole or not at all, and once."""

from __future__ import annotations

import glob
import os
import re

import golden
import pytest
from pyspark.sql import functions as F

from paddock.operators import championship, ingest, results, upkeep
from paddock.sources.kept import Kept
from paddock.streaming.numbers import Numbers


@pytest.fixture(scope="module")
def league(spark):
    return golden.league(spark)


def rows(frame, *columns):
    return sorted((tuple(r) for r in (frame.select(*columns) if columns else frame).collect()), key=repr)


def files(table):
    return {f: os.stat(f).st_mtime_ns for f in glob.glob(f"{table.path}/rows/part=*/*.parquet")}


def scanned(frame, folder=""):
    """Parts that the scans of a plan under ``folder`` are narrowed to."""
    mode = frame.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    shown = frame._jdf.queryExecution().explainString(mode)
    found = set()
    for scan in shown.split("Scan parquet")[1:]:
        if f"{folder}/rows" in scan.split("\n\n")[0]:
            filters = re.search(r"PartitionFilters: \[(.*)\]", scan.split("\n\n")[0])
            assert filters, "every part is read"
            found |= {int(k) for k in re.findall(r"\b\d+\b(?!#)", re.sub(r"part#\d+", "", filters[1]))}
    return found


def parts_of(names):
    return {int(f.split("part=")[1].split("/")[0]) for f in names}


@pytest.fixture
def table(spark, tmp_path):
    names = spark.range(200).select(F.col("id").cast("string").alias("id"), F.concat(F.lit("n"), "id").alias("name"))
    return Kept(str(tmp_path / "t"), names.schema, ["id"], 16).create(names)


def changes(spark, *records):
    return spark.createDataFrame(records, "id string, name string, op string, seq int")


def test_only_named_parts_are_replaced(spark, table):
    before = files(table)
    feed = changes(spark, ("7", "new", "update", 1), ("x", "added", "insert", 1), (None, "y", "insert", 1))
    named = set(table.touched(feed.filter("id IS NOT NULL")))
    assert upkeep.change_kept(table, feed, "first")
    after = files(table)
    assert {f: t for f, t in before.items() if f in after} == {f: t for f, t in before.items() if parts_of([f]).isdisjoint(named)}
    assert parts_of(set(after) - set(before)) == named
    found = dict(rows(table.read(spark)))
    assert len(found) == 201 and found["7"] == "new" and found["x"] == "added"
    # only these parts are read
    assert scanned(table.read(spark, sorted(named))) == named


def test_a_replay_changes_nothing(spark, table):
    feed = changes(spark, ("7", None, "delete", 1))
    assert upkeep.change_kept(table, feed, "first")
    once = files(table)
    assert not upkeep.change_kept(table, feed, "first")
    assert files(table) == once and table.applied(spark) == {"first"}
    assert upkeep.change_kept(table, feed, "second") and table.read(spark).count() == 199


def test_a_part_may_become_empty(spark, tmp_path):
    names = spark.createDataFrame([("a", "x")], "id string, name string")
    table = Kept(str(tmp_path / "t"), names.schema, ["id"], 4).create(names)
    upkeep.change_kept(table, changes(spark, ("a", None, "delete", 1)), "gone")
    assert table.read(spark).count() == 0
    upkeep.change_kept(table, changes(spark, ("a", "back", "insert", 1)), "back")
    assert rows(table.read(spark)) == [("a", "back")]


def test_a_failed_write_leaves_the_old_parts(spark, table):
    before, was = files(table), rows(table.read(spark))
    broken = F.when(F.col("id") >= "0", F.raise_error(F.lit("disk full"))).otherwise(F.col("name"))
    with pytest.raises(Exception, match="disk full"):
        table.merge(changes(spark, ("7", "new", "update", 1)), lambda old: old.withColumn("name", broken.cast("string")), "first")
    assert files(table) == before and rows(table.read(spark)) == was and not table.applied(spark)


def test_a_change_is_written_once_and_rows_that_stay_are_not_dealt_anew(spark, table):
    """no copy of the parts lies beside the table, and of the old rows only the replaced ones go through a shuffle."""
    before = rows(table.read(spark))
    feed = spark.createDataFrame([("7", "new"), ("7", "newer")], "id string, name string")
    ids = feed.select("id").distinct()
    seen = []

    def stays(old):
        seen.append(old.join(F.broadcast(ids), "id", "left_anti"))
        return seen[0]

    assert table.merge(ids, lambda old: feed, "first", stays=stays)
    assert os.listdir(table.path) and not os.path.exists(f"{table.path}/staged")
    assert rows(table.read(spark)) == sorted([r for r in before if r[0] != "7"] + [("7", "new"), ("7", "newer")], key=repr)
    assert "rebalance" not in seen[0]._jdf.queryExecution().optimizedPlan().toString().lower()
    assert table.merge(ids, lambda old: feed.limit(0), stays=lambda old: old.join(F.broadcast(ids), "id", "left_anti"))
    assert rows(table.read(spark)) == [r for r in before if r[0] != "7"]


def test_kept_penalties_need_no_report(spark, league, tmp_path):
    """penalties kept by race are added up without the table of reports."""
    kept = upkeep.Standings.at(str(tmp_path / "s"), league, 4).create(league)
    races = league.races.select(F.col("id").alias("race_id"))
    totals = results.penalty_time_totals(kept.of_races(races, league))
    assert rows(totals) == rows(results.penalty_time_totals(league))
    plan = totals._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1  # with the races asked for


def test_standings_after_results_and_verdicts(spark, league, tmp_path):
    kept = upkeep.Standings.at(str(tmp_path / "s"), league, 8).create(league)
    standing = files(kept.scores)
    payloads = spark.createDataFrame(
        [("feature", ("d2", "80:00.000"), [("d1", "+1", 0), ("d3", "+2", 1)], "d3")],
        "race_id string, leader struct<id string, time string>,"
        " otherDrivers array<struct<id string, time string, plusLaps int>>, fastestLap string",
    )
    snapshot, _ = ingest.ingest_results(league.races_drivers, ingest.result_records(payloads))
    assert kept.post_entries(snapshot.filter("race_id = 'feature'"), league, "results")
    verdicts = spark.createDataFrame(
        [("p2", "ruling", [("d2", 5, 1, False), ("d3", None, 2, True)], 1)],
        "report_id string, content string,"
        " penalties array<struct<driverID string, time int, penaltyPoints int, isDSQ boolean>>, seq int",
    )
    decided = ingest.apply_verdicts(league.reports, league.penalties, snapshot, verdicts)
    now = league.replacing(races_drivers=decided.entries, penalties=decided.penalties, reports=decided.reports)
    new = upkeep.penalties_by_race(now).join(league.penalties, ["report_id", "driver_id"], "left_anti")
    assert kept.post_penalties(new, league, "verdicts")

    as_of = "2030-01-01 00:00:00"
    assert rows(kept.driver_standings_long(now, as_of)) == rows(championship.driver_standings_long(now, as_of))
    assert rows(kept.constructor_standings(now)) == rows(championship.constructor_standings(now))
    assert rows(kept.driver_standings_long(now, as_of)) != rows(championship.driver_standings_long(league, as_of))
    # the other races' scores are the files that were there, and only the touched race's part is read
    touched = set(kept.scores.touched(spark.createDataFrame([("feature",)], "race_id string")))
    assert parts_of(set(files(kept.scores)) ^ set(standing)) == touched
    some = kept.of_races(spark.createDataFrame([("feature",)], "race_id string"), league)
    assert scanned(some.races_drivers, "entries") == touched == scanned(some.penalties, "penalties")


def test_numbers_read_their_own_minutes(spark, league, tmp_path):
    index = Numbers(str(tmp_path / "n"), league.reports.schema, 8).create(spark)
    undated = league.reports.filter("id = 'p1'").selectExpr("'p0' AS id", "race_id", "from_driver", "content", "video_path", "verdict", "CAST(NULL AS TIMESTAMP_NTZ) AS created_at")
    reports = league.reports.unionAll(undated)
    batches = [reports.filter("id < 'p3'"), reports.filter("id >= 'p3'"), reports.filter("id IN ('p1', 'p0', 'p5')")]
    for k, batch in enumerate(batches):
        index.add(batch, k)
        index.add(batch, k)  # a repeated batch counts once
    from paddock.operators.stewarding import numbered_reports

    asked = reports.select("id", "race_id", "created_at")
    assert rows(index.of(asked), "id", "rank") == rows(numbered_reports(asked), "id", "rank")
    one = index.of(asked.filter("id = 'p5'"))
    minutes = set(index.members.touched(asked.filter("id = 'p5'").selectExpr("race_id", "date_trunc('minute', created_at)::timestamp_ntz AS minute")))
    races = set(index.counts.touched(asked.filter("id = 'p5'")))
    assert scanned(one, "members") == minutes and scanned(one, "counts") == races
