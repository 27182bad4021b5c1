"""Streams give what the batch gates give, in one micro-batch or many, whatever the order of arrival."""

from __future__ import annotations

import random
from datetime import timedelta
from pathlib import Path

import golden
import pytest
from pyspark.sql import functions as F

from paddock.operators.stewarding import report_gate, response_gate, response_label
from paddock.session import store
from paddock.streaming import gates, notifications


@pytest.fixture(scope="module")
def league(spark):
    return golden.league(spark)


def pairs(frame, *columns):
    return sorted(map(tuple, frame.select(*columns).collect()))


def labels(frame):
    return pairs(frame, "id", "gate")


@pytest.mark.parametrize(("runs", "newest_first"), [(1, True), (3, False), (5, True)])
def test_report_gate(spark, league, tmp_path, runs, newest_first):
    inbox, out, state = (str(tmp_path / x) for x in ("inbox", "out", "state"))
    more = ["id", "race_id", "from_driver", "content", "video_path", "verdict", "created_at"]
    odd = league.reports.filter("id = 'p1'").selectExpr("'p9' AS id", "'nowhere' AS race_id", *more[2:])
    undated = league.reports.filter("id = 'p2'").selectExpr("'p8' AS id", *more[1:-1], "CAST(NULL AS TIMESTAMP_NTZ) AS created_at")
    reports = league.reports.unionAll(odd).unionAll(undated).cache()
    rows = sorted(reports.collect(), key=lambda r: (r.created_at is None, r.created_at), reverse=newest_first)
    rows += [r for r in rows if r.id in ("p6", "p1", "p8")]
    schema, read = reports.schema, 0
    for k in range(runs):
        part = rows[k * len(rows) // runs : (k + 1) * len(rows) // runs]
        spark.createDataFrame(part, schema).repartition(2).write.mode("append").parquet(inbox)
        query = gates.stream_report_gate(gates.read_files(spark, inbox, schema, 1), league, out, state, delay="1 hour")
        query.awaitTermination()
        read += sum(p["numInputRows"] for p in query.recentProgress)
    # each row is read once, whatever the number of runs
    assert read == gates.stored(spark, f"{out}/on_time", schema).count()
    assert read + gates.stored(spark, f"{out}/late", schema).count() == len(rows)
    found = gates.labelled_reports(spark, out, schema).unionByName(gates.late_reports(spark, league, out, schema))
    assert labels(found) == labels(report_gate(reports, league.races, league.races_drivers))

    # a restart from the checkpoint changes nothing
    gates.stream_report_gate(gates.read_files(spark, inbox, schema), league, out, state, delay="1 hour").awaitTermination()
    again = gates.labelled_reports(spark, out, schema).unionByName(gates.late_reports(spark, league, out, schema))
    assert labels(again) == labels(found)


def test_report_gate_forgets_ids_behind_the_watermark(spark, league, tmp_path):
    inbox, out, state = (str(tmp_path / x) for x in ("inbox", "out", "state"))
    one = league.reports.filter("id = 'p1'").first()
    schema, held = league.reports.schema, []
    for k in range(4):
        rows = [(f"r{k}-{i}", *one[1:-1], one.created_at + timedelta(days=30 * k)) for i in range(50)]
        spark.createDataFrame(rows + rows[:5], schema).write.mode("append").parquet(inbox)
        query = gates.stream_report_gate(gates.read_files(spark, inbox, schema), league, out, state, delay="1 day")
        query.awaitTermination()
        held.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    assert max(held) <= 100 and held[-1] <= 50
    assert gates.labelled_reports(spark, out, schema).count() == 200


@pytest.mark.parametrize(("order", "delay"), [(1, "30 days"), (2, "1 hour")])
def test_response_gate(spark, league, tmp_path, order, delay):
    taken = gates.accepted(report_gate(league.reports, league.races, league.races_drivers)).select(*league.reports.columns)
    p1 = [(k, "p1", "d1", k, None, golden.datetime(2024, 5, 4, 20, 0) + timedelta(minutes=m)) for k, m in (("soon", -1), ("days", 4320))]
    p1 += [("none", "nothing", "d1", "none", None, golden.datetime(2024, 5, 4, 20, 0)), ("undated", "p1", "d1", "u", None, None)]
    sent = league.report_responses.unionAll(spark.createDataFrame(p1, league.report_responses.schema))
    inbox, accepted, out, state = (str(tmp_path / x) for x in ("sent", "accepted", "out", "state"))
    random.seed(order)
    responses, reports = sent.collect(), taken.collect()
    random.shuffle(responses)
    random.shuffle(reports)
    for k in range(4):
        rows = responses[k * len(responses) // 3 : (k + 1) * len(responses) // 3]
        known = reports[k * len(reports) // 3 : (k + 1) * len(reports) // 3]
        spark.createDataFrame(rows, sent.schema).write.mode("append").parquet(inbox)
        spark.createDataFrame(known, taken.schema).write.mode("append").parquet(accepted)
        if k == 3:
            for schema, path in ((sent.schema, inbox), (taken.schema, accepted)):
                gates.heartbeat(spark, schema, golden.datetime(2100, 1, 1)).write.mode("append").parquet(path)
        streams = gates.read_files(spark, inbox, sent.schema), gates.read_files(spark, accepted, taken.schema)
        query = gates.stream_response_gate(*streams, lambda: taken, league, out, state, delay=delay)
        query.awaitTermination()
    late = gates.late_responses(spark, taken, league, out, sent.schema)
    assert late.filter("id = 'undated'").count() == 1
    found = gates.labelled_responses(spark, out, sent.schema).unionByName(late)
    batch = response_gate(sent, taken, league.races, league.races_drivers, league.report_targets)
    assert labels(found) == labels(batch)
    # hardly a row is held but the two that moved the clock; each counts twice
    assert sum(s["numRowsTotal"] for s in query.lastProgress["stateOperators"]) <= 6


def test_notifications_wait_for_their_report(spark, league, tmp_path):
    news = [("p1", False), ("p3", True), ("p2", True), ("p9", False)]
    for k, row in enumerate(news):
        spark.createDataFrame([row], "report_id string, is_decision boolean").write.parquet(str(tmp_path / "news" / f"{k}"))
    schema = spark.createDataFrame([news[0]], "report_id string, is_decision boolean").schema
    asked = []

    def tables():
        asked.append(1)
        return league if len(asked) > 1 else league.replacing(reports=league.reports.limit(0))

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "news" / "*"))
    query = notifications.stream_notifications(
        stream, tables, "https://x.example", str(tmp_path / "out"), str(tmp_path / "state")
    )
    query.awaitTermination()
    sent = spark.read.option("recursiveFileLookup", "true").parquet(str(tmp_path / "out" / "sent")).collect()
    # p2 has no verdict to report, and there is no p9
    assert sorted((r.report_id, r.sender) for r in sent) == [("p1", "Driver 1"), ("p3", "FIA")]
    assert {r.rank for r in sent if r.report_id == "p1"} == {3}
    left = notifications.waiting(spark, str(tmp_path / "out"), schema, notifications.last_batch(query) + 1)
    assert pairs(left, "report_id") == [("p2",), ("p9",)]


def test_batches_do_not_grow_with_the_files_of_a_table(spark, tmp_path, monkeypatch):
    """a run of the gate takes as many micro-batches whatever the number of files that reports lie in."""
    from conftest import TESTDATA

    from paddock.plans import registry
    from paddock.sources import testdata

    monkeypatch.setattr(registry, "new_folder", lambda spark, name: str(tmp_path / name))
    league = testdata.league(spark, TESTDATA)
    registry._stream_report_gate(league.replacing(reports=league.reports.repartition(40)))
    assert len(list((tmp_path / "report-out" / "on_time").glob("batch=*"))) <= 6


def test_heartbeat_of_columns_that_are_never_null(spark):
    """a heartbeat holds nulls, whatever the league's rows do."""
    schema = spark.sql("select 'a' as id, 'text' as content, current_timestamp()::timestamp_ntz as created_at").schema
    assert gates.heartbeat(spark, schema, golden.datetime(2100, 1, 1)).first().content is None


def test_response_gate_reads_what_was_accepted(spark, tmp_path, monkeypatch):
    """accepted reports are found once, and what the join holds lies on disk; the session's settings stay."""
    from conftest import TESTDATA

    from paddock.plans import registry
    from paddock.sources import testdata

    monkeypatch.setattr(registry, "new_folder", lambda spark, name: str(tmp_path / name))
    start, seen = gates.stream_response_gate, []
    monkeypatch.setattr(gates, "stream_response_gate", lambda *a: (seen.append(a[2]()), start(*a))[1])
    keys = ["spark.sql.classic.shuffleDependency.fileCleanup.enabled", *gates.STATE]
    before = [spark.conf.get(k, None) for k in keys]
    registry._stream_response_gate(testdata.league(spark, TESTDATA))
    assert before == [spark.conf.get(k, None) for k in keys]
    assert seen and not any(step in frame._jdf.queryExecution().toString() for frame in seen for step in ("Join", "Exchange"))
    logs = [f.read_text() for f in (tmp_path / "response-state/gate/offsets").iterdir() if f.name.isdigit()]
    assert logs and all("RocksDBStateStoreProvider" in log for log in logs)


def shuffled(spark) -> int:
    """Shuffle files of this session."""
    folders = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs()
    return sum(1 for folder in folders for _ in Path(folder.getPath()).rglob("shuffle_*"))


def test_shuffle_files_go_with_their_query(spark):
    """what is stored leaves no shuffle files, whether or not the driver collects its garbage."""
    before = shuffled(spark)
    store(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    assert shuffled(spark) <= before


@pytest.mark.parametrize("few", [0, 10_000])
def test_response_gate_of_few_and_of_many(spark, league, tmp_path, monkeypatch, few):
    """F1: a micro-batch that is sent to the tables is labelled like one that is dealt, also where a report is named by none."""
    monkeypatch.setattr(gates, "FEW", few)
    taken = gates.accepted(report_gate(league.reports, league.races, league.races_drivers)).select(*league.reports.columns)
    odd = [("null", None, "d1", "null", None, golden.datetime(2024, 5, 4, 20, 0)), ("nobody", "p1", None, "x", None, golden.datetime(2024, 5, 4, 20, 0))]
    sent = league.report_responses.unionAll(spark.createDataFrame(odd, league.report_responses.schema))
    inbox, accepted, out, state = (str(tmp_path / x) for x in ("sent", "accepted", "out", "state"))
    for rows, path in ((sent, inbox), (taken.limit(1), accepted)):
        rows.write.parquet(path)
        gates.heartbeat(spark, rows.schema, golden.datetime(2100, 1, 1)).write.mode("append").parquet(path)
    streams = gates.read_files(spark, inbox, sent.schema), gates.read_files(spark, accepted, taken.schema)
    gates.stream_response_gate(*streams, lambda: taken, league, out, state).awaitTermination()
    batch = response_gate(sent, taken, league.races, league.races_drivers, league.report_targets)
    assert labels(gates.labelled_responses(spark, out, sent.schema)) == labels(batch)
    assert {"null": "no_report", "nobody": "not_entered"}.items() <= dict(labels(batch)).items()


def test_responses_without_a_report_are_dealt_for_no_join(spark, league):
    """and only those for which it matters are looked up among the targets."""
    rows = league.report_responses.withColumns({"race_id": F.lit("feature"), "reported_at": F.col("created_at")})
    lost = rows.withColumns({"race_id": F.lit(None).cast("string"), "id": F.lit("lost")})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = response_label(lost, league.races, league.races_drivers, league.report_targets, "UTC")
        shown = found._jdf.queryExecution().optimizedPlan().toString()
        both = response_label(rows.unionByName(lost), league.races, league.races_drivers, league.report_targets, "UTC")
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Join" not in shown
    assert both.filter("gate = 'no_report'").count() == lost.count() and both.count() == 2 * rows.count()
