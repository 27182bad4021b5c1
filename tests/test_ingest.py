from __future__ import annotations

from datetime import datetime

import golden
import pytest

from paddock.operators import ingest, quality
from paddock.sources import tables


@pytest.fixture(scope="module")
def league(spark):
    return golden.league(spark)


def rows(frame, *columns):
    return sorted((tuple(r) for r in (frame.select(*columns) if columns else frame).collect()), key=repr)


def test_schedule(spark, league):
    payloads = spark.createDataFrame(
        [
            (
                "Season 1/A b",
                [
                    ("t1", "2024-08-01T20:00", True),
                    ("t2", "2024-12-01T20:00", False),
                    ("t2", "2024-05-04T18:00", True),
                    ("t2", "soon", False),
                    ("t1", "2024-09-01T20:00", False),
                    ("t2", "2024-09-01T20:00", False),
                    ("t7", "2024-10-01T20:00", False),
                ],
            ),
            ("Season 9", [("t1", "2024-08-01T20:00", False)]),
        ],
        "season_name string, races array<struct<trackID string, timestamp string, hasSprint boolean>>",
    )
    new, rejected = ingest.ingest_schedule(ingest.schedule_records(payloads), league.seasons, league.races, league.tracks)
    assert rows(new, "date", "is_sprint", "track_id") == [
        (datetime(2024, 12, 1, 19, 0), False, "t2"),
        (datetime(2024, 8, 1, 18, 0), False, "t1"),
        (datetime(2024, 8, 1, 18, 0), True, "t1"),
    ]
    assert rows(new, "id")[-1] == ("s1-202412011900",)
    assert rows(rejected, "timestamp", "is_sprint", "reason") == [
        ("2024-05-04T18:00", False, "two races at one time"),
        ("2024-05-04T18:00", True, "two races at one time"),
        ("2024-08-01T20:00", False, "unknown season"),
        ("2024-09-01T20:00", False, "two races at one time"),
        ("2024-09-01T20:00", False, "two races at one time"),
        ("2024-10-01T20:00", False, "unknown track"),
        ("soon", False, "unreadable start"),
    ]


def test_results(spark, league):
    payloads = spark.createDataFrame(
        [("feature", ("d1", "83:05.500"), [("d2", "+1,25", 0), ("d4", "DNF", 2), ("d3", "oops", 0), ("d5", "+3", 0), ("d6", "+7", 0), ("d6", "+8", 0)], "d4")],
        "race_id string, leader struct<id string, time string>,"
        " otherDrivers array<struct<id string, time string, plusLaps int>>, fastestLap string",
    )
    snapshot, rejected = ingest.ingest_results(league.races_drivers, ingest.result_records(payloads))
    found = {(r.race_id, r.driver_id): r for r in snapshot.collect()}
    assert len(found) == len(golden.ROWS["races_drivers"])
    assert found["feature", "d1"].time == 4985.5 and found["feature", "d1"].plus_laps == 0
    assert found["feature", "d2"].time == 4986.75 and not found["feature", "d2"].has_fastest_lap
    assert found["feature", "d4"].time is None and found["feature", "d4"].has_fastest_lap
    assert found["feature", "d4"].plus_laps == 2
    assert found["feature", "d3"].time == 4990.0
    assert found["sprint", "d5"].has_fastest_lap
    assert found["feature", "d6"].time == 5010.0
    assert rows(rejected) == [
        ("feature", "d3", "oops", "unreadable gap"),
        ("feature", "d5", "+3", "not entered"),
        ("feature", "d6", "+7", "posted twice"),
        ("feature", "d6", "+8", "posted twice"),
    ]


RESULTS = "race_id string, driver_id string, time string, plus_laps int, is_leader boolean, fastest_lap_driver string"


@pytest.mark.parametrize(
    ("records", "reason"),
    [
        ([("feature", "d5", "80:00.000", None, True, "d1"), ("feature", "d1", "+1", 0, False, "d1")], "no leader time"),
        ([("feature", "d1", "80:00.000", None, True, "d1"), ("feature", "d2", "80:01.000", None, True, "d1")], "not one leader"),
        ([("feature", "d1", "+1", 0, False, "d1")], "not one leader"),
        ([("feature", "d1", "80:00.000", None, True, "d5")], "fastest lap not entered"),
        ([("feature", "d1", "80:00.000", None, True, "d1")] * 2, "posted twice"),
    ],
)
def test_races_are_refused_whole(spark, league, records, reason):
    snapshot, rejected = ingest.ingest_results(league.races_drivers, spark.createDataFrame(records, RESULTS))
    assert rows(snapshot) == rows(league.races_drivers)
    assert rejected.count() == len(records)
    assert reason in {r.reason for r in rejected.collect()}


def test_replace_entries(spark, league):
    payloads = spark.createDataFrame(
        [
            ("future", [("A", ["d1"]), ("B", ["d3", "d4"])]),
            ("sprint", [("A", ["d1", "d2"]), ("B", ["d2"])]),
        ],
        "race_id string, teams array<struct<teamID string, drivers array<string>>>",
    )
    lists = ingest.flatten_teams(payloads, "race_id")
    snapshot, rejected = ingest.replace_race_entries(league.races_drivers, lists)
    assert rows(snapshot.filter("race_id = 'future'"), "driver_id", "team_id") == [("d1", "A"), ("d3", "B"), ("d4", "B")]
    assert snapshot.filter("race_id = 'sprint'").count() == 3
    assert snapshot.filter("race_id = 'feature'").count() == 5
    assert rows(quality.dq_driver_two_teams(lists)) == [("sprint", "d2", 2)]
    assert rows(rejected) == [
        ("sprint", "A", "d1", "race refused", 1),
        ("sprint", "A", "d2", "listed twice", 1),
        ("sprint", "B", "d2", "listed twice", 1),
    ]


def test_replaced_partitions_leave_the_others(spark, league, tmp_path):
    path = str(tmp_path / "entries")
    tables.replace_partitions(league.races_drivers, path, "race_id")
    lists = spark.createDataFrame([("future", "d4", "B")], "race_id string, driver_id string, team_id string")
    snapshot, _ = ingest.replace_race_entries(league.races_drivers, lists)
    tables.replace_partitions(snapshot.filter("race_id = 'future'"), path, "race_id")
    back = spark.read.parquet(path)
    assert rows(back.filter("race_id = 'future'"), "driver_id") == [("d4",)]
    assert back.filter("race_id <> 'future'").count() == 8


def test_team_pairs(spark):
    payloads = spark.createDataFrame(
        [("s1", [("A", ["d1", "d2"]), ("B", ["d3", "d4"])])],
        "season_id string, teams array<struct<teamID string, drivers array<string>>>",
    )
    assert rows(ingest.flatten_team_pairs(payloads)) == [
        ("d1", "s1", "A"),
        ("d2", "s1", "A"),
        ("d3", "s1", "B"),
        ("d4", "s1", "B"),
    ]


def test_reserves(spark, league):
    asked = spark.createDataFrame(
        [("Season 1/A b", d) for d in ("d1", "d6", "d7", "d7")] + [("Season 9", "d6")], "season_name string, driver_id string"
    )
    new, rejected = ingest.add_reserves(league.seasons_drivers, asked, league.seasons)
    assert rows(new) == [("d6", "s1", None, True)]
    assert rows(rejected, "driver_id", "reason", "copies") == [
        ("d1", "already in season", 1),
        ("d6", "unknown season", 1),
        ("d7", "posted twice", 2),
    ]


def test_lineup(spark, league):
    season = "Season 1/A b"
    changes = spark.createDataFrame(
        [
            (season, "d1", None, 1),
            (season, "d5", "A", 2),
            (season, "d6", "C", 3),
            (season, "d3", "A", 4),
            (season, "d3", "C", 5),
            (season, "d9", None, 6),
            ("Season 9", "d1", "B", 7),
        ],
        "season_name string, driver_id string, team_id string, seq int",
    )
    snapshot, rejected = ingest.upsert_lineup(league.seasons_drivers, changes, league.seasons)
    assert rows(snapshot, "driver_id", "team_id", "is_reserve") == [
        ("d1", None, True),
        ("d2", "A", False),
        ("d3", "C", False),
        ("d4", "B", False),
        ("d5", "A", False),
        ("d6", "C", False),
    ]
    assert rows(rejected, "driver_id", "reason") == [("d1", "unknown season"), ("d9", "not in season")]


def test_verdicts(spark, league):
    verdicts = spark.createDataFrame(
        [
            ("p2", "first", [("d1", 5, 1, True), ("d2", None, 0, False), ("d1", 9, 9, False)], 1),
            ("p2", "second", [], 2),
            ("p2", "rival", [("d4", 5, 1, True)], 1),
            ("p1", "again", [("d4", 5, 1, True)], 1),
            ("p4", "nothing", [], 1),
            ("p9", "nowhere", [], 1),
        ],
        "report_id string, content string,"
        " penalties array<struct<driverID string, time int, penaltyPoints int, isDSQ boolean>>, seq int",
    )
    state = (league.reports, league.penalties, league.races_drivers)
    found = ingest.apply_verdicts(*state, verdicts)
    assert dict(rows(found.reports, "id", "verdict")) == {
        "p1": "5 s", "p2": "first", "p3": "points", "p4": "nothing", "p5": None, "p6": None,
    }
    assert rows(found.penalties.filter("report_id = 'p2'"), "driver_id", "time", "is_dsq") == [("d1", 5, True), ("d2", None, False)]
    assert rows(found.entries.filter("is_dsq"), "race_id", "driver_id") == [("feature", "d1"), ("feature", "d3")]
    assert rows(found.rejected, "report_id", "content", "reason", "copies") == [
        ("p1", "again", "already decided", 1),
        ("p2", "rival", "not the first", 1),
        ("p2", "second", "not the first", 1),
        ("p9", "nowhere", "unknown report", 1),
    ]
    assert rows(found.rejected_penalties, "driver_id", "time", "reason") == [("d1", 9, "second penalty")]
    # sent twice in one feed, or again later, nothing changes
    twice = ingest.apply_verdicts(*state, verdicts.unionAll(verdicts))
    again = ingest.apply_verdicts(*found[:3], verdicts)
    for other in (twice, again):
        assert [rows(a) for a in other[:3]] == [rows(b) for b in found[:3]]
    assert sum(r.copies for r in twice.rejected.collect()) == 12 - 2
    assert sum(r.copies for r in again.rejected.collect()) == 6


def test_new_reports_and_responses(spark, league):
    sent = spark.createDataFrame(
        [
            ("n1", "feature", "u1", "text", ["d2", "hra"], ["x", "y"], golden.START),
            ("n1", "feature", "u1", "text", ["d2", "hra"], ["x", "y"], golden.START),
            ("n2", "feature", "u7", "text", ["d2"], [], golden.START),
            ("n3", "feature", "u9", "text", ["d2"], [], golden.START),
            ("p1", "feature", "u1", "text", ["d2"], [], golden.START),
        ],
        "id string, race_id string, user_id string, content string, targets array<string>,"
        " videos array<string>, created_at timestamp_ntz",
    )
    reports, targets, rejected = ingest.append_reports(sent, league.users, league.reports)
    assert rows(reports, "id", "from_driver", "video_path", "verdict") == [("n1", "d1", "x++y", None)]
    assert rows(targets) == [("n1", "d2"), ("n1", None)]
    reasons = [("n1", "sent again", 1), ("n2", "unknown user", 1), ("n3", "no driver", 1), ("p1", "already sent", 1)]
    assert rows(rejected, "id", "reason", "copies") == reasons
    answers = sent.selectExpr("if(id = 'p1', 'n9', 'p1') as report_id", "user_id", "content", "videos", "created_at")
    responses, rejected = ingest.append_responses(answers, league.users, league.reports)
    assert rows(responses, "report_id", "from_driver", "video_path") == [("p1", "d1", "x++y")]
    assert rows(rejected, "report_id", "user_id", "reason", "copies") == [
        ("n9", "u1", "unknown report", 1),
        ("p1", "u1", "sent again", 1),
        ("p1", "u7", "unknown user", 1),
        ("p1", "u9", "no driver", 1),
    ]


def test_role_members(spark, league):
    season = "Season 1/A b"
    members = spark.createDataFrame(
        [(season, "u2"), (season, "u2"), (season, "u7"), ("Season 9", "u1")], "season_name string, user_id string"
    )
    found, rejected = ingest.replace_role_members(league.users_roles, members, league.seasons, league.users)
    assert rows(found, "user_id", "role_id") == [("u1", "r2"), ("u2", "r1"), ("u6", "r2")]
    assert rows(rejected, "user_id", "reason", "copies") == [
        ("u1", "unknown season", 1), ("u2", "sent again", 1), ("u7", "unknown user", 1),
    ]
    nobody = spark.createDataFrame([(season, None)], "season_name string, user_id string")
    found, _ = ingest.replace_role_members(league.users_roles, nobody, league.seasons, league.users)
    assert rows(found, "user_id", "role_id") == [("u1", "r2"), ("u6", "r2")]


def test_changes(spark, league):
    changes = spark.createDataFrame(
        [
            ("d1", "x", "delete", 1, None),
            ("d1", "Back", "insert", 2, None),
            ("d2", "New name", "update", 1, None),
            ("d3", None, "delete", 1, None),
            ("d8", "Fresh", "insert", 1, None),
            ("d9", "Ghost", "update", 1, None),
            ("d4", None, "update", 1, None),
            ("d5", None, "update", 1, ["name"]),
            ("d6", "Mallory", "upsert", 1, None),
            ("d7", None, None, 1, None),
        ],
        "id string, name string, op string, seq int, cleared array<string>",
    )
    found, rejected = ingest.apply_changes(league.drivers, changes, ["id"])
    assert rows(found) == [
        ("d1", "Back"),
        ("d2", "New name"),
        ("d4", "Driver 4"),
        ("d5", None),
        ("d6", "Driver 6"),
        ("d8", "Fresh"),
    ]
    assert rows(rejected, "id", "op", "reason") == [
        ("d6", "upsert", "unknown operation"),
        ("d7", None, "unknown operation"),
        ("d9", "update", "nothing to update"),
    ]
    level = spark.createDataFrame([("d1", n, "update", 1) for n in ("a", "c", "b")], "id string, name string, op string, seq int")
    assert ("d1", "c") in rows(ingest.apply_changes(league.drivers, level, ["id"])[0])


def test_quality(spark, league):
    assert quality.dq_duplicate_keys(league).count() == 0
    doubled = league.replacing(races_drivers=league.races_drivers.unionAll(league.races_drivers))
    assert {r.copies for r in quality.dq_duplicate_keys(doubled).collect()} == {2}
    assert quality.dq_orphans(league).count() == 0
    fewer = league.replacing(drivers=league.drivers.filter("id <> 'd6'"))
    assert rows(quality.dq_orphans(fewer)) == [
        ("races_drivers", "driver_id", "drivers", "d6", 1),
        ("users", "driver_id", "drivers", "d6", 1),
    ]
    long = league.replacing(teams=spark.createDataFrame([("A", "n", "#12345678", "i")], league.teams.schema))
    assert rows(quality.dq_length(long)) == [("teams", "color", "A", 9, 7)]
    assert rows(quality.dq_one_fastest_lap(league.races_drivers)) == []
    excluded = league.races_drivers.selectExpr("race_id", "driver_id", "time", "false as has_fastest_lap", "true as is_dsq")
    assert {r.race_id for r in quality.dq_one_fastest_lap(excluded).collect()} == {"feature", "sprint"}
    assert quality.dq_uuid(league.drivers, "id").count() == 6


def test_every_record_is_accepted_or_rejected(spark, league):
    """Null keys, unknown names and empty lists: what was sent is what was accepted and what was rejected."""
    sent = spark.createDataFrame(
        [("feature", "d1", "80:00.000", None, True, "d1"), ("feature", "d2", "+1", 0, False, "d1")]
        + [(race, driver, "+2", 0, False, None) for race in ("feature", None) for driver in (None, "d3", "nobody")],
        RESULTS,
    )
    snapshot, rejected = ingest.ingest_results(league.races_drivers, sent)
    assert rows(snapshot.filter("race_id = 'feature' AND time > 4800 AND time < 4810"), "driver_id") == [("d2",), ("d3",)]
    reasons = rows(rejected, "race_id", "driver_id", "reason")
    assert len(reasons) + 3 == sent.count()
    assert ("feature", None, "no driver") in reasons and (None, "d3", "no race") in reasons and (None, None, "no race") in reasons

    payloads = spark.createDataFrame(
        [
            ("future", [("A", ["d1", None]), ("B", []), ("C", None), ("Z", ["d2"]), (None, ["d3"])]),
            ("feature", []),
            ("sprint", None),
            (None, [("A", ["d1"])]),
            ("nowhere", [("A", ["d1"]), ("A", ["d1"])]),
        ],
        "race_id string, teams array<struct<teamID string, drivers array<string>>>",
    )
    lists = ingest.flatten_teams(payloads, "race_id", outer=True)
    found, rejected = ingest.replace_race_entries(league.races_drivers, lists, league.races, league.drivers, league.teams)
    assert rows(found.filter("race_id = 'future'"), "team_id", "driver_id") == [("A", "d1"), (None, "d3")]
    assert found.filter("race_id IN ('feature', 'sprint')").count() == 8 and found.filter("race_id IS NULL").count() == 0
    counts = {(r.race_id, r.reason): 0 for r in rejected.collect()}
    for r in rejected.collect():
        counts[r.race_id, r.reason] += r.copies
    assert counts == {
        ("future", "no driver"): 3, ("future", "unknown team"): 1, ("feature", "no driver"): 1, ("sprint", "no driver"): 1,
        (None, "no race"): 1, ("nowhere", "unknown race"): 2,
    }
    assert sum(counts.values()) + 2 == lists.count()

    season = "Season 1/A b"
    asked = spark.createDataFrame([(season, None), (season, None), (None, "d6"), (season, "d6")], "season_name string, driver_id string")
    new, rejected = ingest.add_reserves(league.seasons_drivers, asked, league.seasons)
    assert rows(new, "driver_id") == [("d6",)]
    assert rows(rejected, "driver_id", "reason", "copies") == [("d6", "unknown season", 1), (None, "no driver", 2)]
    changes = asked.selectExpr("season_name", "driver_id", "'A' AS team_id", "1 AS seq")
    found, rejected = ingest.upsert_lineup(league.seasons_drivers, changes, league.seasons)
    assert found.filter("driver_id IS NULL").count() == 0 and found.filter("driver_id = 'd6'").count() == 1
    assert rows(rejected, "driver_id", "reason") == [("d6", "unknown season"), (None, "no driver"), (None, "no driver")]

    empty = spark.createDataFrame(
        [(season, []), (season, None), (None, None)],
        "season_name string, races array<struct<trackID string, timestamp string, hasSprint boolean>>",
    )
    new, rejected = ingest.ingest_schedule(ingest.schedule_records(empty), league.seasons, league.races, league.tracks)
    assert new.count() == 0 and rows(rejected, "reason") == [("no race",), ("no race",), ("unknown season",)]

    reports = [(i, r, "u1", "text", t, [], golden.START) for i, r, t in (
        (None, "feature", ["d2"]), (None, "feature", ["d2"]), ("a", None, ["d2"]), ("b", "nowhere", ["d2"]), ("c", "feature", []),
        ("d", "feature", None), ("e", "feature", ["d2", None]), ("f", "feature", ["hra"]),
    )]
    reports = spark.createDataFrame(
        reports,
        "id string, race_id string, user_id string, content string, targets array<string>, videos array<string>, created_at timestamp_ntz",
    )
    new, targets, rejected = ingest.append_reports(reports, league.users, league.reports, league.races)
    assert rows(new, "id") == [("f",)] and rows(targets) == [("f", None)]
    assert rows(rejected, "id", "reason", "copies") == [
        ("a", "unknown race", 1), ("b", "unknown race", 1), ("c", "no target", 1), ("d", "no target", 1), ("e", "no target", 1),
        (None, "no id", 2),
    ]

    changes = spark.createDataFrame(
        [(None, "x", "insert", 1), (None, "y", "delete", 2), ("d1", "New", "update", 1)], "id string, name string, op string, seq int"
    )
    found, rejected = ingest.apply_changes(league.drivers, changes, ["id"])
    assert found.count() == league.drivers.count() and rows(rejected, "op", "reason") == [("delete", "no key"), ("insert", "no key")]


def test_records_are_dealt_by_key_once(spark):
    """one exchange of keyed records for copies and choice, with the same choice, null keys included."""
    rows = spark.createDataFrame(
        [("a", 2, "x"), ("a", 1, "y"), ("a", 1, "y"), ("b", None, "z"), ("b", 1, "z"), (None, 3, "n"), (None, 2, "n"), (None, 2, "n")],
        "id string, v int, w string",
    )
    for last, expected in ((False, {("a", 1), ("b", None), (None, 2)}), (True, {("a", 2), ("b", 1), (None, 3)})):
        found = ingest._chosen(rows, ["id"], last)
        assert {(r.id, r.v) for r in found.collect() if r.chosen} == expected
        assert sum(r.copies for r in found.collect()) == 8 and found.count() == 6
    keyed = ingest._chosen(rows.filter("id IS NOT NULL"), ["id"])
    shown = keyed._jdf.queryExecution().executedPlan().toString()
    first = [x for x in shown.split("\n") if x.startswith("   :") and "Exchange " in x]
    assert len(first) == 1 and "hashpartitioning(id" in first[0]


def test_results_stay_dealt_by_race_and_driver(spark):
    """what a race says is sent to its records, so they aren't dealt by race."""
    league = golden.league(spark)
    records = spark.createDataFrame(
        [("feature", "d2", "80:00.000", None, True, "d2")],
        "race_id string, driver_id string, time string, plus_laps int, is_leader boolean, fastest_lap_driver string",
    )
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        snapshot, _ = ingest.ingest_results(league.races_drivers, records)
        shown = snapshot._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # only the few rows that a race's records are reduced to
    by_race = [x for x in shown.split("\n") if "Exchange hashpartitioning(race_id" in x and "driver_id" not in x]
    joins = [x for x in shown.split("\n") if "SortMergeJoin [race_id" in x and "driver" not in x]
    assert not joins and by_race
