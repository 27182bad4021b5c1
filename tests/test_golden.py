"""Expected tables of the hand-written league, worked out by hand."""

from __future__ import annotations

import json

import golden
import pytest
from pyspark.sql import functions as F

from paddock.operators import championship, members, quality, results, season, stewarding
from paddock.operators.ranking import in_every_season
from paddock.sources import tables


@pytest.fixture(scope="module")
def league(spark):
    return golden.league(spark)


def as_dict(rows, keys, values):
    found = {}
    for r in rows.collect():
        key = tuple(r[k] for k in keys) if len(keys) > 1 else r[keys[0]]
        assert key not in found
        found[key] = tuple(r[v] for v in values) if len(values) > 1 else r[values[0]]
    return found


def test_classification(league):
    rows = as_dict(results.race_classification(league), ["race_id", "driver_id"], ["time", "rank"])
    # level times rank by driver; no time after times; disqualified next; unknown flag last
    assert rows["feature", "d1"] == (5005.0, 1)
    assert rows["feature", "d2"] == (5005.0, 2)
    assert rows["feature", "d4"] == (None, 3)
    assert rows["feature", "d3"] == (4990.0, 4)
    assert rows["feature", "d6"] == (5010.0, 5)
    assert rows["sprint", "d5"] == (1499.75, 1)
    assert rows["future", "d1"] == (None, 1)


def test_points(league):
    rows = as_dict(results.entry_points(league), ["race_id", "driver_id"], ["points"])
    assert rows["feature", "d1"] == 25
    assert rows["feature", "d2"] == 18 + 1
    assert rows["feature", "d3"] == 0
    assert rows["feature", "d4"] == 0
    assert rows["feature", "d6"] == 10
    assert rows["sprint", "d5"] == 8, "no bonus in a sprint"
    assert rows["future", "d1"] == 0


def test_wins(league):
    assert as_dict(results.race_wins(league), ["driver_id"], ["wins_count"]) == {"d1": 1, "d5": 1}
    compat = as_dict(results.race_wins(league, pg_compat=True), ["driver_id"], ["wins_count"])
    assert compat == {"d1": 2, "d5": 1}, "the future race counts as a win there"


def test_driver_standings_long(league):
    rows = championship.driver_standings_long(league, golden.AS_OF).collect()
    assert len(rows) == 5 * 3
    by_driver = {r.driver_id: r for r in rows}
    assert {d: r.points_total for d, r in by_driver.items()} == {"d1": 32, "d2": 19, "d3": 6, "d4": 0, "d5": 8}
    assert {d: r.position for d, r in by_driver.items()} == {"d1": 1, "d2": 2, "d5": 3, "d3": 4, "d4": 5}
    assert {r.race_count for r in rows} == {3}
    assert {r.race_id: r.race_no for r in rows} == {"sprint": 1, "feature": 2, "future": 3}
    assert {r.race_id: r.has_been_raced for r in rows} == {"sprint": True, "feature": True, "future": False}


def test_phantom_win_only_in_compat(league):
    def wins(compat):
        rows = championship.driver_standings_long(league, golden.AS_OF, pg_compat=compat)
        return as_dict(rows.select("driver_id", "wins_count").distinct(), ["driver_id"], ["wins_count"])

    assert wins(False)["d1"] == 1
    assert wins(True)["d1"] == 2


def test_nested_standings_and_cells(league):
    rows = {r.driver_id: r for r in championship.driver_standings(league, golden.AS_OF).collect()}
    assert [c["rank"] for c in rows["d3"].races] == ["3", "DSQ", "DNS"]
    assert [c["rank"] for c in rows["d4"].races] == ["DNS", "DNF", "DNS"]
    assert [(c["rank"], c["points"]) for c in rows["d5"].races] == [("1", 8), ("", None), ("", None)]
    assert [c["rank"] for c in rows["d1"].races] == ["2", "1", "DNF"]


def test_points_tables_are_parameters(league):
    tables = {"feature": (100, 50), "sprint": (7,) * 12}
    long = championship.driver_standings_long(league, golden.AS_OF, **tables)
    points = as_dict(long, ["race_id", "driver_id"], ["points"])
    assert points["feature", "d1"] == 100 and points["feature", "d2"] == 51
    assert {points["sprint", d] for d in ("d1", "d3", "d5")} == {7}
    teams = as_dict(championship.constructor_standings(league, **tables), ["team_id"], ["points"])
    assert teams == {"A": 201 + 14, "B": 0 + 7, "C": 0}


def test_average_position(league):
    rows = as_dict(championship.avg_finish_position(league), ["driver_id"], ["avg_position"])
    assert rows["d1"] == (1 + 2 + 1) / 3
    assert rows["d4"] == 3.0


def test_constructors(league):
    rows = as_dict(championship.constructor_standings(league), ["team_id"], ["points", "rank"])
    # d1 and d2 share first place: 25 + 25 + fastest lap; sprint 8 + 7
    assert rows["A"] == (51 + 15, 1)
    # d6 is fifth of the feature, d3 third of the sprint
    assert rows["B"] == (10 + 6, 2)
    assert rows["C"] == (0, 3)
    compat = as_dict(championship.constructor_standings(league, pg_compat=True), ["team_id"], ["points", "rank"])
    assert compat == {"C": (0, 1), "A": (66, 2), "B": (16, 3)}


def test_penalties(league):
    totals = as_dict(results.penalty_time_totals(league), ["driver_id", "race_id"], ["penalty_time"])
    assert totals == {("d2", "feature"): 5, ("d3", "feature"): None, ("d4", "feature"): 10, ("d1", "feature"): None}
    points = as_dict(championship.penalty_points_by_race(league), ["driver_id", "race_id"], ["points"])
    assert points == {("d2", "feature"): 2, ("d3", "feature"): 3, ("d4", "feature"): 1}
    nested = as_dict(championship.penalty_points_nested(league), ["driver_id"], ["races", "points_total"])
    assert nested["d3"] == ([0, 3, 0], 3)
    assert nested["d5"] == ([0, 0, 0], 0)


def test_race_results(league):
    rows = as_dict(
        results.race_results(league, golden.AS_OF), ["race_id", "driver_id"], ["result_time", "rank", "team_name"]
    )
    assert rows["feature", "d2"] == (5005.0, 2, "Alpha")
    assert rows["feature", "d3"] == (4990.0, 4, "Beta")


def test_gap_sheet(league):
    rows = as_dict(results.race_gap_sheet(league), ["race_id", "driver_id"], ["gap", "fastest_lap_driver_id"])
    assert rows["feature", "d3"] == ("83:10", "d2")
    assert rows["feature", "d2"] == ("+00:10.000", "d2")
    assert rows["feature", "d4"] == ("DNF", "d2")
    assert rows["sprint", "d1"] == ("+00:00.750", "d5")
    assert rows["future", "d1"] == (None, None)


def test_lineup_options(league):
    rows = as_dict(
        results.race_lineup_options(league).filter("driver_id is not null"),
        ["race_id", "driver_id"],
        ["option_team_id", "entered_team_id", "is_picked"],
    )
    assert rows["sprint", "d5"] == (None, "A", True)
    assert rows["feature", "d5"] == (None, None, False)
    assert rows["sprint", "d2"] == ("A", None, False)
    assert ("feature", "d6") not in rows
    teams = {(r.race_id, r.option_team_id) for r in results.race_lineup_options(league).collect() if r.option_team_id}
    assert teams == {(race, team) for race in ("feature", "sprint", "future") for team in "ABC"}
    gamma = results.race_lineup_options(league).filter("option_team_id = 'C' and race_id = 'future'").first()
    assert (gamma.team_name, gamma.race_name, gamma.driver_id, gamma.is_picked) == ("Gamma", "Italian GP", None, None)


def test_proposed_pick_of_an_empty_race(spark, league):
    empty = league.replacing(races_drivers=league.races_drivers.filter("race_id <> 'future'"))
    options = results.race_lineup_options(empty).filter("driver_id is not null")
    rows = as_dict(options, ["race_id", "driver_id"], ["is_picked", "is_empty"])
    assert rows["future", "d1"] == (True, True)
    assert rows["future", "d5"] == (False, True)
    assert rows["feature", "d1"] == (True, False)


def test_report_numbers(league):
    ranks = as_dict(stewarding.report_rank(league), ["report_id"], ["rank"])
    assert ranks == {"p5": 1, "p3": 2, "p1": 3, "p4": 4, "p2": 5, "p6": 6}
    open_ones = as_dict(stewarding.open_reports(league), ["report_id"], ["rank", "targets"])
    assert set(open_ones) == {"p2", "p4", "p5", "p6"}
    assert open_ones["p2"][0] == 5
    assert [tuple(t) for t in open_ones["p2"][1]] == [("hra", "Hra")]


def test_incident_reports(league):
    rows = {r.report_id: r for r in stewarding.incident_reports(league, "league.example").collect()}
    assert len(rows) == 6
    assert [t["target_id"] for t in rows["p3"].targets] == ["d1", "d3"]
    assert [p["driver_id"] for p in rows["p3"].penalties] == ["d1", "d3", "d4"]
    assert [r["content"] for r in rows["p2"].responses] == ["yes", "me too"]
    assert rows["p2"].videos is None and rows["p4"].penalties == []
    assert [tuple(v) for v in rows["p3"].videos] == [(False, "https://medal.tv/games/x/clip/1", True)]
    assert [tuple(v) for v in rows["p1"].videos] == [
        (False, "https://www.youtube.com/embed/abc", True),
        (True, "reports/p1clip.mp4", False),
    ]
    assert {r["id"] for r in rows["p2"].responses} == {"r2", "r3"}


def test_addresses_with_media_in_their_path_are_no_uploads(spark, league):
    path = "https://clips.example/media/7++/media/a.mp4++/mediax/b"
    reports = league.reports.filter("id = 'p1'").selectExpr("id", "race_id", "from_driver", "content", f"'{path}' as video_path", "verdict", "created_at")
    rows = stewarding.video_links(league.replacing(reports=reports), "x").orderBy("video_no").collect()
    assert [(r.is_local, r.url) for r in rows] == [(False, "https://clips.example/media/7"), (True, "a.mp4"), (False, "/mediax/b")]


def test_concerned_drivers(league):
    rows = {tuple(r) for r in stewarding.concerned_drivers(league).filter("report_id in ('p1', 'p2')").collect()}
    assert rows == {
        ("p1", "reporter", "d1", "Driver 1"),
        ("p1", "target", "d2", "Driver 2"),
        ("p2", "reporter", "d2", "Driver 2"),
        ("p2", "target", None, "Hra"),
    }


def test_messages(league):
    feed = {r.report_id: r for r in stewarding.report_notification_feed(league, "https://x.example").collect()}
    link = "https://x.example/seasons/Season%201/A%20b/race/feature/reports?report=3"
    assert feed["p1"].sender == "Driver 1"
    # d2's account is found through the account's own user
    assert feed["p1"].message == (
        "## :be: Belgian GP, Report #3\n*04.05.24 20:00:00*\n\nNa koho: \n- <@222>\n\n"
        f"Viac info [na tomto odkaze]({link})"
    )
    verdicts = {
        r.report_id: r for r in stewarding.report_notification_feed(league, "https://x.example", True).collect()
    }
    assert set(verdicts) == {"p1", "p3"}
    assert "Účastníci:\n- <@111>\n- <@222>\n" in verdicts["p1"].message
    assert "- Driver 4\n- <@111>\n- Driver 3\n" in verdicts["p3"].message


def test_gates(league):
    gated = stewarding.report_gate(league.reports, league.races, league.races_drivers)
    labels = as_dict(gated, ["id"], ["gate"])
    assert labels == {
        "p1": "accepted",
        "p2": "accepted",
        "p3": "accepted",
        "p4": "not_entered",
        "p5": "too_early",
        "p6": "too_late",
    }
    odd = league.reports.selectExpr(
        "id", "if(id = 'p1', 'nowhere', race_id) as race_id", "from_driver", "content", "video_path", "verdict",
        "if(id = 'p3', null, created_at) as created_at",
    )
    doubled = league.races_drivers.unionAll(league.races_drivers)
    labels = as_dict(stewarding.report_gate(odd, league.races, doubled), ["id"], ["gate"])
    assert (labels["p1"], labels["p2"], labels["p3"]) == ("unknown_race", "accepted", "undated")
    undated = league.races.withColumn("date", F.lit(None).cast("timestamp_ntz"))
    assert {r.gate for r in stewarding.report_gate(odd, undated, doubled).collect()} <= {"undated", "unknown_race", "not_entered"}
    taken = gated.filter("gate = 'accepted'")
    rows = stewarding.response_gate(
        league.report_responses, taken, league.races, league.races_drivers, league.report_targets
    )
    labels = as_dict(rows, ["report_id", "from_driver"], ["gate"])
    assert labels == {
        ("p1", "d2"): "accepted",
        ("p2", "d1"): "too_late",
        ("p2", "d2"): "too_late",
        ("p3", "d3"): "accepted",
        ("p4", "d1"): "no_report",
    }


def test_target_may_answer_for_a_day(spark, league):
    late = spark.createDataFrame(
        [("r9", "p2", "d1", "late", None, golden.datetime(2024, 5, 6, 20, 0))], league.report_responses.schema
    )
    taken = league.reports.filter("id = 'p2'")
    targets = spark.createDataFrame([("p2", "d1")], league.report_targets.schema)
    for about, label in ((targets, "accepted"), (league.report_targets, "too_late")):
        gated = stewarding.response_gate(late, taken, league.races, league.races_drivers, about)
        assert [r.gate for r in gated.collect()] == [label]


def test_seasons(league):
    absent = lambda rows: {r.driver_id for r in rows.collect() if r.absent_from == ["s1"]}
    assert absent(season.unrostered_drivers(league)) == {"d6"}
    assert absent(season.available_drivers(league)) == {"d5", "d6"}
    assert [r.driver_id for r in season.one_per_season(season.unrostered_drivers(league)).collect()] == ["d6"]
    lineup = as_dict(season.season_lineup(league), ["team_id"], ["drivers", "is_empty_line_up"])
    assert [d["driver_id"] for d in lineup["A"][0]] == ["d1", "d2"]
    assert lineup["C"] == ([], False)
    assert [r.driver_id for r in season.season_reserves(league).collect()] == ["d5"]
    schedule = [(r.race_no, r.race_id) for r in season.season_schedule(league).orderBy("race_no").collect()]
    assert schedule == [(1, "sprint"), (2, "feature"), (3, "future")]


def test_unknown_reserve_flag_leaves_a_driver_available(spark, league):
    roster = spark.createDataFrame([("d1", "s1", "A", None)], league.seasons_drivers.schema)
    rows = season.available_drivers(league.replacing(seasons_drivers=roster)).collect()
    assert len(rows) == 6


def test_members(league):
    assert [r.user_id for r in members.steward_candidates(league).collect() if r.absent_from] == ["u6"]
    assert [r.user_id for r in members.current_stewards(league).collect()] == ["u6"]
    users = as_dict(members.users_with_roles(league), ["user_id"], ["driver_name", "roles"])
    assert [r["role_name"] for r in users["u6"][1]] == ["Season 1/A bfia", "admin"]
    assert users["u9"] == (None, [])


def test_one_season(league):
    assert championship.driver_standings_long(tables.of_season(league, "nope"), golden.AS_OF).count() == 0
    one = championship.driver_standings_long(tables.of_season(league, "Season 1/A b"), golden.AS_OF)
    every = championship.driver_standings_long(league, golden.AS_OF)
    assert sorted(map(str, one.collect())) == sorted(map(str, every.collect()))
    none = tables.of_season(league, "nope")
    assert stewarding.concerned_drivers(none).count() == stewarding.mention_text(none).count() == 0
    assert quality.dq_orphans(none).count() == 0


def test_season_by_encoded_name(spark, league):
    names = spark.createDataFrame([("Season%201%2FA%20b",), ("Season+1",)], "encoded_name string")
    assert [r.season_id for r in tables.season_by_name(names, league.seasons).collect()] == ["s1"]


def test_every_season_lists_every_row(spark, league):
    seasons = spark.createDataFrame([("s1", "x", None), ("s2", "y", None)], league.seasons.schema)
    rows = in_every_season(league.drivers, seasons).select("season_id", "id").collect()
    assert len(rows) == len(set(rows)) == 12


def test_league_round_trip(spark, league, tmp_path):
    tables.write_league(league, str(tmp_path / "league"))
    back = tables.load_league(spark, str(tmp_path / "league"))
    for name, rows in league.tables().items():
        assert sorted(map(str, rows.collect())) == sorted(map(str, getattr(back, name).collect()))
    assert [r.name for r in tables.lookup(back.drivers, id="d3").collect()] == ["Driver 3"]
    plan = tables.lookup(back.drivers, id="d3")._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(id,d3)" in plan


def test_json_sink(spark, league, tmp_path):
    tables.write_json(championship.driver_standings(league, golden.AS_OF), str(tmp_path / "json"))
    lines = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "json")).collect()]
    assert {x["driver_id"]: len(x["races"]) for x in lines} == {f"d{n}": 3 for n in range(1, 6)}
    assert next(x for x in lines if x["driver_id"] == "d5")["color"] is None
