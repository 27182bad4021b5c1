"""Incoming records turned into new table contents.

Each operator returns new rows or a new snapshot, and the rejected records with a reason; the caller writes
them to a new path. Every record is accepted or rejected. Equal records are one row with their number of ``copies`` among
the rejects, so a record sent again changes nothing and is accounted for.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.text import GAME_ID, join_videos
from paddock.functions.timing import is_valid_gap, local_to_utc, parse_gap, parse_time
from paddock.operators.results import ENTRY

SEAT = ["season_id", "driver_id"]


def _season_ids(seasons: DataFrame) -> DataFrame:
    return seasons.select(F.col("id").alias("season_id"), F.col("name").alias("season_name"))


def _chosen(rows: DataFrame, keys: Sequence[str], last: bool = False) -> DataFrame:
    """Distinct records with ``copies``, and whether each is ``chosen``: the least (or last) of its key.

    The other columns, in their order, decide, so the choice leaves no ties. Records are dealt by key once, for their
    copies and the choice; those with a null in their key, which may be many, are counted before they are shuffled.
    """
    others = [c for c in rows.columns if c not in keys]
    copies = F.count(F.lit(1)).alias("copies")
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    order = F.struct(*others)
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order.desc() if last else order.asc()))
    own = rows.filter(keyed).repartition(*keys).groupBy(*rows.columns).agg(copies).withColumn("chosen", place == 1)
    # a null equals a null here
    keyless = rows.filter(~keyed)
    pick = F.max if last else F.min
    best = keyless.groupBy(*keys).agg(pick(order).alias("_best"))
    same = [F.col(f"d.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    joined = keyless.groupBy(*rows.columns).agg(copies).alias("d").join(best.alias("b"), same)
    chosen = F.struct(*[F.col(f"d.{c}") for c in others]).eqNullSafe(F.col("_best"))
    return own.unionByName(joined.select("d.*", chosen.alias("chosen")))


def _least(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The chosen record of each key alone: one aggregate, which tasks begin before anything is shuffled."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_best")).select(*keys, "_best.*")


def _split(checked: DataFrame, columns: Sequence[str], reason: Column) -> tuple[DataFrame, DataFrame]:
    """Accepted records, and rejects with ``reason`` and ``copies``; of an accepted record only further copies are rejects."""
    judged = checked.withColumn("reason", reason)
    copies = F.when(F.col("reason").isNull(), F.col("copies") - 1).otherwise(F.col("copies"))
    rejected = judged.select(*columns, F.coalesce("reason", F.lit("sent again")).alias("reason"), copies.alias("copies"))
    return judged.filter(F.col("reason").isNull()), rejected.filter("copies > 0")


def schedule_records(payloads: DataFrame) -> DataFrame:
    """Posted schedules, one record per race weekend; a posting without any is one empty record, to be rejected."""
    return payloads.select("season_name", F.explode_outer("races").alias("race")).select(
        "season_name",
        F.col("race.trackID").alias("track_id"),
        F.col("race.timestamp").alias("timestamp"),
        F.col("race.hasSprint").alias("has_sprint"),
    )


def ingest_schedule(
    records: DataFrame, seasons: DataFrame, races: DataFrame, tracks: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Schedule records to races: local start to UTC, and a sprint race at the same instant.

    A race whose (season, date, kind) already exists, or is posted twice, is rejected, as is an empty record, an
    unknown season or track or an unreadable start. New races have an id made of what makes them unique.
    """
    kinds = F.when(F.col("has_sprint"), F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    known_tracks = tracks.select(F.col("id").cast("string").alias("track_id"), F.col("id").alias("_track"))
    posted = records.join(_season_ids(seasons), "season_name", "left").select(
        "season_name",
        "season_id",
        "track_id",
        "timestamp",
        local_to_utc(F.col("timestamp")).alias("date"),
        F.explode(kinds).alias("is_sprint"),
    )
    slot = ["season_id", "date", "is_sprint"]
    existing = races.select(*slot).distinct().withColumn("_exists", F.lit(True))
    copies = posted.groupBy(*slot).agg(F.count(F.lit(1)).alias("_copies"))
    joined = posted.join(existing, slot, "left").join(copies, slot, "left").join(known_tracks, "track_id", "left")
    checked = joined.withColumn(
        "reason",
        F.when(F.col("season_id").isNull(), "unknown season")
        .when(F.col("track_id").isNull() & F.col("timestamp").isNull(), "no race")
        .when(F.col("date").isNull(), "unreadable start")
        .when(F.col("_track").isNull(), "unknown track")
        .when(F.col("_exists") | (F.col("_copies") > 1), "two races at one time"),
    )
    key = F.concat_ws("-", F.col("season_id").cast("string"), F.date_format("date", "yyyyMMddHHmm"))
    new = checked.filter(F.col("reason").isNull()).select(
        F.concat(key, F.when(F.col("is_sprint"), "-sprint").otherwise("")).alias("id"),
        *slot,
        F.col("_track").alias("track_id"),
    )
    rejected = checked.filter(F.col("reason").isNotNull()).select(
        "season_name", "track_id", "timestamp", "is_sprint", "reason"
    )
    return new, rejected


def result_records(payloads: DataFrame) -> DataFrame:
    """Posted results, one record per driver; each posting has its leader's, so none vanishes for want of other drivers."""
    leader = payloads.select(
        "race_id",
        F.col("leader.id").alias("driver_id"),
        F.col("leader.time").alias("time"),
        F.lit(None).cast("int").alias("plus_laps"),
        F.lit(True).alias("is_leader"),
        "fastestLap",
    )
    others = payloads.select("race_id", F.explode("otherDrivers").alias("d"), "fastestLap").select(
        "race_id",
        F.col("d.id").alias("driver_id"),
        F.col("d.time").alias("time"),
        F.col("d.plusLaps").alias("plus_laps"),
        F.lit(False).alias("is_leader"),
        "fastestLap",
    )
    return leader.unionByName(others).withColumnRenamed("fastestLap", "fastest_lap_driver")


def ingest_results(entries: DataFrame, records: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Write results into entries: the leader's time, the others' gaps, and the fastest lap.

    Races without records keep their entries. The old fastest lap of a posted race is cleared. A race is refused whole
    if it doesn't have one leader who is entered, with a readable time, or if who drove the fastest lap isn't entered.
    Of the others' records those without a readable gap or an entry are rejected, as is a driver posted twice. Records
    without a race or a driver are rejected by themselves.
    """
    gap = F.col("time")
    keyless = F.when(F.col("race_id").isNull(), "no race").when(F.col("driver_id").isNull(), "no driver")
    strays = records.filter(keyless.isNotNull()).select(*ENTRY, "time", keyless.alias("reason"))
    records = records.filter(keyless.isNull())
    copies = records.groupBy(*ENTRY).agg(F.count(F.lit(1)).alias("_copies"))
    entered = entries.select(*ENTRY).distinct().withColumn("_entered", F.lit(True))
    known = records.join(copies, ENTRY).join(entered, ENTRY, "left")
    leads = F.col("is_leader")
    races = known.groupBy("race_id").agg(
        F.count_if(leads).alias("leaders"),
        F.max(F.when(leads & F.col("_entered") & (F.col("_copies") == 1), parse_time(gap))).alias("leader_time"),
        F.min("fastest_lap_driver").alias("fastest_lap_driver"),
    )
    fastest = entered.select("race_id", F.col("driver_id").alias("fastest_lap_driver"), F.lit(True).alias("fastest_entered"))
    races = races.join(fastest, ["race_id", "fastest_lap_driver"], "left").select(
        "race_id",
        "fastest_lap_driver",
        "leader_time",
        F.when(F.col("leaders") != 1, "not one leader")
        .when(F.col("leader_time").isNull(), "no leader time")
        .when(F.col("fastest_lap_driver").isNotNull() & F.col("fastest_entered").isNull(), "fastest lap not entered")
        .alias("refused"),
    )
    # what a race says goes to its records, which stay dealt by race and driver
    checked = known.drop("fastest_lap_driver").join(F.broadcast(races), "race_id").withColumns(
        {
            "new_time": F.when(leads, F.col("leader_time")).otherwise(parse_gap(F.col("leader_time"), gap)),
            "reason": F.when(F.col("_entered").isNull(), "not entered")
            .when(F.col("_copies") > 1, "posted twice")
            .when(F.col("refused").isNotNull(), F.col("refused"))
            .when(~leads & ~F.coalesce(is_valid_gap(gap, strict), F.lit(False)), "unreadable gap"),
        }
    )
    good = checked.filter(F.col("reason").isNull()).select(
        *ENTRY, "new_time", F.col("plus_laps").alias("new_laps"), F.lit(True).alias("posted")
    )
    posted = F.coalesce("posted", F.lit(False))
    taken = races.filter(F.col("refused").isNull()).select("race_id", "fastest_lap_driver", F.lit(True).alias("taken"))
    snapshot = (
        entries.join(good, ENTRY, "left")
        .join(F.broadcast(taken), "race_id", "left")
        .select(
            *ENTRY,
            "team_id",
            F.when(posted, F.col("new_time")).otherwise(F.col("time")).alias("time"),
            F.when(posted, F.coalesce("new_laps", "plus_laps")).otherwise(F.col("plus_laps")).alias("plus_laps"),
            F.when(F.col("taken"), F.coalesce(F.col("driver_id") == F.col("fastest_lap_driver"), F.lit(False)))
            .otherwise(F.col("has_fastest_lap"))
            .alias("has_fastest_lap"),
            "is_dsq",
        )
    )
    rejected = checked.filter(F.col("reason").isNotNull()).select(*ENTRY, "time", "reason")
    return snapshot, rejected.unionByName(strays)


def flatten_teams(payloads: DataFrame, owner: str, outer: bool = False) -> DataFrame:
    """Posted team lists, one row per driver; with ``outer`` a list without teams, or a team without drivers, is a row too."""
    explode = F.explode_outer if outer else F.explode
    return payloads.select(owner, explode("teams").alias("t")).select(
        owner, F.col("t.teamID").alias("team_id"), explode("t.drivers").alias("driver_id")
    )


def flatten_team_pairs(payloads: DataFrame) -> DataFrame:
    """Roster rows of posted team pairs."""
    return flatten_teams(payloads, "season_id").select("driver_id", "season_id", "team_id")


def replace_race_entries(
    entries: DataFrame,
    lists: DataFrame,
    races: DataFrame | None = None,
    drivers: DataFrame | None = None,
    teams: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Replace the entries of posted races: a snapshot, and rejects (race, team, driver, reason, copies).

    ``lists`` has a row per race, team and driver. Rows without a race or a driver are rejected, and those of a race, driver or team
    that the given tables don't hold. Of what is left a race that lists a driver twice is refused whole and keeps its entries.
    """
    fresh, rejected = checked_entries(lists, races, drivers, teams)
    kept = entries.join(fresh.select("race_id").distinct(), "race_id", "left_anti")
    return kept.unionByName(fresh), rejected


def checked_entries(
    lists: DataFrame, races: DataFrame | None, drivers: DataFrame | None, teams: DataFrame | None
) -> tuple[DataFrame, DataFrame]:
    """New entries of the races that ``replace_race_entries`` accepts, and its rejects."""
    columns = ["race_id", "team_id", "driver_id"]
    checked = lists.groupBy(*columns).agg(F.count(F.lit(1)).alias("copies"))
    reason = F.when(F.col("race_id").isNull(), "no race").when(F.col("driver_id").isNull(), "no driver")
    for name, table in (("race", races), ("driver", drivers), ("team", teams)):
        if table is not None:
            known = table.select(F.col("id").alias(f"{name}_id"), F.lit(True).alias(f"_{name}"))
            checked = checked.join(known, f"{name}_id", "left")
            reason = reason.when(F.col(f"{name}_id").isNotNull() & F.col(f"_{name}").isNull(), f"unknown {name}")
    checked = checked.select(*columns, "copies", reason.alias("reason"))
    sound = checked.filter(F.col("reason").isNull())
    listed = sound.groupBy(*ENTRY).agg(F.sum("copies").alias("times_listed"))
    refused = listed.filter("times_listed > 1").select("race_id").distinct()
    fresh = sound.join(refused, "race_id", "left_anti").select(
        *ENTRY,
        "team_id",
        F.lit(None).cast("double").alias("time"),
        F.lit(None).cast("int").alias("plus_laps"),
        F.lit(False).alias("has_fastest_lap"),
        F.lit(False).alias("is_dsq"),
    )
    of_refused = sound.drop("reason").join(refused, "race_id", "left_semi").join(listed, ENTRY)
    reason = F.when(F.col("times_listed") > 1, "listed twice").otherwise("race refused")
    rejected = checked.filter(F.col("reason").isNotNull()).select(*columns, "reason", "copies")
    return fresh, rejected.unionByName(of_refused.select(*columns, reason.alias("reason"), "copies"))


def add_reserves(roster: DataFrame, requests: DataFrame, seasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Add drivers as reserves of a season.

    Drivers already in it, or posted twice, are rejected, and requests without a driver or for an unknown season.
    """
    asked = requests.groupBy("season_name", "driver_id").agg(F.count(F.lit(1)).alias("copies"))
    seated = roster.select(*SEAT).distinct().withColumn("_seated", F.lit(True))
    checked = (
        asked.join(_season_ids(seasons), "season_name", "left")
        .join(seated, SEAT, "left")
        .withColumn(
            "reason",
            F.when(F.col("season_id").isNull(), "unknown season")
            .when(F.col("driver_id").isNull(), "no driver")
            .when(F.col("_seated"), "already in season")
            .when(F.col("copies") > 1, "posted twice"),
        )
    )
    new = checked.filter(F.col("reason").isNull()).select(
        "driver_id",
        "season_id",
        F.lit(None).cast(roster.schema["team_id"].dataType).alias("team_id"),
        F.lit(True).alias("is_reserve"),
    )
    rejected = checked.filter(F.col("reason").isNotNull()).select("season_name", "driver_id", "reason", "copies")
    return new, rejected


def upsert_lineup(roster: DataFrame, changes: DataFrame, seasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Apply line-up changes: (season_name, driver_id, team_id, seq).

    A null team makes a seated driver a reserve; a team seats the driver, adding it if new. The
    last change of a driver wins, of several with one ``seq`` that with the greatest team; those before it are no rejects.
    Making an unknown driver a reserve is rejected, and any change in an unknown season or without a driver.
    """
    known = changes.join(_season_ids(seasons), "season_name", "left")
    reason = F.when(F.col("season_id").isNull(), "unknown season").when(F.col("driver_id").isNull(), "no driver")
    strangers = known.select("season_name", "driver_id", reason.alias("reason")).filter(F.col("reason").isNotNull())
    wanted = (
        known.filter(reason.isNull())
        .groupBy(*SEAT)
        .agg(F.max(F.struct("seq", "team_id", "season_name")).alias("_last"))
        .select(*SEAT, F.col("_last.team_id").alias("new_team"), "_last.season_name", F.lit(True).alias("changed"))
    )
    merged = roster.withColumn("seated", F.lit(True)).join(wanted, SEAT, "full_outer")
    changed = F.coalesce("changed", F.lit(False))
    unknown = F.col("seated").isNull() & F.col("new_team").isNull()
    snapshot = merged.filter(~unknown).select(
        "driver_id",
        "season_id",
        F.when(changed, F.col("new_team")).otherwise(F.col("team_id")).alias("team_id"),
        F.when(changed, F.col("new_team").isNull()).otherwise(F.col("is_reserve")).alias("is_reserve"),
    )
    absent = merged.filter(unknown).select("season_name", "driver_id", F.lit("not in season").alias("reason"))
    return snapshot, absent.unionByName(strangers)


class Verdicts(NamedTuple):
    """Snapshots after verdicts, the verdicts rejected, and penalties that weren't added."""

    reports: DataFrame
    penalties: DataFrame
    entries: DataFrame
    rejected: DataFrame
    rejected_penalties: DataFrame


def apply_verdicts(reports: DataFrame, penalties: DataFrame, entries: DataFrame, verdicts: DataFrame) -> Verdicts:
    """Decide reports: (report_id, seq, content, penalties array).

    The first verdict of an open report counts, of several with one ``seq`` the least; its penalties are added and a
    disqualification marks the entry. Other verdicts are rejected, copies of the first too. A driver gets one penalty for
    a report, the least of those given.
    """
    open_reports = reports.select(F.col("id").alias("report_id"), "race_id", F.col("verdict").isNull().alias("is_open"))
    columns = ["report_id", "seq", "content", "penalties"]
    sent = verdicts.select(*columns)
    # what is accepted needs the least verdict of each report only, what is rejected all of them
    accepted = _least(sent, ["report_id"]).join(open_reports.filter("is_open"), "report_id")
    checked = _chosen(sent, ["report_id"]).join(open_reports, "report_id", "left")
    _, rejected = _split(
        checked,
        ["report_id", "seq", "content"],
        F.when(F.col("is_open").isNull(), "unknown report")
        .when(~F.col("is_open"), "already decided")
        .when(~F.col("chosen"), "not the first"),
    )
    decided = accepted.select(F.col("report_id").alias("id"), F.col("content").alias("new_verdict"))
    new_reports = (
        reports.join(decided, "id", "left")
        .withColumn("verdict", F.coalesce("verdict", "new_verdict"))
        .select(*reports.columns)
    )
    given = accepted.select("report_id", "race_id", F.explode("penalties").alias("p")).select(
        "report_id",
        F.col("p.driverID").alias("driver_id"),
        F.col("p.time").alias("time"),
        F.col("p.penaltyPoints").alias("penalty_points"),
        F.col("p.isDSQ").alias("is_dsq"),
        "race_id",
    )
    pair = ["report_id", "driver_id"]
    known = penalties.select(*pair)
    values = [*pair, "time", "penalty_points", "is_dsq"]
    added = _least(given, pair).join(known, pair, "left_anti")
    one_each = _chosen(given, pair).join(known.distinct().withColumn("_known", F.lit(True)), pair, "left")
    _, refused = _split(
        one_each,
        values,
        F.when(F.col("_known"), "already given").when(~F.col("chosen"), "second penalty"),
    )
    excluded = added.filter("is_dsq").select(*ENTRY).distinct().withColumn("excluded", F.lit(True))
    new_entries = (
        entries.join(excluded, ENTRY, "left")
        .withColumn("is_dsq", F.coalesce("excluded", "is_dsq"))
        .select(*entries.columns)
    )
    return Verdicts(new_reports, penalties.unionByName(added.select(*values)), new_entries, rejected, refused)


def _senders(users: DataFrame) -> DataFrame:
    return users.select(F.col("id").alias("user_id"), F.col("driver_id").alias("from_driver"), F.lit(True).alias("is_user"))


def append_reports(
    submissions: DataFrame, users: DataFrame, existing: DataFrame | None = None, races: DataFrame | None = None
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Submitted reports to report and target rows, and rejects.

    ``submissions`` holds (id, race_id, user_id, content, targets, videos, created_at); the game
    as a target becomes a null driver. A submission without an id, of an unknown user or of one who doesn't drive is rejected, as
    is one without a race or of a race that ``races`` doesn't hold, one without targets or with a null among them, and an
    id that ``existing`` reports have; of several with one id the least counts.
    """
    key = users.schema["driver_id"].dataType
    checked = _chosen(submissions, ["id"]).join(_senders(users), "user_id", "left")
    if existing is not None:
        checked = checked.join(existing.select("id", F.lit(True).alias("exists")), "id", "left")
    else:
        checked = checked.withColumn("exists", F.lit(None).cast("boolean"))
    if races is not None:
        checked = checked.join(races.select(F.col("id").alias("race_id"), F.lit(True).alias("is_race")), "race_id", "left")
    else:
        checked = checked.withColumn("is_race", F.col("race_id").isNotNull())
    aimed = (F.size("targets") > 0) & ~F.exists("targets", lambda t: t.isNull())
    accepted, rejected = _split(
        checked,
        ["id", "race_id", "user_id"],
        F.when(F.col("id").isNull(), "no id")
        .when(F.col("is_user").isNull(), "unknown user")
        .when(F.col("from_driver").isNull(), "no driver")
        .when(~F.coalesce("is_race", F.lit(False)), "unknown race")
        .when(~F.coalesce(aimed, F.lit(False)), "no target")
        .when(F.col("exists"), "already sent")
        .when(~F.col("chosen"), "second report of this id"),
    )
    reports = accepted.select(
        "id",
        "race_id",
        "from_driver",
        "content",
        join_videos(F.col("videos")).alias("video_path"),
        F.lit(None).cast("string").alias("verdict"),
        "created_at",
    )
    targets = accepted.select(F.col("id").alias("report_id"), F.explode(F.array_distinct("targets")).alias("target"))
    targets = targets.select(
        "report_id", F.when(F.col("target") != GAME_ID, F.col("target")).cast(key).alias("driver_id")
    )
    return reports, targets, rejected


def append_responses(
    submissions: DataFrame, users: DataFrame, reports: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Submitted responses (report_id, user_id, content, videos, created_at) to response rows, and rejects.

    A response needs a known report and a user who drives; one sent again is taken once.
    """
    known = reports.select(F.col("id").alias("report_id")).distinct().withColumn("is_report", F.lit(True))
    distinct = submissions.groupBy(*submissions.columns).agg(F.count(F.lit(1)).alias("copies"))
    checked = distinct.join(_senders(users), "user_id", "left").join(known, "report_id", "left")
    accepted, rejected = _split(
        checked,
        ["report_id", "user_id", "created_at"],
        F.when(F.col("is_user").isNull(), "unknown user")
        .when(F.col("from_driver").isNull(), "no driver")
        .when(F.col("is_report").isNull(), "unknown report"),
    )
    responses = accepted.select(
        F.concat_ws(
            "-",
            F.col("report_id").cast("string"),
            F.col("user_id").cast("string"),
            F.md5(F.concat_ws("|", "content", F.col("created_at").cast("string"), join_videos(F.col("videos")))),
        ).alias("id"),
        "report_id",
        "from_driver",
        "content",
        join_videos(F.col("videos")).alias("video_path"),
        "created_at",
    )
    return responses, rejected


def replace_role_members(
    users_roles: DataFrame, members: DataFrame, seasons: DataFrame, users: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Replace the stewards of posted seasons: (season_name, user_id), a null user for none.

    Members of an unknown season and unknown users are rejected.
    """
    roles = seasons.select(F.col("name").alias("season_name"), F.col("fia_role_id").alias("role_id"))
    known = users.select(F.col("id").alias("user_id"), F.lit(True).alias("is_user"))
    distinct = members.groupBy("season_name", "user_id").agg(F.count(F.lit(1)).alias("copies"))
    checked = distinct.join(roles, "season_name", "left").join(known, "user_id", "left")
    posted, rejected = _split(
        checked,
        ["season_name", "user_id"],
        F.when(F.col("role_id").isNull(), "unknown season").when(
            F.col("user_id").isNotNull() & F.col("is_user").isNull(), "unknown user"
        ),
    )
    replaced = checked.filter(F.col("role_id").isNotNull()).select("role_id").distinct()
    kept = users_roles.join(replaced, "role_id", "left_anti")
    fresh = posted.filter(F.col("user_id").isNotNull()).select("user_id", "role_id").distinct()
    return kept.unionByName(fresh), rejected


OPERATIONS = ("insert", "update", "delete")


def apply_changes(
    table: DataFrame, changes: DataFrame, keys: Sequence[str], seq: str = "seq"
) -> tuple[DataFrame, DataFrame]:
    """Apply a change feed to a table; the last change of a key wins, and unknown operations are rejected.

    ``changes`` has the table's columns, ``op`` (insert, update or delete) and ``seq``; of several with one ``seq`` the
    greatest by operation and values is the last. An update keeps the old value where the new one is null, unless the
    column is named in ``cleared``, an array that changes may have. An update of a key that isn't there is rejected, as is a
    change with a null in its key.
    """
    values = [c for c in table.columns if c not in keys]
    cleared = F.coalesce("cleared", F.array()) if "cleared" in changes.columns else F.array().cast("array<string>")
    keyed = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys])
    bad = F.when(~F.coalesce(F.col("op").isin(*OPERATIONS), F.lit(False)), "unknown operation").when(~keyed, "no key")
    last = F.max(F.struct(seq, "op", *values, cleared.alias("cleared"))).alias("_last")
    newest = changes.filter(bad.isNull()).groupBy(*keys).agg(last).select(
        *keys, "_last.op", f"_last.{seq}", "_last.cleared", *[F.col(f"_last.{c}").alias(f"_new_{c}") for c in values]
    )
    merged = table.withColumn("_old", F.lit(True)).join(newest, list(keys), "full_outer")
    gone = F.coalesce(F.col("op") == "delete", F.lit(False))
    absent = F.coalesce(F.col("_old").isNull() & (F.col("op") == "update"), F.lit(False))

    def value(column: str) -> Column:
        kept = F.coalesce(f"_new_{column}", column)
        return F.when(F.coalesce(~F.array_contains("cleared", column), F.lit(True)), kept).alias(column)

    snapshot = merged.filter(~gone & ~absent).select(*[F.col(c) if c in keys else value(c) for c in table.columns])
    reasons = ["op", seq, "reason"]
    unknown = changes.withColumn("reason", bad).filter(F.col("reason").isNotNull()).select(*keys, *reasons)
    lost = merged.filter(absent).withColumn("reason", F.lit("nothing to update")).select(*keys, *reasons)
    return snapshot, unknown.unionByName(lost)
