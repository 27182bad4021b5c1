"""Incoming records in the shape clients post them, derived from whole league tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.timing import SCHEDULE_FORMAT, format_gap, format_time
from paddock.operators.results import ENTRY
from paddock.sources.tables import League


def _seasons(league: League) -> DataFrame:
    return league.seasons.select(F.col("id").alias("season_id"), F.col("name").alias("season_name"))


def _entry_seasons(league: League) -> DataFrame:
    races = league.races.select(F.col("id").alias("race_id"), "season_id")
    return league.races_drivers.join(races, "race_id")


def schedules(league: League) -> DataFrame:
    """Each race weekend posted again, its date read as a local start; those of June at a track that isn't known."""
    weekends = league.races.groupBy("season_id", "date", "track_id").agg(F.bool_or("is_sprint").alias("hasSprint"))
    track = F.when(F.month("date") == 6, F.lit("nowhere")).otherwise(F.col("track_id").cast("string"))
    return weekends.join(_seasons(league), "season_id").select(
        "season_name",
        F.array(
            F.struct(
                track.alias("trackID"),
                F.date_format("date", SCHEDULE_FORMAT).alias("timestamp"),
                "hasSprint",
            )
        ).alias("races"),
    )


def results(league: League) -> DataFrame:
    """Every race's results as typed in: the leader's time, then gaps.

    Leaders whose number ends in 3 post under a number that isn't entered.
    """
    entries = league.races_drivers
    best = entries.groupBy("race_id").agg(
        F.min(F.struct(F.col("time").isNull().alias("none"), "time", "driver_id")).alias("best"),
        F.min(F.when(F.col("has_fastest_lap"), F.col("driver_id"))).alias("fastest_lap_driver"),
    )
    leads = F.col("driver_id") == F.col("best.driver_id")
    text = F.when(leads, format_time(F.col("time"))).otherwise(format_gap(F.col("best.time"), F.col("time")))
    stranger = leads & (F.col("driver_id") % 10 == 3)
    return entries.join(F.broadcast(best), "race_id").select(
        "race_id",
        F.when(stranger, -F.col("driver_id")).otherwise(F.col("driver_id")).alias("driver_id"),
        text.alias("time"),
        F.when(~leads, F.col("plus_laps")).alias("plus_laps"),
        leads.alias("is_leader"),
        "fastest_lap_driver",
    )


def lined_up(league: League) -> DataFrame:
    """Entries before results are known."""
    return league.races_drivers.select(
        *ENTRY,
        "team_id",
        F.lit(None).cast("double").alias("time"),
        F.lit(None).cast("int").alias("plus_laps"),
        F.lit(False).alias("has_fastest_lap"),
        "is_dsq",
    )


def entry_lists(league: League) -> DataFrame:
    """Race line-ups posted again; a disqualified driver with the fastest lap is listed twice."""
    twice = F.col("is_dsq") & F.col("has_fastest_lap")
    drivers = F.when(twice, F.array("driver_id", "driver_id")).otherwise(F.array("driver_id"))
    return league.races_drivers.select(
        "race_id", F.array(F.struct(F.col("team_id").alias("teamID"), drivers.alias("drivers"))).alias("teams")
    )


def team_pairs(league: League) -> DataFrame:
    """All drivers of each team and season."""
    teams = league.seasons_drivers.filter(F.col("team_id").isNotNull()).groupBy("season_id", "team_id").agg(
        F.sort_array(F.collect_list("driver_id")).alias("drivers")
    )
    team = F.struct(F.col("team_id").alias("teamID"), "drivers")
    return teams.select("season_id", F.array(team).alias("teams"))


def _posted_season() -> Column:
    """The season's name as posted: in one case of eleven one that isn't known."""
    return F.when(F.col("driver_id") % 11 == 5, F.lit("No season")).otherwise(F.col("season_name"))


def reserve_requests(league: League) -> DataFrame:
    """Everybody who entered a race asks to be a reserve of its season, some twice, some of an unknown season."""
    asked = _entry_seasons(league).select("season_id", "driver_id").distinct().join(_seasons(league), "season_id")
    times = F.when(F.col("driver_id") % 13 == 0, 2).otherwise(1)
    return asked.withColumn("time", F.explode(F.sequence(F.lit(1), times))).select(
        _posted_season().alias("season_name"), "driver_id"
    )


def lineup_changes(league: League) -> DataFrame:
    """Each entry seats its driver in the entry's team; a disqualified one loses the seat. Some seasons aren't known."""
    return _entry_seasons(league).join(_seasons(league), "season_id").select(
        _posted_season().alias("season_name"),
        "driver_id",
        F.when(~F.col("is_dsq"), F.col("team_id")).alias("team_id"),
        F.col("race_id").alias("seq"),
    )


def verdicts(league: League) -> DataFrame:
    """Verdicts for every report, the first one sent twice; they punish its lowest targets.

    Every third report's verdict punishes the lowest target once more; some are of a report that isn't known.
    """
    targets = league.report_targets.groupBy("report_id").agg(
        F.min("driver_id").alias("low"), F.max("driver_id").alias("high")
    )

    def penalty(driver: Column, more: int) -> Column:
        s = driver + F.col("report_id") + more
        return F.struct(
            driver.alias("driverID"),
            (s % 3 * 5).cast("int").alias("time"),
            (s % 5).cast("int").alias("penaltyPoints"),
            (s % 2 == 0).alias("isDSQ"),
        )

    low, high = F.col("low"), F.col("high")
    both = F.when(low == high, F.array(penalty(low, 0))).otherwise(F.array(penalty(low, 0), penalty(high, 0)))
    again = F.when(F.col("report_id") % 3 == 0, F.array(penalty(low, 1))).otherwise(F.array())
    # a report on the game only gets no penalty
    given = F.filter(F.concat(both, again), lambda p: p["driverID"].isNotNull())
    sent = targets.withColumn("seq", F.explode(F.array(F.lit(1), F.lit(1), F.lit(2))))
    unknown = (F.col("report_id") % 17 == 0) & (F.col("seq") == 2)
    return sent.select(
        F.when(unknown, -1 - F.col("report_id")).otherwise(F.col("report_id")).alias("report_id"),
        F.format_string("ruling %d of %d", "seq", "report_id").alias("content"),
        given.alias("penalties"),
        "seq",
    )


def report_submissions(league: League) -> DataFrame:
    """Every target of a report submitted as a report of its own by the reporter's user; some users aren't known."""
    senders = league.users.filter(F.col("driver_id").isNotNull()).select(
        F.col("id").alias("user_id"), F.col("driver_id").alias("from_driver")
    )
    targets = league.report_targets.withColumnRenamed("report_id", "id")
    target = F.coalesce(F.col("driver_id").cast("string"), F.lit("hra"))
    both = F.array(target, F.lit("hra"))
    return league.reports.join(senders, "from_driver").join(targets, "id").select(
        F.concat_ws("-", F.col("id").cast("string"), target).alias("id"),
        "race_id",
        F.when(F.col("id") % 9 == 4, -1 - F.col("user_id")).otherwise(F.col("user_id")).alias("user_id"),
        "content",
        F.when(F.col("driver_id") % 2 == 0, both).otherwise(F.array(target)).alias("targets"),
        F.split("video_path", r"\+\+").alias("videos"),
        "created_at",
    )


def response_submissions(league: League) -> DataFrame:
    """Every response sent again by the driver's user, some twice; some reports aren't known."""
    senders = league.users.filter(F.col("driver_id").isNotNull()).select(
        F.col("id").alias("user_id"), F.col("driver_id").alias("from_driver")
    )
    times = F.when(F.col("report_id") % 4 == 1, 2).otherwise(1)
    return (
        league.report_responses.join(senders, "from_driver")
        .withColumn("time", F.explode(F.sequence(F.lit(1), times)))
        .select(
            F.when(F.col("report_id") % 8 == 3, -F.col("report_id")).otherwise(F.col("report_id")).alias("report_id"),
            "user_id",
            "content",
            F.split("video_path", r"\+\+").alias("videos"),
            "created_at",
        )
    )


def steward_lists(league: League) -> DataFrame:
    """Users whose drivers are reserves become the season's stewards; some seasons and users aren't known."""
    users = league.users.select(F.col("id").alias("user_id"), "driver_id")
    reserves = league.seasons_drivers.filter("is_reserve").join(users, "driver_id")
    stranger = F.col("driver_id") % 4 == 1
    return reserves.join(_seasons(league), "season_id").select(
        _posted_season().alias("season_name"), F.when(stranger, -F.col("user_id")).otherwise(F.col("user_id")).alias("user_id")
    )


def driver_changes(orders: DataFrame) -> DataFrame:
    """Orders as driver changes: by status a rename, a removal or a new driver; urgent ones have no known operation."""
    status = F.col("o_orderstatus")
    known = F.when(status == "F", "update").when(status == "O", "delete").otherwise("insert")
    return orders.select(
        F.col("o_custkey").alias("id"),
        F.when(status != "O", F.format_string("Driver of order %d", "o_orderkey")).alias("name"),
        F.when(F.col("o_orderpriority") != "1-URGENT", known).alias("op"),
        F.col("o_orderkey").alias("seq"),
    )


def gap_texts(league: League) -> DataFrame:
    """Gaps in the ways people type them: comma, no minutes, extra digits."""
    leaders = league.races_drivers.groupBy("race_id").agg(F.min("time").alias("leader_time"))
    rows = league.races_drivers.join(leaders, "race_id")
    gap = format_gap(F.col("leader_time"), F.col("time"))
    typed = (
        F.when(F.col("has_fastest_lap"), F.concat(gap, F.lit("99")))
        .when(F.col("plus_laps") == 1, F.replace(gap, F.lit("."), F.lit(",")))
        .when(F.col("plus_laps") == 2, F.concat(F.lit("+"), F.substring(gap, 5, 6)))
        .otherwise(gap)
    )
    return rows.select(*ENTRY, "leader_time", typed.alias("gap"))


def identifiers(orders: DataFrame) -> DataFrame:
    """An identifier text per order: canonical, upper case or without hyphens."""
    digest = F.md5(F.col("o_orderkey").cast("string"))
    hyphened = F.regexp_replace(digest, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    text = (
        F.when(F.col("o_orderpriority") == "1-URGENT", F.upper(hyphened))
        .when(F.col("o_orderpriority") == "5-LOW", digest)
        .otherwise(hyphened)
    )
    return orders.select("o_orderkey", text.alias("id_text"))


def name_requests(league: League) -> DataFrame:
    """A request per race that names its season as it stands in an address."""
    return league.races.select(F.col("id").alias("race_id"), "season_id").join(_seasons(league), "season_id").select(
        "race_id", F.replace("season_name", F.lit(" "), F.lit("%20")).alias("encoded_name")
    )


def clock_texts(league: League) -> DataFrame:
    """Times in the ways people type them, made of whole minutes, seconds and milliseconds."""
    k = F.col("driver_id") * 7919 + F.col("race_id")
    minutes, seconds, millis = (k % 90).cast("int"), (F.floor(k / 90) % 60).cast("int"), (F.floor(k / 5400) % 1000).cast("int")
    text = (
        F.when(k % 7 == 0, F.format_string("%d:%02d", minutes, seconds))
        .when(k % 7 == 1, F.format_string("%02d:%d.%d", minutes, seconds, millis))
        .when(k % 7 == 2, F.format_string("%d.%03d", seconds, millis))
        .when(k % 7 == 3, F.lit("DNF"))
        .otherwise(F.format_string("%d:%02d.%03d", minutes, seconds, millis))
    )
    return league.races_drivers.select(*ENTRY, text.alias("time_text"))


def time_pairs(league: League) -> DataFrame:
    """Neighbouring times of a race in quarter seconds, in either order, some missing."""
    k = F.col("driver_id") * 31 + F.col("race_id")
    first, second = (k % 9000) / 4 + 3600, (k % 7000) / 4 + 3700
    return league.races_drivers.select(
        *ENTRY,
        F.when(k % 19 != 0, first.cast("double")).alias("leader_time"),
        F.when(k % 5 != 0, F.greatest(first, second).cast("double")).alias("time"),
    )


# Records that lack what a table's key needs, or name what isn't there. Each feed is sent with its own.


def empty_schedules(league: League) -> DataFrame:
    """A posting without races for each season, half of them with no list at all."""
    like = schedules(league)
    empty = F.when(F.col("season_id") % 2 == 0, F.array()).cast(like.schema["races"].dataType)
    return _seasons(league).select("season_name", empty.alias("races"))


def stray_results(league: League) -> DataFrame:
    """A result without a driver for each race, and one without a race for each season."""
    no_driver = league.races.select(F.col("id").alias("race_id"), F.lit(None).cast("long").alias("driver_id"))
    no_race = league.seasons.select(F.lit(None).cast("int").alias("race_id"), F.col("id").cast("long").alias("driver_id"))
    return no_driver.unionByName(no_race).select(
        *ENTRY,
        F.lit("+00:01.000").alias("time"),
        F.lit(None).cast("int").alias("plus_laps"),
        F.lit(False).alias("is_leader"),
        F.lit(None).cast("long").alias("fastest_lap_driver"),
    )


def stray_entry_lists(league: League) -> DataFrame:
    """For each race a list without teams; for each season one of no race, and one of a race, driver and team that aren't known."""
    kind = entry_lists(league).schema["teams"].dataType
    none = league.races.select(F.col("id").alias("race_id"), F.array().cast(kind).alias("teams"))
    first = league.races.groupBy("season_id").agg(F.min("id").alias("race_id"))
    one = F.array(F.struct(F.lit(None).alias("teamID"), F.array(F.col("season_id")).alias("drivers"))).cast(kind)
    teams = F.array(
        F.struct(F.lit(0).alias("teamID"), F.array(-F.col("season_id")).alias("drivers")),
        F.struct((-F.col("season_id")).alias("teamID"), F.array(F.lit(1)).alias("drivers")),
    ).cast(kind)
    return (
        none.unionByName(first.select(F.lit(None).cast("int").alias("race_id"), one.alias("teams")))
        .unionByName(first.select((-F.col("race_id")).alias("race_id"), one.alias("teams")))
        .unionByName(first.select("race_id", teams.alias("teams")))
    )


def stray_seats(league: League) -> DataFrame:
    """A request or change without a driver for each season, sent twice."""
    twice = F.explode(F.array(F.lit(1), F.lit(2))).alias("seq")
    return _seasons(league).select("season_name", F.lit(None).cast("long").alias("driver_id"), F.lit(None).alias("team_id"), twice)


def stray_reports(league: League) -> DataFrame:
    """Of each undecided report of a driving user one submission without an id, one of no race, one without and one with a null target."""
    senders = league.users.filter(F.col("driver_id").isNotNull()).select(
        F.col("id").alias("user_id"), F.col("driver_id").alias("from_driver")
    )
    rows = league.reports.filter(F.col("verdict").isNull()).join(senders, "from_driver")
    rows = rows.withColumn("kind", F.explode(F.array(*(F.lit(k) for k in range(4)))))
    game, none = F.lit("hra"), F.lit(None).cast("string")
    targets = F.when(F.col("kind") == 2, F.array().cast("array<string>")).when(F.col("kind") == 3, F.array(game, none))
    return rows.select(
        F.when(F.col("kind") != 0, F.concat_ws("/", F.col("id").cast("string"), F.col("kind").cast("string"))).alias("id"),
        F.when(F.col("kind") == 1, -F.col("race_id")).otherwise(F.col("race_id")).alias("race_id"),
        "user_id",
        "content",
        targets.otherwise(F.array(game)).alias("targets"),
        F.split("video_path", r"\+\+").alias("videos"),
        "created_at",
    )


def stray_changes(orders: DataFrame) -> DataFrame:
    """A change without a key for each order that is partly shipped."""
    part = orders.filter(F.col("o_orderstatus") == "P")
    return part.select(
        F.lit(None).cast("long").alias("id"), F.lit("Nobody").alias("name"), F.lit("insert").alias("op"), F.col("o_orderkey").alias("seq")
    )
