"""Race classification and the pages of a single race, for all races at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paddock.functions.scoring import FEATURE_POINTS, SPRINT_POINTS, is_classified, points_for
from paddock.functions.timing import format_gap, has_been_raced
from paddock.operators.ranking import in_every_season, prefix, rank_spread
from paddock.sources.tables import League

ENTRY = ["race_id", "driver_id"]


def finish_order() -> list[Column]:
    """Disqualified entries after all others, unknown flags after those, missing times last."""
    return [F.col("is_dsq").asc_nulls_last(), F.col("time").asc_nulls_last()]


def finish_buckets(rows: DataFrame) -> list[Column]:
    """Rising with the finishing order: a quarter of a minute of the finish, or where there is no time a part of the drivers."""
    dsq_class = F.when(F.col("is_dsq"), 1).when(~F.col("is_dsq"), 0).otherwise(2)
    no_time = F.col("time").isNull()
    driver = prefix(rows, "driver_id")
    return [
        dsq_class,
        no_time.cast("int"),
        F.coalesce(F.floor(F.col("time") / 15), F.lit(0)),
        F.when(no_time, driver).otherwise(F.lit("" if dict(rows.dtypes)["driver_id"] == "string" else 0)),
    ]


def ranked_by_finish(entries: DataFrame) -> DataFrame:
    """Entries with their position in the race; equal times rank by driver id."""
    order = [*finish_order(), F.col("driver_id").asc()]
    return rank_spread(entries, ["race_id"], order, finish_buckets(entries), "rank")


def moment(as_of: object, column: DataFrame, name: str) -> Column:
    """``as_of`` as a literal of the type of a timestamp column."""
    return F.lit(str(as_of)).cast(column.schema[name].dataType)


def penalty_time_totals(league: League) -> DataFrame:
    """Penalty seconds per driver and race; of penalties that know their race no report is looked up."""
    penalties = league.penalties
    if "race_id" not in penalties.columns:
        races = league.reports.select(F.col("id").alias("report_id"), "race_id")
        penalties = penalties.select("report_id", "driver_id", "time").join(races, "report_id")
    return penalties.groupBy("driver_id", "race_id").agg(F.sum("time").alias("penalty_time"))


def adjusted_entries(league: League) -> DataFrame:
    """Entries with penalty seconds added to the raw time; a missing time stays missing."""
    entries = league.races_drivers.withColumnRenamed("time", "raw_time")
    return (
        entries.join(penalty_time_totals(league), ENTRY, "left")
        .withColumn("time", F.col("raw_time") + F.coalesce("penalty_time", F.lit(0)))
        .drop("penalty_time")
    )


def race_classification(league: League) -> DataFrame:
    """Entries with adjusted time and position; equal times rank by driver id."""
    return ranked_by_finish(adjusted_entries(league))


def scored_entries(
    league: League,
    pg_compat: bool = False,
    feature: Sequence[int] = FEATURE_POINTS,
    sprint: Sequence[int] = SPRINT_POINTS,
) -> DataFrame:
    """Classified entries with season, points by the given tables and whether the entry won its race.

    Only a finisher wins; ``pg_compat`` also counts the first entry of a race without results.
    """
    races = league.races.select(F.col("id").alias("race_id"), "season_id", "is_sprint")
    first = F.col("rank") == 1
    won = first if pg_compat else first & is_classified(F.col("time"), F.col("is_dsq"))
    return race_classification(league).join(races, "race_id").withColumns(
        {
            "points": points_for(
                F.col("rank"),
                F.col("is_sprint"),
                F.col("time"),
                F.col("is_dsq"),
                F.col("has_fastest_lap"),
                feature,
                sprint,
            ),
            "won": won,
        }
    )


def race_results(league: League, as_of: object) -> DataFrame:
    """Result sheet of every race."""
    races = league.races.select(F.col("id").alias("race_id"), "date", "is_sprint")
    drivers = league.drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    teams = league.teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    # entries without a driver or team are no part of the sheet, so they take no position
    entries = league.races_drivers.join(races, "race_id").join(drivers, "driver_id").join(teams, "team_id")
    sheet = entries.join(penalty_time_totals(league), ENTRY, "left").withColumn(
        "time", F.col("time") + F.coalesce("penalty_time", F.lit(0))
    )
    return ranked_by_finish(sheet).select(
        "race_id",
        "driver_id",
        "driver_name",
        F.col("time").alias("result_time"),
        "rank",
        "has_fastest_lap",
        "team_name",
        "is_sprint",
        "plus_laps",
        "is_dsq",
        has_been_raced(F.col("date"), moment(as_of, league.races, "date")).alias("has_been_raced"),
    )


def race_wins(league: League, pg_compat: bool = False) -> DataFrame:
    """Wins per season and driver, sprints included.

    The winner is the smallest entry in finishing order, so a race is reduced in every task
    before anything is shuffled.
    """
    place = F.struct(
        F.when(F.col("is_dsq"), 1).when(~F.col("is_dsq"), 0).otherwise(2).alias("dsq_class"),
        F.col("time").isNull().alias("no_time"),
        "time",
        "driver_id",
        "is_dsq",
    )
    winners = adjusted_entries(league).groupBy("race_id").agg(F.min(place).alias("w"))
    if not pg_compat:
        winners = winners.filter(is_classified(F.col("w.time"), F.col("w.is_dsq")))
    races = league.races.select(F.col("id").alias("race_id"), "season_id")
    return (
        winners.join(races, "race_id")
        .groupBy("season_id", F.col("w.driver_id").alias("driver_id"))
        .agg(F.count(F.lit(1)).alias("wins_count"))
    )


def race_entry_list(league: League) -> DataFrame:
    """Entries of every race with driver, team and race name."""
    drivers = league.drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    teams = league.teams.select(
        F.col("id").alias("team_id"),
        F.col("name").alias("team_name"),
        F.col("icon").alias("logo"),
        "color",
    )
    races = league.races.select(F.col("id").alias("race_id"), "track_id")
    tracks = league.tracks.select(F.col("id").alias("track_id"), "race_name")
    return (
        league.races_drivers.select("race_id", "driver_id", "team_id")
        .join(drivers, "driver_id")
        .join(teams, "team_id")
        .join(races.join(tracks, "track_id"), "race_id")
        .select("race_id", "race_name", "driver_id", "driver_name", "team_name", "logo", "color")
    )


def race_lineup_options(league: League) -> DataFrame:
    """Drivers that may be entered for each race, and every team of the race.

    A row with a team belongs to that team's choices; a team without any has one row without a driver. A row without a
    team is a reserve, open to every team of the race. ``entered_team_id`` is the team the driver is entered for, where
    the team could choose the driver. While a race has no entries, each team's own drivers are the proposed pick.
    """
    roster = league.seasons_drivers.join(
        league.drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name")), "driver_id"
    ).select(
        "season_id",
        "driver_id",
        "driver_name",
        F.coalesce("is_reserve", F.lit(False)).alias("is_reserve"),
        "team_id",
    )
    # neither a reserve nor in a team: nobody can choose the driver
    choices = roster.filter(F.col("is_reserve") | F.col("team_id").isNotNull()).select(
        "season_id",
        "driver_id",
        "driver_name",
        "is_reserve",
        F.when(~F.col("is_reserve"), F.col("team_id")).alias("option_team_id"),
    )
    teams = league.teams.select(F.col("id").alias("option_team_id"), F.col("name").alias("team_name"), "color")
    lacking = in_every_season(teams.select("option_team_id"), league.seasons).join(
        choices.select("season_id", "option_team_id"), ["season_id", "option_team_id"], "left_anti"
    )
    choices = choices.unionByName(lacking, allowMissingColumns=True)
    entered = league.races_drivers.select("race_id", "driver_id", F.col("team_id").alias("entry_team_id"))
    lined_up = entered.select("race_id").distinct().withColumn("has_entries", F.lit(True))
    tracks = league.tracks.select(F.col("id").alias("track_id"), "race_name")
    races = (
        league.races.select(F.col("id").alias("race_id"), "season_id", "track_id", F.col("date").alias("race_date"))
        .join(tracks, "track_id", "left")
        .join(lined_up, "race_id", "left")
    )
    options = choices.join(races, "season_id").join(entered, ENTRY, "left").join(teams, "option_team_id", "left")
    fits = F.col("option_team_id").isNull() | (F.col("option_team_id") == F.col("entry_team_id"))
    is_empty = F.col("has_entries").isNull()
    picked = F.when(is_empty, ~F.col("is_reserve")).otherwise(
        F.col("entry_team_id").isNotNull() & F.coalesce(fits, F.lit(False))
    )
    return options.select(
        "race_id",
        "race_name",
        "race_date",
        "option_team_id",
        "team_name",
        "color",
        "driver_id",
        "driver_name",
        "is_reserve",
        F.when(fits, F.col("entry_team_id")).alias("entered_team_id"),
        F.when(F.col("driver_id").isNotNull(), picked).alias("is_picked"),
        is_empty.alias("is_empty"),
    )


def race_gap_sheet(league: League) -> DataFrame:
    """Times as typed in: the leader's time, the others' gaps, and who drove the fastest lap."""
    drivers = league.drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    teams = league.teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"), "color")
    entries = (
        league.races_drivers.select(*ENTRY, "team_id", "time", "has_fastest_lap")
        .join(drivers, "driver_id")
        .join(teams, "team_id")
    )
    fastest = F.when(F.col("has_fastest_lap"), F.struct("driver_id", "driver_name"))
    leaders = entries.groupBy("race_id").agg(
        F.min("time").alias("leader_time"), F.min(fastest).alias("fastest")
    )
    known = F.col("leader_time").isNotNull()
    return entries.join(leaders, "race_id").select(
        "race_id",
        "driver_id",
        "driver_name",
        "team_name",
        "color",
        format_gap(F.col("leader_time"), F.col("time")).alias("gap"),
        F.when(known, F.col("fastest.driver_id")).alias("fastest_lap_driver_id"),
        F.when(known, F.col("fastest.driver_name")).alias("fastest_lap_driver_name"),
    )


def entry_points(league: League) -> DataFrame:
    """Points of every entry."""
    return scored_entries(league).select(*ENTRY, "rank", "is_sprint", "has_fastest_lap", "is_dsq", "points")


def scoring_places(entries: DataFrame, places: int, cars: str | None = None, *more: Column) -> DataFrame:
    """Shared positions (1, 1, 3, ...) of the best times of each race, down to ``places``.

    ``cars`` names a column with the number of entries a row stands for; ``more`` are aggregates over equal times.
    Equal times are one row before ranking, and only the first ``places`` of them can hold a
    position that scores; tasks cut their own rows to that many before the shuffle.
    """
    number = F.sum(cars) if cars else F.count(F.lit(1))
    times = entries.groupBy("race_id", "is_dsq", "time").agg(number.alias("cars"), *more)
    window = Window.partitionBy("race_id").orderBy(*finish_order())
    best = times.withColumn("_n", F.row_number().over(window)).filter(F.col("_n") <= places)
    earlier = window.rowsBetween(Window.unboundedPreceding, -1)
    rank = F.coalesce(F.sum("cars").over(earlier), F.lit(0)) + 1
    return best.withColumn("rank", rank).drop("_n", "cars")
