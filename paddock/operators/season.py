"""Schedules, line-ups, reserves, and who is not in a season."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators.ranking import Children, in_every_season, nest, rank_bounded, seasons_without
from paddock.sources.tables import League


def season_list(league: League) -> DataFrame:
    return league.seasons.select("id", "name")


def track_list(league: League) -> DataFrame:
    return league.tracks.select("id", F.col("race_name").alias("name"))


def season_schedule(league: League) -> DataFrame:
    """Races of every season, numbered by date with the sprint first."""
    tracks = league.tracks.select(F.col("id").alias("track_id"), "race_name", "image")
    seasons = league.seasons.select(F.col("id").alias("season_id"), F.col("name").alias("season_name"))
    races = league.races.withColumnRenamed("id", "race_id").join(tracks, "track_id").join(seasons, "season_id")
    return rank_bounded(
        races,
        ["season_id"],
        [F.col("date").asc_nulls_last(), F.col("is_sprint").desc_nulls_first(), F.col("race_id").asc()],
        "race_no",
    ).select("season_id", "season_name", "race_no", "race_id", "date", "race_name", "track_id", "is_sprint", "image")


def _absent(league: League, taken: DataFrame) -> DataFrame:
    drivers = league.drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    return seasons_without(drivers, "driver_id", taken.select("season_id", "driver_id"), league.seasons)


def unrostered_drivers(league: League) -> DataFrame:
    """Drivers, and the seasons in which they have no seat at all (``absent_from``)."""
    return _absent(league, league.seasons_drivers)


def available_drivers(league: League) -> DataFrame:
    """Drivers, and the seasons without a regular seat of theirs; an unknown reserve flag is no regular seat."""
    return _absent(league, league.seasons_drivers.filter(~F.col("is_reserve")))


def one_per_season(rows: DataFrame) -> DataFrame:
    """A row for each season in ``absent_from``."""
    return rows.withColumn("season_id", F.explode("absent_from")).drop("absent_from")


def season_lineup(league: League) -> DataFrame:
    """Every team in every season with its drivers, and whether the whole season is empty."""
    drivers = league.drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    seats = league.seasons_drivers.filter(F.col("team_id").isNotNull()).join(drivers, "driver_id")
    filled = league.seasons_drivers.filter(F.col("team_id").isNotNull()).select("season_id").distinct()
    members = nest(
        ["season_id", "team_id"],
        drivers=Children(
            seats.select("season_id", "team_id", "driver_id", "driver_name"),
            ["driver_id"],
            ["driver_id", "driver_name"],
        ),
    )
    teams = league.teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"), "color", "icon")
    return (
        in_every_season(teams, league.seasons)
        .join(members, ["season_id", "team_id"], "left")
        .join(filled.withColumn("_filled", F.lit(True)), "season_id", "left")
        .select(
            "season_id",
            "team_id",
            "team_name",
            "color",
            "icon",
            F.coalesce("drivers", F.array()).alias("drivers"),
            F.col("_filled").isNull().alias("is_empty_line_up"),
        )
    )


def season_reserves(league: League) -> DataFrame:
    """Reserve drivers of each season."""
    drivers = league.drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    return league.seasons_drivers.filter("is_reserve").join(drivers, "driver_id").select(
        "season_id", "driver_id", "driver_name"
    )


def signed_drivers(league: League) -> DataFrame:
    """All drivers with the teams that signed them; unsigned drivers have no season or team."""
    teams = league.teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"), "color")
    signed = (
        league.seasons_drivers.filter(F.col("team_id").isNotNull())
        .select("season_id", "team_id", "driver_id")
        .join(teams, "team_id")
    )
    drivers = league.drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    # inner and anti rather than outer: a driver with very many seats can then be split
    unsigned = drivers.join(signed, "driver_id", "left_anti")
    return (
        drivers.join(signed, "driver_id")
        .unionByName(unsigned, allowMissingColumns=True)
        .select("driver_id", "driver_name", "season_id", "team_id", "team_name", "color")
    )


def roster_to_entries(league: League) -> DataFrame:
    """An entry per rostered driver with a team and race of the season, without results."""
    drivers = league.drivers.select(F.col("id").alias("driver_id"))
    teams = league.teams.select(F.col("id").alias("team_id"))
    races = league.races.select(F.col("id").alias("race_id"), "season_id")
    return (
        league.seasons_drivers.join(drivers, "driver_id", "left_semi")
        .join(teams, "team_id", "left_semi")
        .join(races, "season_id")
        .select("race_id", "driver_id", "team_id")
    )
