"""Driver and constructor championships and the penalty-point table, for all seasons at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paddock.functions.scoring import (
    FASTEST_LAP_LAST_RANK,
    FEATURE_POINTS,
    SPRINT_POINTS,
    fastest_lap_points,
    is_classified,
    position_points,
)
from paddock.functions.timing import has_been_raced
from paddock.operators.ranking import in_every_season, in_order, rank_bounded
from paddock.operators.results import adjusted_entries, moment, scored_entries, scoring_places
from paddock.sources.tables import League

SEAT = ["season_id", "driver_id"]


def standings_race_header(league: League) -> DataFrame:
    """Race columns of the season table, numbered by date with the sprint first."""
    tracks = league.tracks.select(F.col("id").alias("track_id"), "flag")
    races = league.races.select(F.col("id").alias("race_id"), "season_id", "track_id", "date", "is_sprint")
    return rank_bounded(
        races.join(tracks, "track_id"),
        ["season_id"],
        [F.col("date").asc_nulls_last(), F.col("is_sprint").desc_nulls_first(), F.col("race_id").asc()],
        "race_no",
    )


def _season_races(league: League) -> DataFrame:
    """season_id and its races, one array of the header's columns in race order."""
    header = standings_race_header(league)
    columns = ["race_id", "track_id", "flag", "date", "is_sprint"]
    item = F.struct("race_no", F.struct("race_no", *columns).alias("_child"))
    return header.groupBy("season_id").agg(in_order(item).alias("races"))


def team_colors(league: League) -> DataFrame:
    """Colour of each rostered driver's season team."""
    teams = league.teams.select(F.col("id").alias("team_id"), "color")
    return league.seasons_drivers.join(teams, "team_id", "left").select(*SEAT, "color")


def _rostered(league: League) -> DataFrame:
    drivers = league.drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    return league.seasons_drivers.join(drivers, "driver_id")


def avg_finish_position(league: League) -> DataFrame:
    """Average position of each rostered driver over the races entered."""
    totals = _season_totals(scored_entries(league)).select(*SEAT, "avg_position")
    return league.seasons_drivers.select(*SEAT, "is_reserve").join(totals, SEAT, "left").select(
        *SEAT, "avg_position", "is_reserve"
    )


# Columns of an entry in the standings.
CELL = ["race_id", "team_name", "time", "has_fastest_lap", "rank", "points", "is_dsq"]


def _season_totals(scored: DataFrame, *more: Column) -> DataFrame:
    """Points, wins and average position of everybody who entered a season."""
    return scored.groupBy(*SEAT).agg(
        F.sum("points").alias("points_total"),
        F.sum(F.col("won").cast("bigint")).alias("wins_count"),
        F.avg("rank").alias("avg_position"),
        *more,
    )


def _driver_seasons(league: League, scored: DataFrame) -> DataFrame:
    """Everybody's totals of a season and the races entered, from one pass over the entries.

    A driver's races of a season are one array, which the season's races bound.
    """
    teams = league.teams.select(F.col("id").alias("team_id"), F.col("name").alias("team_name"))
    named = scored.join(teams, "team_id", "left").withColumn("time", F.col("raw_time"))
    return _season_totals(named, F.collect_list(F.struct(*CELL)).alias("entered"))


def _cells(entered: Column, races: Column) -> Column:
    """(race, cell) for each race of the season, in race order; the cell of a race not entered is null.

    An entry counts once for its race.
    """
    own = F.coalesce(entered, F.array())
    return F.transform(
        races,
        lambda r: F.struct(
            r.alias("race"), F.get(F.filter(own, lambda c: c["race_id"] == r["race_id"]), F.lit(0)).alias("cell")
        ),
    )


def driver_race_points(league: League) -> DataFrame:
    """One row per rostered driver and race of the season; a race not entered has no rank."""
    seats = _rostered(league).select(*SEAT, "driver_name", "is_reserve")
    seasons = _driver_seasons(league, scored_entries(league)).select(*SEAT, "entered")
    return _cell_rows(seats.join(seasons, SEAT, "left"), _season_races(league)).select(
        *SEAT,
        "race_id",
        "driver_name",
        "is_reserve",
        "track_id",
        "flag",
        "date",
        "team_name",
        "time",
        "has_fastest_lap",
        "rank",
        "points",
        "is_dsq",
    )


def _cell_rows(seats: DataFrame, season_races: DataFrame) -> DataFrame:
    """``seats`` with their ``entered`` races, a row for each race of the season.

    Rows are made where the seat is, so the table of seats times races is never shuffled.
    """
    rows = seats.join(season_races, "season_id").withColumn("race_count", F.size("races").cast("bigint"))
    rows = rows.withColumn("races", _cells(F.col("entered"), F.col("races"))).drop("entered")
    own = [c for c in rows.columns if c != "races"]
    rows = rows.select(*own, F.inline("races"))
    fields = ["team_name", "time", "has_fastest_lap", "rank", "is_dsq"]
    points = F.coalesce("cell.points", F.lit(0)).alias("points")
    return rows.select(*own, "race.*", *[F.col(f"cell.{c}").alias(c) for c in fields], points)


def _ranked_seats(league: League, scored: DataFrame) -> DataFrame:
    """Rostered drivers with season totals, races entered and championship position."""
    teams = league.teams.select(F.col("id").alias("team_id"), "color")
    seats = (
        _rostered(league)
        .join(teams, "team_id", "left")
        .join(_driver_seasons(league, scored), SEAT, "left")
        .withColumns(
            {
                "points_total": F.coalesce("points_total", F.lit(0)),
                "wins_count": F.coalesce("wins_count", F.lit(0)),
            }
        )
        .select(
            *SEAT, "driver_name", "is_reserve", "color", "points_total", "wins_count", "avg_position", "entered"
        )
    )
    return rank_bounded(
        seats,
        ["season_id"],
        [
            F.col("points_total").desc(),
            F.col("wins_count").desc(),
            F.col("avg_position").asc_nulls_last(),
            F.col("is_reserve").asc_nulls_last(),
            F.col("driver_name").asc_nulls_last(),
            F.col("driver_id").asc(),
        ],
        "position",
    )


def driver_standings_long(
    league: League,
    as_of: object,
    pg_compat: bool = False,
    feature: Sequence[int] = FEATURE_POINTS,
    sprint: Sequence[int] = SPRINT_POINTS,
    scored: DataFrame | None = None,
) -> DataFrame:
    """Driver championship, one row per driver and race; read in order of position, race_no.

    ``scored`` are the league's scored entries where they are kept.
    """
    seats = _ranked_seats(league, scored_entries(league, pg_compat, feature, sprint) if scored is None else scored)
    raced = has_been_raced(F.col("date"), moment(as_of, league.races, "date"))
    return _cell_rows(seats, _season_races(league)).select(
        *SEAT,
        "race_id",
        "position",
        "race_no",
        "driver_name",
        "is_reserve",
        "color",
        "points_total",
        "wins_count",
        "avg_position",
        "race_count",
        "track_id",
        "flag",
        "date",
        "is_sprint",
        raced.alias("has_been_raced"),
        "team_name",
        "time",
        "has_fastest_lap",
        "rank",
        "points",
        "is_dsq",
    )


def cell_rank(is_dsq: Column, is_reserve: Column, team_name: Column, time: Column, rank: Column) -> Column:
    """Text of a standings cell."""
    return (
        F.when(is_dsq, "DSQ")
        .when(team_name.isNull() & is_reserve, "")
        .when(team_name.isNull(), "DNS")
        .when(time.isNull(), "DNF")
        .otherwise(rank.cast("string"))
    )


def _cell_text(is_reserve: Column, cell: Column) -> tuple[Column, Column]:
    """Rank and points that a cell shows; an absent reserve has neither."""
    absent_reserve = F.coalesce(is_reserve, F.lit(False)) & cell["team_name"].isNull()
    rank = cell_rank(cell["is_dsq"], is_reserve, cell["team_name"], cell["time"], cell["rank"])
    return rank, F.when(~absent_reserve, F.coalesce(cell["points"], F.lit(0)))


def rank_display(league: League) -> DataFrame:
    """What each cell of the driver table shows; an absent reserve has neither rank nor points."""
    rows = driver_race_points(league)
    rank, points = _cell_text(F.col("is_reserve"), F.struct("is_dsq", "team_name", "time", "rank", "points"))
    return rows.select(*SEAT, "race_id", rank.alias("cell"), points.alias("cell_points"))


def driver_standings(
    league: League,
    as_of: object,
    feature: Sequence[int] = FEATURE_POINTS,
    sprint: Sequence[int] = SPRINT_POINTS,
) -> DataFrame:
    """Driver championship with the races of a driver as one array, in race order."""
    seats = _ranked_seats(league, scored_entries(league, feature=feature, sprint=sprint))
    rows = seats.join(_season_races(league), "season_id")
    now = moment(as_of, league.races, "date")

    def shown(item: Column) -> Column:
        race, cell = item["race"], item["cell"]
        rank, points = _cell_text(F.col("is_reserve"), cell)
        return F.struct(
            race["race_id"].alias("race_id"),
            cell["team_name"].alias("team_name"),
            cell["has_fastest_lap"].alias("has_fastest_lap"),
            rank.alias("rank"),
            points.alias("points"),
            has_been_raced(race["date"], now).alias("has_been_raced"),
        )

    return rows.select(
        "season_id",
        "position",
        "driver_id",
        "driver_name",
        "is_reserve",
        "points_total",
        "color",
        "wins_count",
        F.transform(_cells(F.col("entered"), F.col("races")), shown).alias("races"),
    )


def team_race_points(
    league: League, feature: Sequence[int] = FEATURE_POINTS, sprint: Sequence[int] = SPRINT_POINTS
) -> DataFrame:
    """What each team earned in each race; equal times share a position. Teams outside the points have no row."""
    teams = league.teams.select(F.col("id").alias("team_id"))
    races = league.races.select(F.col("id").alias("race_id"), "season_id", "is_sprint")
    entries = adjusted_entries(league).join(teams, "team_id").join(races, "race_id")
    # cars of a team with the same result count together, and stay with the time they share: a list that the teams bound
    grouped = entries.groupBy("season_id", "race_id", "is_sprint", "is_dsq", "time", "team_id").agg(
        F.count(F.lit(1)).alias("cars"), F.count_if("has_fastest_lap").alias("fastest")
    )
    shared = [
        F.first("season_id").alias("season_id"),
        F.first("is_sprint").alias("is_sprint"),
        F.collect_list(F.struct("team_id", F.col("cars").alias("own_cars"), "fastest")).alias("teams"),
    ]
    places = max(len(feature), len(sprint), FASTEST_LAP_LAST_RANK)
    scored = scoring_places(grouped, places, "cars", *shared).filter(is_classified(F.col("time"), F.col("is_dsq")))
    earned = F.col("own_cars") * position_points(F.col("rank"), F.col("is_sprint"), feature, sprint) + F.col(
        "fastest"
    ) * fastest_lap_points(F.col("rank"), F.col("is_sprint"))
    cars = scored.select("race_id", "season_id", "is_sprint", "rank", F.inline("teams"))
    return cars.groupBy("race_id", "season_id", "team_id").agg(F.sum(earned).cast("bigint").alias("earned"))


def constructor_standings(
    league: League,
    pg_compat: bool = False,
    feature: Sequence[int] = FEATURE_POINTS,
    sprint: Sequence[int] = SPRINT_POINTS,
    team_points: DataFrame | None = None,
) -> DataFrame:
    """Constructor championship: every team in every season.

    Equal times share a position here. Teams without entries have 0 points and come last;
    ``pg_compat`` puts them first, as a descending sort with nulls first does. ``team_points`` are the teams' points by race
    where they are kept.
    """
    points_by_race = team_race_points(league, feature, sprint) if team_points is None else team_points
    totals = points_by_race.groupBy("season_id", "team_id").agg(F.sum("earned").alias("earned"))
    listed = in_every_season(league.teams.select(F.col("id").alias("team_id"), "name", "color", "icon"), league.seasons)
    table = listed.join(totals, ["season_id", "team_id"], "left")
    points = F.coalesce("earned", F.lit(0))
    if pg_compat:
        # a team that took part has 0, one that did not has null
        races = league.races.select(F.col("id").alias("race_id"), "season_id")
        present = league.races_drivers.select("race_id", "team_id").join(races, "race_id")
        present = present.select("season_id", "team_id").distinct().withColumn("took_part", F.lit(True))
        table = table.join(present, ["season_id", "team_id"], "left").withColumn(
            "earned", F.when(F.col("took_part"), points)
        )
        first = F.col("earned").desc_nulls_first()
    else:
        first = F.col("points").desc()
    return rank_bounded(
        table.withColumn("points", points.cast("bigint")),
        ["season_id"],
        [first, F.col("name").asc_nulls_last(), F.col("team_id").asc()],
        "rank",
    ).select("season_id", "team_id", "color", "points", "name", "rank", "icon")


def _penalty_points(league: League) -> DataFrame:
    races = league.reports.select(F.col("id").alias("report_id"), "race_id")
    return (
        league.penalties.filter(F.col("penalty_points") > 0)
        .select("report_id", "driver_id", "penalty_points")
        .join(races, "report_id")
        .groupBy("driver_id", "race_id")
        .agg(F.sum("penalty_points").alias("points"))
    )


def penalty_points_by_race(league: League) -> DataFrame:
    """Penalty points per driver and race, where there are any."""
    return _penalty_points(league).join(league.drivers.select(F.col("id").alias("driver_id")), "driver_id", "left_semi")


def _penalty_seats(league: League) -> DataFrame:
    """Rostered drivers with penalty points of the season in all and by race, and the season's races."""
    races = league.races.select(F.col("id").alias("race_id"), "season_id")
    seasons = (
        _penalty_points(league)
        .join(races, "race_id")
        .groupBy(*SEAT)
        .agg(
            F.sum("points").alias("points_total"),
            F.map_from_entries(F.collect_list(F.struct("race_id", "points"))).alias("by_race"),
        )
    )
    teams = league.teams.select(F.col("id").alias("team_id"), F.col("icon").alias("team_icon"))
    return (
        _rostered(league)
        .join(teams, "team_id", "left")
        .join(seasons, SEAT, "left")
        .withColumn("points_total", F.coalesce("points_total", F.lit(0)))
        .join(_season_races(league), "season_id")
    )


def penalty_points_table(league: League) -> DataFrame:
    """Rostered drivers times races with penalty points per race and season."""
    seats = _penalty_seats(league).withColumn("race", F.explode("races"))
    return seats.select(
        *SEAT,
        "race.race_id",
        "race.race_no",
        "driver_name",
        "team_icon",
        F.col("by_race")[F.col("race.race_id")].alias("points"),
        "points_total",
    )


def penalty_points_nested(league: League) -> DataFrame:
    """The penalty table with a driver's points per race as one array, 0 where there are none."""
    points = F.transform("races", lambda r: F.coalesce(F.col("by_race")[r["race_id"]], F.lit(0)))
    return _penalty_seats(league).select(
        *SEAT, "driver_name", "points_total", "team_icon", points.alias("races")
    )
