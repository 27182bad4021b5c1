"""Standings and tables kept up by change: what a feed doesn't name is neither read nor written.

Entries, penalties and what a race scored are kept in parts by race (``sources.kept``). A feed of results, line-ups or verdicts
replaces the entries or adds penalties of the races it names, and those races alone are ranked and scored anew. Standings add
up scores that stand, so they never rank a race.

All changes may be applied twice: entries are replaced, penalties have a key, and scores follow from both. The races that a feed
names are sent to the tasks that read the tables, so rows that stay aren't shuffled.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.operators import championship, ingest, results
from paddock.operators.results import ENTRY
from paddock.sources.kept import PARTS, Kept
from paddock.sources.tables import League

GIVEN = ["race_id", "report_id", "driver_id"]


@dataclass(frozen=True)
class Standings:
    """Kept entries, penalties (with their race), scores of entries and scores of teams under ``path``."""

    entries: Kept
    penalties: Kept
    scores: Kept
    team_scores: Kept

    @classmethod
    def at(cls, path: str, league: League, parts: int = PARTS) -> Standings:
        """Kept tables with the types of a league's, none of them written yet."""

        def kept(name: str, schema: T.StructType) -> Kept:
            return Kept(f"{path}/{name}", schema, ["race_id"], parts)

        return cls(
            kept("entries", league.races_drivers.schema),
            kept("penalties", penalties_by_race(league).schema),
            kept("scores", results.scored_entries(league).schema),
            kept("team_scores", championship.team_race_points(league).schema),
        )

    def create(self, league: League) -> Standings:
        """Write all of a league, races that nobody entered included."""
        self.entries.create(league.races_drivers)
        self.penalties.create(penalties_by_race(league))
        self.scores.create(results.scored_entries(league))
        self.team_scores.create(championship.team_race_points(league))
        return self

    def post_entries(self, entries: DataFrame, league: League, posting: str | None = None) -> bool:
        """Replace the entries of the races that ``entries`` holds, and score these races anew."""
        races = entries.select("race_id").distinct()
        done = replace_races(self.entries, races, entries, posting)
        if done:
            self.refresh(races, league)
        return done

    def post_penalties(self, given: DataFrame, league: League, posting: str | None = None) -> bool:
        """Add penalties (race_id, report_id, driver_id, time, penalty_points, is_dsq), and score their races anew.

        A driver has one penalty for a report; one that is there already stays. A disqualification marks the entry.
        """
        races = given.select("race_id").distinct()

        def add(old: DataFrame) -> DataFrame:
            return given.select(*old.columns).join(old.select(*GIVEN), GIVEN, "left_anti")

        done = self.penalties.merge(races, add, posting, stays=lambda old: old)
        if done:
            excluded = given.filter("is_dsq").select(*ENTRY).distinct().withColumn("excluded", F.lit(True))

            def mark(old: DataFrame) -> DataFrame:
                return old.join(excluded, ENTRY, "left").withColumn("is_dsq", F.coalesce("excluded", "is_dsq"))

            self.entries.merge(excluded, mark)
            self.refresh(races, league)
        return done

    def refresh(self, races: DataFrame, league: League) -> None:
        """Rank and score the given races from the parts that hold them."""
        some = self.of_races(races, league)
        replace_races(self.scores, races, results.scored_entries(some))
        replace_races(self.team_scores, races, championship.team_race_points(some))

    def of_races(self, races: DataFrame, league: League) -> League:
        """The league of some races, from their parts."""
        spark = races.sparkSession
        parts = self.entries.touched(races)
        named = F.broadcast(races)
        entries, penalties = (t.read(spark, parts).join(named, "race_id", "left_semi") for t in (self.entries, self.penalties))
        # these penalties know their race, so no report is looked up
        return league.replacing(races_drivers=entries, penalties=penalties)

    def driver_standings_long(self, league: League, as_of: object) -> DataFrame:
        return championship.driver_standings_long(league, as_of, scored=self.scores.read(_session(league)))

    def constructor_standings(self, league: League) -> DataFrame:
        return championship.constructor_standings(league, team_points=self.team_scores.read(_session(league)))


def replace_races(table: Kept, races: DataFrame, rows: DataFrame, posting: str | None = None) -> bool:
    """Replace what a table kept by race holds of ``races`` (race_id, each once) by ``rows``."""
    named = F.broadcast(races)
    return table.merge(
        races,
        lambda old: rows.select(*old.columns),
        posting,
        stays=lambda old: old.join(named, "race_id", "left_anti"),
    )


def _session(league: League) -> SparkSession:
    return league.races.sparkSession


def penalties_by_race(league: League) -> DataFrame:
    """Penalties with the race of their report."""
    races = league.reports.select(F.col("id").alias("report_id"), "race_id")
    return league.penalties.join(races, "report_id").select(*GIVEN, "time", "penalty_points", "is_dsq")


@dataclass(frozen=True)
class Roster:
    """The season line-ups, kept by season and driver."""

    seats: Kept

    @classmethod
    def at(cls, path: str, league: League, parts: int = PARTS) -> Roster:
        return cls(Kept(path, league.seasons_drivers.schema, ingest.SEAT, parts))

    def change(self, changes: DataFrame, seasons: DataFrame, posting: str | None = None) -> bool:
        """``ingest.upsert_lineup`` over the parts that the changes name; its rejects don't depend on other parts."""
        named = changes.join(seasons.select(F.col("id").alias("season_id"), F.col("name").alias("season_name")), "season_name")
        keys = named.filter(F.col("driver_id").isNotNull()).select(*ingest.SEAT)
        return self.seats.merge(keys, lambda old: ingest.upsert_lineup(old, changes, seasons)[0], posting)


def change_kept(table: Kept, changes: DataFrame, posting: str | None = None, seq: str = "seq") -> bool:
    """``ingest.apply_changes`` over the parts that the changes name."""
    keys: Sequence[str] = table.keys
    named = changes.dropna(subset=[*keys])
    return table.merge(named, lambda old: ingest.apply_changes(old, named, keys, seq)[0], posting)


def replace_kept_entries(table: Kept, lists: DataFrame, league: League, posting: str | None = None) -> bool:
    """``ingest.replace_race_entries`` over the parts of the posted races."""
    fresh, _ = ingest.checked_entries(lists, league.races, league.drivers, league.teams)
    races = fresh.select("race_id").distinct()
    return replace_races(table, races, fresh, posting)
