"""The league's tables: reading, looking up and writing."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.text import decode_name
from paddock.schema import TABLES, columns


class League:
    """The league's tables as attributes, each built on first use."""

    def __init__(self, builders: Mapping[str, Callable[[League], DataFrame]]) -> None:
        self._builders = dict(builders)

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_") or name not in self._builders:
            raise AttributeError(name)
        table = self._builders[name](self)
        self.__dict__[name] = table
        return table

    def tables(self) -> dict[str, DataFrame]:
        return {name: getattr(self, name) for name in self._builders}

    def replacing(self, **tables: DataFrame) -> League:
        """The same league with some tables replaced."""
        builders = {name: (lambda _, name=name: getattr(self, name)) for name in self._builders}
        return League(builders | {name: (lambda _, rows=rows: rows) for name, rows in tables.items()})


def conformed(league: League) -> League:
    """The same league with the columns and types of a live one: keys are strings there."""

    def table(name: str) -> DataFrame:
        rows = getattr(league, name)
        return rows.select(*[F.col(c).cast(k).alias(c) for c, k in (x.split() for x in TABLES[name].split(","))])

    return League({name: (lambda _, name=name: table(name)) for name in TABLES})


def league_of(**tables: DataFrame) -> League:
    return League({name: (lambda _, rows=rows: rows) for name, rows in tables.items()})


def load_league(spark: SparkSession, path: str) -> League:
    """Read a league kept as one Parquet folder per table."""
    return League(
        {
            name: (lambda _, name=name: spark.read.schema(TABLES[name]).parquet(f"{path}/{name}"))
            for name in TABLES
        }
    )


def load_league_jdbc(
    spark: SparkSession,
    options: Mapping[str, str],
    partitioning: Mapping[str, Mapping[str, str]] | None = None,
) -> League:
    """Read a live league database.

    ``partitioning`` gives a table's ``partitionColumn``, ``lowerBound``, ``upperBound`` and
    ``numPartitions``, so that large tables are read by many tasks.
    """

    def table(name: str) -> DataFrame:
        extra = dict((partitioning or {}).get(name, {}))
        reader = spark.read.format("jdbc").options(**options, **extra).option("dbtable", name)
        return reader.load().select(*columns(name))

    return League({name: (lambda _, name=name: table(name)) for name in TABLES})


def table_sizes(league: League) -> DataFrame:
    """Rows of every table."""
    counts = [
        rows.agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(name).alias("table_name"), "row_count")
        for name, rows in league.tables().items()
    ]
    result = counts[0]
    for other in counts[1:]:
        result = result.unionByName(other)
    return result


def lookup(rows: DataFrame, **keys: object) -> DataFrame:
    """Rows with the given column values; the filter reaches the scan."""
    for column, value in keys.items():
        rows = rows.filter(F.col(column) == F.lit(value))
    return rows


def season_by_name(names: DataFrame, seasons: DataFrame, encoded: Column | str = "encoded_name") -> DataFrame:
    """Season ids of percent-encoded season names; unknown names have no row."""
    text = F.col(encoded) if isinstance(encoded, str) else encoded
    wanted = names.withColumn("season_name", decode_name(text))
    return wanted.join(
        seasons.select(F.col("id").alias("season_id"), F.col("name").alias("season_name")), "season_name"
    )


def of_season(league: League, season_name: str) -> League:
    """The same league seen through one season; the filter reaches races, rosters, entries and all that hangs on reports."""
    seasons = league.seasons.filter(F.col("name") == season_name)
    chosen = seasons.select(F.col("id").alias("season_id"))
    races = league.races.join(chosen, "season_id", "left_semi")
    race_ids = races.select(F.col("id").alias("race_id"))
    reports = league.reports.join(race_ids, "race_id", "left_semi")
    report_ids = reports.select(F.col("id").alias("report_id"))
    return league.replacing(
        seasons=seasons,
        races=races,
        seasons_drivers=league.seasons_drivers.join(chosen, "season_id", "left_semi"),
        races_drivers=league.races_drivers.join(race_ids, "race_id", "left_semi"),
        reports=reports,
        report_targets=league.report_targets.join(report_ids, "report_id", "left_semi"),
        report_responses=league.report_responses.join(report_ids, "report_id", "left_semi"),
        penalties=league.penalties.join(report_ids, "report_id", "left_semi"),
    )


def write_league(league: League, path: str) -> None:
    for name, rows in league.tables().items():
        rows.write.mode("errorifexists").parquet(f"{path}/{name}")


def write_json(rows: DataFrame, path: str, compression: str = "gzip") -> None:
    """One JSON object per line, nulls written out; ``compression`` may be ``none`` for readers of plain text."""
    rows.write.options(ignoreNullFields="false", compression=compression).json(path)


def replace_partitions(rows: DataFrame, path: str, *columns: str) -> None:
    """Overwrite only the partitions ``rows`` holds; ``rows`` may read from ``path``, as new files lie aside until all are written."""
    writer = rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").option("compression", "zstd")
    writer.partitionBy(*columns).parquet(path)
