"""Checks of keys, references, identifiers and lengths; each returns the offending rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.functions.text import is_canonical_uuid
from paddock.schema import FOREIGN_KEYS, MAX_LENGTHS, UNIQUE_KEYS
from paddock.session import dealt
from paddock.sources.tables import League


def duplicates(rows: DataFrame, keys: Sequence[str], within: Sequence[str] = ()) -> DataFrame:
    """Key values that occur more than once ``within`` equal values of other columns; a key with a null is never a duplicate.

    Most keys occur once, so rows are dealt by key before they are counted.
    """
    present = rows.select(*within, *keys).dropna(subset=list(keys))
    return dealt(present, *keys).groupBy(*within, *keys).agg(F.count(F.lit(1)).alias("copies")).filter(F.col("copies") > 1)


def dq_duplicate_keys(league: League) -> DataFrame:
    """Duplicated keys of all tables; keys of the same types are counted in one pass, under the number of their check."""
    checks = [(table, key) for table, keys in UNIQUE_KEYS.items() for key in keys]
    alike: dict[tuple[str, ...], list[DataFrame]] = {}
    for number, (table, key) in enumerate(checks):
        rows = getattr(league, table)
        kinds = tuple(rows.schema[c].dataType.simpleString() for c in key)
        values = [F.col(c).alias(f"key{k}") for k, c in enumerate(key)]
        alike.setdefault(kinds, []).append(rows.select(F.lit(number).alias("check"), *values))
    names = F.array(*[F.struct(F.lit(t).alias("table_name"), F.lit(",".join(k)).alias("key_columns")) for t, k in checks])
    found = []
    for kinds, rows in alike.items():
        keys = [f"key{k}" for k in range(len(kinds))]
        found.append(
            duplicates(reduce(DataFrame.unionByName, rows), keys, ["check"]).select(
                names[F.col("check")]["table_name"].alias("table_name"),
                names[F.col("check")]["key_columns"].alias("key_columns"),
                F.concat_ws("|", *[F.col(c).cast("string") for c in keys]).alias("key_value"),
                "copies",
            )
        )
    return reduce(DataFrame.unionByName, found)


def orphans(child: DataFrame, column: str, parent: DataFrame) -> DataFrame:
    """Child rows whose reference has no parent; a null reference is no reference."""
    keys = parent.select(F.col("id").alias(column))
    return child.filter(F.col(column).isNotNull()).join(keys, column, "left_anti")


def dq_orphans(league: League) -> DataFrame:
    """Dangling references of all tables, counted per value.

    Each child table is read once for all its references, and values are counted before they look for a parent, so
    neither the rows of a table nor those of a frequent value are shuffled.
    """
    by_child: dict[str, list[tuple[str, str]]] = {}
    for child, column, parent in FOREIGN_KEYS:
        by_child.setdefault(child, []).append((column, parent))
    found = []
    for child, references in by_child.items():
        items = [
            F.struct(F.lit(c).alias("column_name"), F.lit(p).alias("parent_table"), F.col(c).cast("string").alias("value"))
            for c, p in references
        ]
        rows = getattr(league, child).select(F.lit(child).alias("table_name"), F.inline(F.array(*items)))
        found.append(rows.filter(F.col("value").isNotNull()))
    values = reduce(DataFrame.unionByName, found).groupBy("table_name", "column_name", "parent_table", "value")
    parents = [
        getattr(league, parent).select(F.lit(parent).alias("parent_table"), F.col("id").cast("string").alias("value"))
        for parent in sorted({p for _, _, p in FOREIGN_KEYS})
    ]
    known = reduce(DataFrame.unionByName, parents)
    return values.agg(F.count(F.lit(1)).alias("row_count")).join(known, ["parent_table", "value"], "left_anti").select(
        "table_name", "column_name", "parent_table", "value", "row_count"
    )


def dq_uuid(rows: DataFrame, column: str) -> DataFrame:
    """Rows whose identifier is not a canonical UUID."""
    return rows.filter(~is_canonical_uuid(F.col(column)))


def dq_driver_two_teams(entries: DataFrame) -> DataFrame:
    """Drivers listed more than once in a race."""
    return (
        entries.groupBy("race_id", "driver_id")
        .agg(F.count(F.lit(1)).alias("times_listed"))
        .filter(F.col("times_listed") > 1)
    )


def too_long(rows: DataFrame, column: str, longest: int) -> DataFrame:
    return rows.filter(F.char_length(column) > longest)


def dq_length(league: League) -> DataFrame:
    """Texts longer than their column allows."""
    found = [
        too_long(getattr(league, table), column, longest).select(
            F.lit(table).alias("table_name"),
            F.lit(column).alias("column_name"),
            F.col("id").cast("string").alias("id"),
            F.char_length(column).alias("length"),
            F.lit(longest).alias("max_length"),
        )
        for table, columns in MAX_LENGTHS.items()
        for column, longest in columns.items()
    ]
    return reduce(DataFrame.unionByName, found)


def dq_one_fastest_lap(entries: DataFrame) -> DataFrame:
    """Races with any time whose number of fastest laps is not one."""
    return (
        entries.groupBy("race_id")
        .agg(F.count_if("has_fastest_lap").alias("fastest_laps"), F.count("time").alias("timed"))
        .filter((F.col("timed") > 0) & (F.col("fastest_laps") != 1))
    )
