"""Positions inside a group, nesting of children, and lists for every season.

Which plan numbers the rows of a group is decided where the operator is written, never by the size of the data:
``rank_bounded`` sorts a group in one task and is for groups that a dimension bounds (the races, seats or teams of a
season); ``rank_spread`` is for facts (entries and reports of a race), of which one group may hold most rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys that agree in so many first letters, or after division by so much, are sorted by one task.
PREFIX_LETTERS = 4
PREFIX_NUMBERS = 1024


def rank_bounded(rows: DataFrame, keys: Sequence[str], order: Sequence[Column], out: str) -> DataFrame:
    """Number the rows of each group 1, 2, 3... in ``order``, which must leave no ties."""
    return rows.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def rank_spread(
    rows: DataFrame, keys: Sequence[str], order: Sequence[Column], buckets: Sequence[Column], out: str
) -> DataFrame:
    """The same numbers where a group may be large.

    ``buckets`` are columns without nulls that rise with ``order``; they depend on the row alone. A row's number is its
    place among the rows of its bucket, which one task sorts, plus the rows in earlier buckets of its group, of which
    only counts are added up.
    """
    names = [f"_{out}_bucket{k}" for k in range(len(buckets))]
    cut = rows.withColumns(dict(zip(names, buckets, strict=True)))
    sizes = cut.groupBy(*keys, *names).agg(F.count(F.lit(1)).alias("_size"))
    earlier = Window.partitionBy(*keys).orderBy(*names).rowsBetween(Window.unboundedPreceding, -1)
    before = sizes.withColumn("_before", F.coalesce(F.sum("_size").over(earlier), F.lit(0))).drop("_size")
    own = Window.partitionBy(*keys, *names).orderBy(*order)
    numbered = cut.withColumn("_own", F.row_number().over(own)).alias("n")
    same = [F.col(f"n.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    same += [F.col(f"n.{k}") == F.col(f"b.{k}") for k in names]
    number = (F.col("_own") + F.col("_before")).cast("int")
    joined = numbered.join(before.alias("b"), same)
    return joined.select(*[F.col(f"n.{c}").alias(c) for c in rows.columns], number.alias(out))


def prefix(rows: DataFrame, column: str) -> Column:
    """What many neighbouring keys have in common; rises with the key, and nulls come first."""
    kind = rows.schema[column].dataType
    if isinstance(kind, T.StringType):
        return F.coalesce(F.substring(column, 1, PREFIX_LETTERS), F.lit(""))
    if isinstance(kind, T.IntegralType):
        return F.coalesce(F.floor(F.col(column) / PREFIX_NUMBERS), F.lit(-(1 << 62)))
    return F.lit(0)


@dataclass(frozen=True)
class Children:
    """Rows to nest under a parent, in rising ``order`` with nulls last, and the fields kept."""

    rows: DataFrame
    order: Sequence[str | Column]
    fields: Sequence[str]

    def names(self) -> list[str | None]:
        """Of each place of the order the column, if it is one by name."""
        return [c if isinstance(c, str) else None for c in self.order]


def nest(keys: Sequence[str], parents: DataFrame | None = None, **children: Children) -> DataFrame:
    """Children as ordered arrays, one row per group whatever their number, several kinds in one pass.

    ``parents`` adds groups without children. The arrays are the result's own size; where a group may have more children
    than a row should hold, read the children's own rows instead. A field that the order names is shuffled once.
    """
    pieces = []
    for out, child in children.items():
        order = [F.col(c) if isinstance(c, str) else c for c in child.order]
        places = [F.struct(c.isNull().alias("none"), c.alias("value")).alias(f"o{k}") for k, c in enumerate(order)]
        rest = [F.col(c).alias(c) for c in child.fields if c not in child.names()]
        pieces.append(child.rows.select(*keys, F.struct(*places, *rest).alias(out)))
    if parents is not None:
        pieces.append(parents.select(*keys))
    together = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), pieces)
    # collect_list leaves out the nulls of the other kinds
    lists = together.groupBy(*keys).agg(*[F.sort_array(F.collect_list(out)).alias(out) for out in children])

    def kept(child: Children) -> Callable[[Column], Column]:
        def field(item: Column, name: str) -> Column:
            return item[f"o{child.names().index(name)}"]["value"] if name in child.names() else item[name]

        return lambda item: F.struct(*[field(item, name).alias(name) for name in child.fields])

    return lists.select(*keys, *[F.transform(out, kept(child)).alias(out) for out, child in children.items()])


def in_order(item: Column) -> Column:
    return F.transform(F.sort_array(F.collect_list(item)), lambda c: c["_child"])


def season_ids(seasons: DataFrame) -> Column:
    """All seasons as one array, from a subquery."""
    return seasons.agg(F.sort_array(F.collect_set("id")).alias("ids")).scalar()


def in_every_season(rows: DataFrame, seasons: DataFrame) -> DataFrame:
    """Each row of a dimension once per season, for tables that list all of it."""
    return rows.withColumn("season_id", F.explode(season_ids(seasons)))


def seasons_without(rows: DataFrame, key: str, taken: DataFrame, seasons: DataFrame) -> DataFrame:
    """``rows`` with ``absent_from``, the seasons in which ``taken`` has no row of their ``key``.

    One row stays one row; exploding the list is the caller's choice.
    """
    present = taken.groupBy(key).agg(F.collect_set("season_id").alias("_present"))
    absent = F.array_except(season_ids(seasons), F.coalesce("_present", F.array()))
    return rows.join(present, key, "left").withColumn("absent_from", absent).drop("_present")
