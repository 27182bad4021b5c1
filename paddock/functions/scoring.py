"""Championship points as a Column expression."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points by finishing position.
FEATURE_POINTS = (25, 18, 15, 12, 10, 8, 6, 4, 2, 1)
SPRINT_POINTS = (8, 7, 6, 5, 4, 3, 2, 1)
FASTEST_LAP_POINTS = 1
FASTEST_LAP_LAST_RANK = 10


def _by_rank(table: Sequence[int], rank: Column) -> Column:
    points = F.array(*[F.lit(p) for p in table])
    return F.coalesce(F.get(points, (rank - 1).cast("int")), F.lit(0))


def position_points(
    rank: Column,
    is_sprint: Column,
    feature: Sequence[int] = FEATURE_POINTS,
    sprint: Sequence[int] = SPRINT_POINTS,
) -> Column:
    """Points of a position; a race whose kind is unknown scores as a feature."""
    return F.when(is_sprint, _by_rank(sprint, rank)).otherwise(_by_rank(feature, rank))


def fastest_lap_points(rank: Column, is_sprint: Column) -> Column:
    """Bonus for the fastest lap: feature races only, unknown kind gets none."""
    earns = (rank <= FASTEST_LAP_LAST_RANK) & ~is_sprint
    return F.when(earns, F.lit(FASTEST_LAP_POINTS)).otherwise(F.lit(0))


def is_classified(time: Column, is_dsq: Column) -> Column:
    """True where the entry finished and was not disqualified (null DSQ counts as no)."""
    return time.isNotNull() & ~F.coalesce(is_dsq, F.lit(False))


def points_for(
    rank: Column,
    is_sprint: Column,
    time: Column,
    is_dsq: Column,
    has_fastest_lap: Column,
    feature: Sequence[int] = FEATURE_POINTS,
    sprint: Sequence[int] = SPRINT_POINTS,
) -> Column:
    """Points of one entry: position plus fastest-lap bonus, 0 for DNF and DSQ."""
    bonus = F.when(has_fastest_lap, fastest_lap_points(rank, is_sprint)).otherwise(F.lit(0))
    earned = position_points(rank, is_sprint, feature, sprint) + bonus
    return F.when(is_classified(time, is_dsq), earned).otherwise(F.lit(0)).cast("bigint")
