"""Users, their roles, and season stewards."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paddock.operators.ranking import Children, nest, seasons_without
from paddock.sources.tables import League


def _driving_users(league: League) -> DataFrame:
    drivers = league.drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    return league.users.select(F.col("id").alias("user_id"), "username", "driver_id").join(drivers, "driver_id")


def _named_roles(league: League) -> DataFrame:
    roles = league.roles.select(F.col("id").alias("role_id"), F.col("name").alias("role_name"))
    return league.users_roles.join(roles, "role_id")


def steward_candidates(league: League) -> DataFrame:
    """Users with a driver, and the seasons in which the driver has no seat (``absent_from``)."""
    seats = league.seasons_drivers.select("season_id", "driver_id")
    return seasons_without(_driving_users(league), "driver_id", seats, league.seasons).select(
        "user_id", "driver_name", "absent_from"
    )


def current_stewards(league: League) -> DataFrame:
    """Users holding a season's steward role."""
    seasons = league.seasons.select(F.col("id").alias("season_id"), F.col("fia_role_id").alias("role_id"))
    return (
        league.users_roles.join(seasons, "role_id")
        .join(_driving_users(league), "user_id")
        .select("season_id", "user_id", "driver_name")
    )


def role_list(league: League) -> DataFrame:
    return league.roles.select("id", "name")


def user_role_names(league: League) -> DataFrame:
    """Role names of each user."""
    return _named_roles(league).select("user_id", "role_name")


def users_with_roles(league: League) -> DataFrame:
    """Users with driver and roles; users without either are kept."""
    drivers = league.drivers.select(F.col("id").alias("driver_id"), F.col("name").alias("driver_name"))
    users = league.users.select(F.col("id").alias("user_id"), "username", "driver_id")
    roles = Children(_named_roles(league), ["role_id"], ["role_id", "role_name"])
    lists = nest(["user_id"], parents=users, roles=roles)
    return (
        users.join(drivers, "driver_id", "left")
        .join(lists, "user_id")
        .select("user_id", "username", "driver_id", "driver_name", "roles")
    )
