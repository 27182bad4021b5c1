"""A league derived from the order tables in a test-data folder (rules in FIXTURES.md)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.text import steward_role_name
from paddock.session import dealt, store
from paddock.sources.tables import League

AS_OF = "2000-06-15 00:00:00"
FIRST_SEASON = 1995

# A video address per host rule, chosen by report id.
VIDEO_ADDRESSES = (
    "https://www.youtube.com/watch?v=v%d&t=30",
    "https://www.youtube.com/live/v%d",
    "https://youtu.be/v%d",
    "https://streamable.com/s%d",
    "https://medal.tv/games/x/clips/m%d",
    "https://outplayed.tv/o%d",
    "https://clips.twitch.tv/t%d",
)

# Derived tables are written once per application and folder, then read by every query.
_leagues: dict[tuple[str, str], League] = {}


class _Folder:
    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/{name}.parquet")


def _race_id(date: Column, priority: Column) -> Column:
    sprint = F.when(priority == "1-URGENT", 1).otherwise(0)
    return F.year(date) * 1000 + F.month(date) * 10 + sprint


def _races(src: _Folder) -> DataFrame:
    """One race per month and kind; sprint and feature share a date."""
    orders = src.raw("orders")
    months = orders.select(
        F.year("o_orderdate").alias("season_id"),
        F.month("o_orderdate").alias("month"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_sprint"),
    ).distinct()
    return months.select(
        (F.col("season_id") * 1000 + F.col("month") * 10 + F.col("is_sprint").cast("int")).alias("id"),
        F.expr("make_timestamp_ntz(season_id, month, 1, 18, 0, 0)").alias("date"),
        "is_sprint",
        F.col("month").cast("bigint").alias("track_id"),
        "season_id",
    )


def _entries(src: _Folder) -> DataFrame:
    """An entry per race and supplier that shipped in it."""
    shipped = src.raw("lineitem").join(
        src.raw("orders").select(
            F.col("o_orderkey").alias("l_orderkey"),
            _race_id(F.col("o_orderdate"), F.col("o_orderpriority")).alias("race_id"),
        ),
        "l_orderkey",
    ).select("race_id", F.col("l_suppkey").alias("driver_id"), "l_partkey", "l_extendedprice", "l_quantity")
    grouped = dealt(shipped.drop("l_quantity"), "race_id", "driver_id").groupBy("race_id", "driver_id").agg(
        F.sum("l_partkey").alias("k"), F.min("l_extendedprice").alias("price")
    )
    # the fastest lap goes to the largest quantity, then the lowest driver, found without sorting or grouping a race's entries
    most = shipped.groupBy("race_id").agg(F.max("l_quantity").alias("most"))
    fastest = (
        shipped.join(F.broadcast(most), "race_id")
        .filter(F.col("l_quantity").eqNullSafe(F.col("most")))
        .groupBy("race_id")
        .agg(F.min("driver_id").alias("best"))
    )
    suppliers = src.raw("supplier").select(
        F.col("s_suppkey").alias("driver_id"), F.col("s_nationkey").alias("team_id")
    )
    return (
        grouped.join(F.broadcast(fastest), "race_id")
        .join(suppliers, "driver_id")
        .select(
            "race_id",
            "driver_id",
            "team_id",
            F.when(F.col("k") % 10 != 0, 4800 + F.floor(F.col("price") / 25) / 4).cast("double").alias("time"),
            (F.col("k") % 3).cast("int").alias("plus_laps"),
            (F.col("driver_id") == F.col("best")).alias("has_fastest_lap"),
            (F.col("k") % 37 == 1).alias("is_dsq"),
        )
    )


def _roster(entries: DataFrame, races: DataFrame) -> DataFrame:
    """Drivers that entered a season, except that nation n sits out season 1995 + n."""
    seen = entries.join(races.select(F.col("id").alias("race_id"), "season_id"), "race_id")
    seats = seen.select("driver_id", "season_id", "team_id").distinct()
    reserve = F.col("driver_id") % 5 == 4
    return seats.filter(F.col("team_id") != F.col("season_id") - FIRST_SEASON).select(
        "driver_id",
        "season_id",
        F.when(~reserve, F.col("team_id")).alias("team_id"),
        reserve.alias("is_reserve"),
    )


def _address(pattern: str, number: Column) -> Column:
    before, after = pattern.split("%d")
    return F.concat(F.lit(before), number.cast("string"), F.lit(after))


def _video_path(number: Column) -> Column:
    address = F.lit(None).cast("string")
    for kind, pattern in enumerate(VIDEO_ADDRESSES):
        address = F.when(number % 7 == kind, _address(pattern, number)).otherwise(address)
    second = _address("++https://example.com/%d", number)
    upload = _address("++/media/reports/%d.mp4", number)
    elsewhere = _address("++https://clips.example/media/%d", number)
    return F.concat(
        address,
        F.when(number % 3 == 0, second).otherwise(F.lit("")),
        F.when(number % 5 == 0, upload).when(number % 5 == 1, elsewhere).otherwise(F.lit("")),
    )


def _hours(hours: Column) -> Column:
    return F.make_dt_interval(F.lit(0), hours.cast("int"))


def _reports(src: _Folder) -> DataFrame:
    """Every order with line items is a report by its lowest supplier."""
    senders = src.raw("lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(
        F.min("l_suppkey").alias("from_driver")
    )
    orders = src.raw("orders").select(
        F.col("o_orderkey").alias("id"),
        _race_id(F.col("o_orderdate"), F.col("o_orderpriority")).alias("race_id"),
        F.expr("make_timestamp_ntz(year(o_orderdate), month(o_orderdate), 1, 18, 0, 0)").alias("date"),
        "o_orderstatus",
    )
    number = F.col("id").cast("string")
    return orders.join(senders, "id").select(
        "id",
        "race_id",
        "from_driver",
        F.concat(F.lit("report "), number).alias("content"),
        _video_path(F.col("id")).alias("video_path"),
        F.when(F.col("o_orderstatus") != "O", F.concat(F.lit("verdict "), number)).alias("verdict"),
        (F.col("date") + _hours(F.floor(F.col("id") / 20) % 60 - 6)).alias("created_at"),
    )


def _targets(src: _Folder, reports: DataFrame) -> DataFrame:
    """The order's other suppliers; an order with one supplier is about the game.

    With what penalties and responses need of the report, ``is_decided`` and ``sent_at``. The line items are dealt by
    order once, for their pairs, the last of an order and the join.
    """
    suppliers = dealt(
        src.raw("lineitem").select(F.col("l_orderkey").alias("report_id"), F.col("l_suppkey").alias("driver_id")),
        "report_id",
    )
    last = suppliers.groupBy("report_id").agg(F.max("driver_id").alias("last_driver"))
    sender = reports.select(
        F.col("id").alias("report_id"),
        "from_driver",
        F.col("verdict").isNotNull().alias("is_decided"),
        F.col("created_at").alias("sent_at"),
    ).join(last, "report_id")
    alone = F.col("from_driver") == F.col("last_driver")
    return (
        suppliers.distinct()
        .join(sender, "report_id")
        .filter(alone | (F.col("driver_id") != F.col("from_driver")))
        .select("report_id", F.when(~alone, F.col("driver_id")).alias("driver_id"), "is_decided", "sent_at")
    )


def _penalties(targets: DataFrame) -> DataFrame:
    """One penalty per target of a decided report."""
    s = F.col("driver_id") + F.col("report_id")
    return targets.filter(F.col("driver_id").isNotNull() & F.col("is_decided")).select(
        "report_id",
        "driver_id",
        F.when(s % 7 != 0, s % 4 * 5).cast("int").alias("time"),
        (s % 4).cast("int").alias("penalty_points"),
        (s % 29 == 0).alias("is_dsq"),
    )


def _responses(targets: DataFrame) -> DataFrame:
    """Every named target answers up to two days later."""
    hours = (F.col("driver_id") * 7 + F.col("report_id")) % 48
    return targets.filter(F.col("driver_id").isNotNull()).select(
        F.concat_ws("-", "report_id", "driver_id").alias("id"),
        "report_id",
        F.col("driver_id").alias("from_driver"),
        F.format_string("response %d to %d", "driver_id", "report_id").alias("content"),
        _video_path(F.col("driver_id")).alias("video_path"),
        (F.col("sent_at") + _hours(hours)).alias("created_at"),
    )


def _seasons(races: DataFrame) -> DataFrame:
    return races.select("season_id").distinct().select(
        F.col("season_id").alias("id"),
        F.format_string("Season %d", "season_id").alias("name"),
        F.col("season_id").alias("fia_role_id"),
    )


def _drivers(src: _Folder) -> DataFrame:
    return src.raw("supplier").select(F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"))


def _teams(src: _Folder) -> DataFrame:
    nation = F.col("n_nationkey")
    return src.raw("nation").select(
        nation.alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("#"), F.lpad((nation * 40503 % 1000000).cast("string"), 6, "0")).alias("color"),
        F.concat(F.lit("icon"), nation.cast("string")).alias("icon"),
    )


def _tracks(src: _Folder) -> DataFrame:
    return src.raw("part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("flag"),
        F.lit(None).cast("string").alias("image"),
        F.format_string("GP %d", "p_partkey").alias("race_name"),
        F.col("p_type").alias("emoji"),
    )


def _users(src: _Folder) -> DataFrame:
    """A customer drives as the supplier of the same number, except in one market segment."""
    drivers = src.raw("supplier").select(F.col("s_suppkey").alias("driver_key"))
    customers = src.raw("customer").join(drivers, F.col("c_custkey") == F.col("driver_key"), "left")
    return customers.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("username"),
        F.when(F.col("c_mktsegment") != "MACHINERY", F.col("driver_key")).alias("driver_id"),
        F.when(F.col("c_acctbal") >= 5000, F.col("c_custkey")).alias("discord_account_id"),
    )


def _roles(src: _Folder, seasons: DataFrame) -> DataFrame:
    stewards = seasons.select("id", steward_role_name(F.col("name")).alias("name"))
    regions = src.raw("region").select(F.col("r_regionkey").alias("id"), F.col("r_name").alias("name"))
    return stewards.unionByName(regions)


def _users_roles(src: _Folder) -> DataFrame:
    """Builders are stewards of a season; everybody holds the role of a region."""
    user = F.col("c_custkey").alias("user_id")
    season = (F.col("c_custkey") % 7 + FIRST_SEASON).cast("int").alias("role_id")
    stewards = src.raw("customer").filter(F.col("c_mktsegment") == "BUILDING").select(user, season)
    return stewards.unionByName(
        src.raw("customer").select(user, (F.col("c_nationkey") % 5).alias("role_id"))
    )


def _accounts(src: _Folder) -> DataFrame:
    key = F.col("c_custkey")
    return src.raw("customer").select(
        key.alias("id"),
        (key + 1000000000000000).alias("discord_id"),
        F.when(F.col("c_mktsegment") != "FURNITURE", key).alias("user_id"),
    )


def league(spark: SparkSession, path: str) -> League:
    """The league of a test-data folder."""
    key = (spark.sparkContext.applicationId, path)
    if key not in _leagues:
        src = _Folder(spark, path)
        aimed: list[DataFrame] = []  # targets with their report's state: written once, read by three tables

        def targets(lg: League) -> DataFrame:
            if not aimed:
                aimed.append(store(_targets(src, lg.reports), "report_targets"))
            return aimed[0]

        _leagues[key] = League(
            {
                "drivers": lambda lg: _drivers(src),
                "teams": lambda lg: _teams(src),
                "tracks": lambda lg: _tracks(src),
                "seasons": lambda lg: store(_seasons(lg.races), "seasons"),
                "seasons_drivers": lambda lg: store(_roster(lg.races_drivers, lg.races), "seasons_drivers"),
                "races": lambda lg: store(_races(src), "races"),
                "races_drivers": lambda lg: store(_entries(src), "races_drivers"),
                "reports": lambda lg: store(_reports(src), "reports"),
                "report_targets": lambda lg: targets(lg).select("report_id", "driver_id"),
                "report_responses": lambda lg: _responses(targets(lg)),
                "penalties": lambda lg: _penalties(targets(lg)),
                "users": lambda lg: _users(src),
                "roles": lambda lg: _roles(src, lg.seasons),
                "users_roles": lambda lg: _users_roles(src),
                "discord_accounts": lambda lg: _accounts(src),
            }
        )
    return _leagues[key]
