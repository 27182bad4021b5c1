"""Session settings and the folder all executors share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Mapping
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # split a skewed join even where the split costs one more shuffle
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
}
#: Shuffle files of a query go when it ends. Else they stay until the driver happens to collect its garbage.
TIDY = {"spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true"}


def build(master: str | None = None, **settings: str) -> SparkSession:
    builder = SparkSession.builder.appName("paddock")
    if master:
        builder = builder.master(master)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@contextmanager
def settings(spark: SparkSession, values: Mapping[str, str]) -> Iterator[None]:
    """Settings that hold for the queries planned, and the streams started, inside."""
    before = {key: spark.conf.get(key, None) for key in values}
    try:
        for key, value in values.items():
            spark.conf.set(key, value)
        yield
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)


def shared_folder(spark: SparkSession) -> str:
    """This application's folder under the directory the cluster names for checkpoints, or else in the warehouse."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    return f"{root}/paddock/{spark.sparkContext.applicationId}"


def new_folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Rows with equal keys in one of as many parts as the session shuffles into, to be counted or summed there.

    For keys of which most are rare: a task that reads many rows would keep a hash table of nearly all of them before the
    shuffle. The number of parts is given, as adaptive execution merges parts by compressed bytes, and 64 MB of short rows
    are millions.
    """
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def store(rows: DataFrame, name: str) -> DataFrame:
    """Write ``rows`` to the shared folder once and read them back.

    The written files survive a lost executor, and give the planner real sizes.
    """
    spark = rows.sparkSession
    path = new_folder(spark, name)
    with settings(spark, TIDY):
        rows.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(rows.schema).parquet(path)
