"""Numbers of reports in their race, kept by a stream as counts, so that a report is numbered without the race's others.

A report's number is the count of the race's reports in earlier minutes, plus its place among those of its own minute. The
stream keeps both in parts: counts by race and minute, and the reports of a race's minute. A micro-batch reads and replaces the
parts of its own races and minutes only, and a lookup reads the counts of the races and the reports of the minutes it asks for.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from paddock.sources.kept import PARTS, Kept
from paddock.streaming import gates

#: The minute of reports without a time, which are numbered last.
UNKNOWN = "9999-12-31 23:59:00"
MINUTE = ["race_id", "minute"]


def _minute(created_at: str, rows: DataFrame) -> DataFrame:
    kind = rows.schema[created_at].dataType
    return rows.withColumn("minute", F.coalesce(F.date_trunc("minute", created_at).cast(kind), F.lit(UNKNOWN).cast(kind)))


@dataclass(frozen=True)
class Numbers:
    """The index under ``path`` for reports of ``schema`` (id, race_id, created_at and more)."""

    path: str
    schema: T.StructType
    parts: int = PARTS

    @property
    def counts(self) -> Kept:
        race, minute = self.schema["race_id"], T.StructField("minute", self.schema["created_at"].dataType)
        fields = [race, minute, T.StructField("n", T.LongType())]
        return Kept(f"{self.path}/counts", T.StructType(fields), ["race_id"], self.parts)

    @property
    def members(self) -> Kept:
        minute = T.StructField("minute", self.schema["created_at"].dataType)
        fields = [self.schema["race_id"], minute, self.schema["created_at"], self.schema["id"]]
        return Kept(f"{self.path}/members", T.StructType(fields), MINUTE, self.parts)

    def create(self, spark: SparkSession) -> Numbers:
        for table in (self.counts, self.members):
            table.create(spark.createDataFrame([], table.schema))
        return self

    def add(self, reports: DataFrame, batch_id: int) -> None:
        """Count a micro-batch of reports; a batch that is repeated counts once, as does a report that is sent again.

        The members come first, and the counts of the batch's minutes follow from them.
        """
        rows = _minute("created_at", reports.select("id", "race_id", "created_at")).distinct()
        self.members.merge(rows, lambda old: old.unionByName(rows.select(*old.columns)).distinct())
        spark, minutes = reports.sparkSession, rows.select(*MINUTE).distinct()
        now = self.members.read(spark, self.members.touched(minutes)).join(minutes, MINUTE, "left_semi").groupBy(*MINUTE)
        now = now.agg(F.count(F.lit(1)).alias("n"))
        self.counts.merge(
            rows, lambda old: now.select(*old.columns), stays=lambda old: old.join(minutes, MINUTE, "left_anti")
        )

    def of(self, asked: DataFrame) -> DataFrame:
        """``asked`` (id, race_id, created_at) with ``rank``, for reports that the index holds."""
        spark = asked.sparkSession
        rows = _minute("created_at", asked)
        races, minutes = rows.select("race_id").distinct(), rows.select(*MINUTE).distinct()
        counts = self.counts.read(spark, self.counts.touched(rows)).join(races, "race_id", "left_semi")
        earlier = Window.partitionBy("race_id").orderBy("minute").rowsBetween(Window.unboundedPreceding, -1)
        before = counts.select(*MINUTE, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_before"))
        members = self.members.read(spark, self.members.touched(rows)).join(minutes, MINUTE, "left_semi")
        own = Window.partitionBy(*MINUTE).orderBy("created_at", "id")
        places = members.select("id", *MINUTE, F.row_number().over(own).alias("_own"))
        number = (F.col("_before") + F.col("_own")).cast("int").alias("rank")
        return rows.join(places, ["id", *MINUTE]).join(before, MINUTE).select(*asked.columns, number)


def keep_numbers(reports: DataFrame, index: Numbers, checkpoint: str) -> StreamingQuery:
    """Keep the index of a stream of reports."""
    return gates.run(reports, index.add, checkpoint)
