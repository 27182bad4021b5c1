"""Tables kept in parts, of which a change reads and replaces only those that it touches.

A row's part is a hash of its key, so the keys that a feed names say which parts to read. The changed parts are put in place of
the old ones by dynamic partition overwrite, which writes them aside until all of them are there: until then the old
parts stand, and parts that the feed doesn't name keep their files. Rows that stay are written from the tasks that read them. A journal of applied postings makes a replay do nothing; a
posting that broke off is applied again, so a merge must give the same rows if some parts already have them.

Each part holds one row that isn't live besides its own, so that a part which loses its last row is replaced too.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paddock.sources.tables import replace_partitions

PARTS = 64
Merge = Callable[[DataFrame], DataFrame]


@dataclass(frozen=True)
class Kept:
    """A table under ``path`` in ``parts`` by hash of ``keys``, as ``schema`` says."""

    path: str
    schema: T.StructType
    keys: Sequence[str]
    parts: int = PARTS

    def part(self) -> Column:
        """A key's part. Keys count by their text, so a feed's may be of another type."""
        return F.pmod(F.xxhash64(*(F.col(k).cast("string") for k in self.keys)), F.lit(self.parts)).cast("int")

    def create(self, rows: DataFrame) -> Kept:
        """Write the whole table."""
        new = self._placed(rows.select(*self.schema.names), range(self.parts))
        new.write.option("compression", "zstd").partitionBy("part").parquet(f"{self.path}/rows")
        return self

    def read(self, spark: SparkSession, parts: Sequence[int] | None = None) -> DataFrame:
        """The rows of some parts, or of all; which parts is known before a file is opened."""
        schema = T.StructType([*self.schema.fields, T.StructField("live", T.BooleanType()), T.StructField("part", T.IntegerType())])
        rows = spark.read.schema(schema).parquet(f"{self.path}/rows")
        if parts is not None:
            rows = rows.filter(F.col("part").isin([*parts]))
        return rows.filter("live").select(*self.schema.names)

    def touched(self, keys: DataFrame) -> list[int]:
        """Parts of the given keys: ``parts`` numbers at most."""
        return sorted(r.part for r in keys.select(self.part().alias("part")).distinct().collect())

    def merge(self, keys: DataFrame, change: Merge, posting: str | None = None, stays: Merge | None = None) -> bool:
        """Replace the parts of ``keys`` by what ``change`` makes of their rows; whether it was done.

        Where ``stays`` is given, ``change`` gives the new rows only, and ``stays`` the old ones that stay as they are: those
        are in their parts already and aren't dealt anew. ``posting`` names the change in the journal; one that is there already
        changes nothing.
        """
        spark = keys.sparkSession
        if posting is not None and posting in self.applied(spark):
            return False
        parts = self.touched(keys)
        if parts:
            old = self.read(spark, parts)
            new = self._placed(change(old).select(*self.schema.names), parts)
            if stays is not None:
                new = new.unionByName(self._live(stays(old).select(*self.schema.names)))
            replace_partitions(new, f"{self.path}/rows", "part")
        if posting is not None:
            entry = spark.range(1).select(F.lit(posting).alias("posting"), F.lit(len(parts)).alias("parts"))
            entry.coalesce(1).write.mode("append").parquet(f"{self.path}/journal")
        return True

    def applied(self, spark: SparkSession) -> set[str]:
        """Postings in the journal."""
        try:
            rows = spark.read.schema("posting string, parts int").parquet(f"{self.path}/journal").collect()
        except AnalysisException:  # nothing was posted yet
            return set()
        return {r.posting for r in rows}

    def _placed(self, rows: DataFrame, parts: Sequence[int]) -> DataFrame:
        """Rows with their part, large parts dealt over several tasks, and one row that isn't live for each part."""
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        marks = rows.sparkSession.range(0, self.parts, 1, 1).filter(F.col("id").isin([*parts]))
        marks = marks.select(*none, F.lit(False).alias("live"), F.col("id").cast("int").alias("part"))
        return self._live(rows).unionByName(marks).hint("rebalance", "part")

    def _live(self, rows: DataFrame) -> DataFrame:
        return rows.select("*", F.lit(True).alias("live"), self.part().alias("part"))
