"""The report and response gates as streams, with keyed state that a watermark bounds.

A stream is first cut by its own clock (``split_late``): the greatest time of all earlier micro-batches. Rows more than ``delay``
behind it, and rows without a time, go to a side table; the rest to a folder that the stateful job reads. So the stateful job
loses no row to its watermark, which never is ahead of that clock, and its state holds what the delay spans. ``late_reports`` and
``late_responses`` label the side table with the batch gates, once, whenever it is due.

What a run reads is its own new rows, the league's tables and, for responses without a report in time, the reports that these name.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from paddock.operators.stewarding import ACCEPTED, report_gate, response_gate, response_label, with_reports
from paddock.session import TIDY, settings
from paddock.sources.tables import League

#: How far rows may come behind the newest one before they are set aside.
DELAY = "7 days"
#: No accepted report and response lie farther apart: a report and a response on time both come from a race's start to the end of
#: the next day, or the response within a day of the report.
APART = "2 days"
#: What the join of responses and reports holds lies on disk, one store a task, not on the executors' heap.
STATE = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.join.stateFormatVersion": "3",
    "spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage": "true",
    "spark.sql.streaming.stateStore.rocksdb.compression": "zstd",
    # a run goes on from its last batch; files that only older ones need may go
    "spark.sql.streaming.minBatchesToRetain": "2",
}
#: Responses of a micro-batch that are sent to the tables; more are dealt together with them.
FEW = 10_000


def read_files(spark: SparkSession, path: str, schema: T.StructType, max_files: int | None = None) -> DataFrame:
    """A stream of Parquet files, in folders of any depth."""
    reader = spark.readStream.schema(schema).option("recursiveFileLookup", "true")
    if max_files:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def stored(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The rows of all Parquet files under ``path``; none where nothing was written yet."""
    try:
        return spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(path)
    except AnalysisException:  # the folder isn't there before the first batch
        return spark.createDataFrame([], schema)


def run(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Process everything available now, batch by batch."""
    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()


def once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row per key, the least of those that differ."""
    others = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.min(F.struct(*others)).alias("_first")).select(*keys, "_first.*")


def split_late(stream: DataFrame, path: str, checkpoint: str, delay: str = DELAY) -> StreamingQuery:
    """Cut a stream into ``path/on_time`` and ``path/late`` by ``created_at``, one folder per micro-batch.

    A row is late if its time isn't within ``delay`` of the greatest time before its batch, or missing. Each batch hands the
    next one the greatest time so far, so one row is read of what came before. A batch that is repeated replaces itself.
    """

    clock = T.StructType([T.StructField("greatest", stream.schema["created_at"].dataType)])

    def write(batch: DataFrame, batch_id: int) -> None:
        before = stored(batch.sparkSession, f"{path}/clock/batch={batch_id - 1}", clock) if batch_id else None
        greatest = batch.agg(F.max("created_at").alias("greatest"))
        if before is None:
            late = F.col("created_at").isNull()
        else:
            greatest = greatest.unionByName(before).agg(F.max("greatest").alias("greatest"))
            past = before.agg(F.max("greatest")).scalar() - F.expr(f"INTERVAL {delay}")
            late = F.col("created_at").isNull() | F.coalesce(F.col("created_at") <= past, F.lit(False))
        for folder, rows in (("on_time", batch.filter(~late)), ("late", batch.filter(late)), ("clock", greatest)):
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/{folder}/batch={batch_id}")

    return run(stream, write, checkpoint)


def _on_time(stream: DataFrame, path: str, checkpoint: str, delay: str) -> DataFrame:
    """The rows on time of everything available now, as a stream of whole batches with a watermark on ``_time``."""
    split_late(stream, path, f"{checkpoint}/split", delay).awaitTermination()
    return _timed(read_files(stream.sparkSession, f"{path}/on_time", stream.schema), "_time", delay)


def _timed(stream: DataFrame, out: str, delay: str) -> DataFrame:
    return stream.withColumn(out, F.col("created_at").cast("timestamp")).withWatermark(out, delay)


def _labelled(schema: T.StructType) -> T.StructType:
    return T.StructType([*schema.fields, T.StructField("gate", T.StringType())])


def stream_report_gate(
    reports: DataFrame, league: League, path: str, checkpoint: str, zone: str = "UTC", delay: str = DELAY
) -> StreamingQuery:
    """Label a stream of reports into ``path/labelled``; a report sent again is labelled once.

    Ids are remembered for twice the delay, in keyed state. What comes later than that is in ``path/late``, where
    ``late_reports`` tells new reports from old ones.
    """
    rows = _on_time(reports, path, checkpoint, delay).dropDuplicatesWithinWatermark(["id"])
    labelled = report_gate(rows, league.races, league.races_drivers, zone).select(*_labelled(reports.schema).names)
    writer = labelled.writeStream.format("parquet").option("path", f"{path}/labelled").outputMode("append")
    return writer.option("checkpointLocation", f"{checkpoint}/gate").trigger(availableNow=True).start()


def labelled_reports(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``stream_report_gate`` has labelled so far, by the sink's own log."""
    try:
        return spark.read.schema(_labelled(schema)).parquet(f"{path}/labelled")
    except AnalysisException:
        return spark.createDataFrame([], _labelled(schema))


def late_reports(spark: SparkSession, league: League, path: str, schema: T.StructType, zone: str = "UTC") -> DataFrame:
    """Labels of the reports set aside, but for those that were labelled on time; of several with one id the least."""
    late = once(stored(spark, f"{path}/late", schema), ["id"])
    new = late.join(labelled_reports(spark, path, schema).select("id"), "id", "left_anti")
    return report_gate(new.select(*schema.names), league.races, league.races_drivers, zone).select(*_labelled(schema).names)


def stream_response_gate(
    responses: DataFrame,
    reports: DataFrame,
    accepted_reports: Callable[[], DataFrame],
    league: League,
    path: str,
    checkpoint: str,
    zone: str = "UTC",
    delay: str = DELAY,
) -> StreamingQuery:
    """Label a stream of responses into ``path/labelled`` against a stream of accepted ``reports``.

    A left join of two streams: a response meets its report if both lie within ``APART``, in whatever order they come. A
    response without one is held until the watermark has passed that span. Then it is no accepted one, and ``accepted_reports``,
    of which only the reports it names are wanted, tells whether it was too late or has no report. Responses that
    come behind the delay are in ``path/late``; ``late_responses`` labels them.
    """
    sent = _on_time(responses, path, checkpoint, delay)
    known = _timed(reports, "_reported", delay)
    known = known.select(F.col("id").alias("_report"), "race_id", F.col("created_at").alias("reported_at"), "_reported")
    span = F.expr(f"INTERVAL {APART}")
    near = F.col("_reported").between(F.col("_time") - span, F.col("_time") + span)
    joined = sent.join(known, (F.col("report_id") == F.col("_report")) & near, "left")
    joined = joined.select(*responses.columns, "race_id", "reported_at")

    def write(batch: DataFrame, batch_id: int) -> None:
        # the batch is joined once, and what came of it is read several times
        met = f"{path}/met/batch={batch_id}"
        batch.write.mode("overwrite").option("compression", "zstd").parquet(met)
        batch = batch.sparkSession.read.schema(batch.schema).parquet(met)
        found = batch.count()
        if not found:
            return
        known, entries, targets = accepted_reports(), league.races_drivers, league.report_targets
        if found <= FEW:  # the tables aren't dealt for them
            known = known.join(F.broadcast(batch.select(F.col("report_id").alias("id"))), "id", "left_semi")
            entries = entries.join(F.broadcast(batch.select(F.col("from_driver").alias("driver_id"))), "driver_id", "left_semi")
            targets = targets.join(F.broadcast(batch.select("report_id")), "report_id", "left_semi")
        matched = F.col("race_id").isNotNull()
        alone = batch.filter(~matched).select(*responses.columns)
        asked = alone.select(F.col("report_id").alias("id")).distinct()
        rows = batch.filter(matched).unionByName(with_reports(alone, known.join(asked, "id", "left_semi")))
        labelled = response_label(rows, league.races, entries, targets, zone)
        labelled = labelled.select(*responses.columns, "gate")
        labelled.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/labelled/batch={batch_id}")

    with settings(sent.sparkSession, {**TIDY, **STATE}):
        return run(joined, write, f"{checkpoint}/gate")


def labelled_responses(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """What ``stream_response_gate`` has labelled so far."""
    return stored(spark, f"{path}/labelled", _labelled(schema))


def late_responses(
    spark: SparkSession, accepted_reports: DataFrame, league: League, path: str, schema: T.StructType, zone: str = "UTC"
) -> DataFrame:
    """Labels of the responses set aside."""
    late = stored(spark, f"{path}/late", schema)
    tables = league.races, league.races_drivers, league.report_targets
    return response_gate(late, accepted_reports, *tables, zone).select(*_labelled(schema).names)


def heartbeat(spark: SparkSession, schema: T.StructType, moment: object) -> DataFrame:
    """A row that moves a stream's clock on where no rows come: a time, an id of no report and nothing else, so no gate accepts it.

    The id is there because the planner drops rows that can't join before it takes their time.
    """
    ids = "heartbeat" if isinstance(schema["id"].dataType, T.StringType) else -1
    nullable = T.StructType([T.StructField(f.name, f.dataType) for f in schema])
    return spark.createDataFrame([tuple({"created_at": moment, "id": ids}.get(f.name) for f in schema)], nullable)


def accepted(labelled: DataFrame) -> DataFrame:
    return labelled.filter(F.col("gate") == ACCEPTED).drop("gate")
