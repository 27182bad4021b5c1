"""Messages for new reports and verdicts, written per micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from paddock.operators.stewarding import report_notification_feed
from paddock.sources.tables import League
from paddock.streaming import gates
from paddock.streaming.numbers import Numbers


def stream_notifications(
    news: DataFrame, tables: Callable[[], League], base_url: str, path: str, checkpoint: str, index: Numbers | None = None
) -> StreamingQuery:
    """Write the message of each (report_id, is_decision) that arrives to ``path/sent``.

    The report's number depends on the race's other reports. An ``index`` of counts, which a stream of reports keeps, gives it
    without reading them; without one each micro-batch numbers the reports of its races anew. News of a report, or of a
    verdict, that the ``tables`` (read anew for each batch) or the index don't hold yet waits under ``path/waiting`` and is tried
    again with every later batch.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        league, columns = tables(), ["report_id", "is_decision"]
        left = waiting(batch.sparkSession, path, batch.select(*columns).schema, batch_id)
        asked = batch.select(*columns).unionByName(left).distinct()
        reports = league.reports
        if index is not None:
            wanted = reports.join(asked.select(F.col("report_id").alias("id")).distinct(), "id", "left_semi")
            reports = wanted.join(index.of(wanted.select("id", "race_id", "created_at")).select("id"), "id", "left_semi")
        known = reports.select(F.col("id").alias("report_id"), F.col("verdict").isNotNull().alias("decided"))
        found = asked.join(known, "report_id", "left").withColumn(
            "is_ready", F.coalesce(F.when(F.col("is_decision"), F.col("decided")).otherwise(F.col("decided").isNotNull()), F.lit(False))
        )
        found = found.select(*columns, "is_ready").persist()  # who is ready is found once, and read by three writes
        try:
            left = found.filter(~F.col("is_ready")).select(*columns)
            left.write.mode("overwrite").parquet(f"{path}/waiting/batch={batch_id}")
            for is_decision in (False, True):
                wanted = found.filter(F.col("is_ready") & (F.col("is_decision") == is_decision)).select("report_id")
                feed = report_notification_feed(league, base_url, is_decision, wanted, index.of if index else None)
                feed.withColumn("is_decision", F.lit(is_decision)).write.mode("overwrite").parquet(
                    f"{path}/sent/batch={batch_id}/kind={int(is_decision)}"
                )
        finally:
            found.unpersist()

    return gates.run(news, write, checkpoint)


def waiting(spark: SparkSession, path: str, schema: T.StructType, batch_id: int) -> DataFrame:
    """What the batch before left waiting; every batch takes all of it over."""
    if not batch_id:
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(f"{path}/waiting/batch={batch_id - 1}")


def last_batch(query: StreamingQuery) -> int:
    """Number of the last micro-batch that a finished query wrote, -1 if it found nothing."""
    done = [p["batchId"] for p in query.recentProgress if p["numInputRows"]]
    return max(done, default=-1)
