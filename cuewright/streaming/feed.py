"""Structured Streaming over a folder of task rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def task_stream(spark: SparkSession, path: str, schema: str, files_a_batch: int = 1) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def changes(tasks: DataFrame, late: str | None = None) -> DataFrame:
    """Each (id, status) that isn't pending once. With ``late`` (an interval over column ts) its state is bounded."""
    seen = tasks.where("status <> 'pending'")
    if late:
        return seen.withWatermark("ts", late).dropDuplicatesWithinWatermark(["id", "status"])
    return seen.dropDuplicates(["id", "status"])


def consume(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Every batch that is there through ``handle``, then the end."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run(rows: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """What ``rows`` gives of all that is there, appended to files of ``path``; the query once it has ended."""
    query = rows.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def settled(edits: DataFrame, pause: str = "2 seconds", late: str = "10 seconds") -> DataFrame:
    """Debounced edits: a row for each burst of an episode's edits once a pause after it is over by the watermark.
    An edit that is later than ``late`` is dropped; one that comes out of order within it counts."""
    w = F.session_window("ts", pause)
    return edits.withWatermark("ts", late).groupBy("episode_id", w).agg(F.count(F.lit(1)).alias("n_edits"), F.max("ts").alias("last_edit"))
