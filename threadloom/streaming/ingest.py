"""Structured Streaming forms of ingest: counted windows, reply joins and session state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener
from pyspark.sql.streaming.query import StreamingQuery


def read_stream(spark: SparkSession, path: str, like: DataFrame, files_per_trigger: int = 1) -> DataFrame:
    """A folder of parquet files as a stream with the schema of a table."""
    return spark.readStream.schema(like.schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def window_counts(events: DataFrame, ts: str, key: str, value: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Counts and sums per tumbling window and key; rows later than the watermark are dropped."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, size).alias("w"), key).agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(value), 4).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")


def session_counts(events: DataFrame, ts: str, key: str, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """Sessions per key, closed by a time without events."""
    return events.withWatermark(ts, late).groupBy(F.session_window(ts, gap).alias("w"), key).agg(F.count(F.lit(1)).alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def reply_stream(customers: DataFrame, replies: DataFrame, late: str = "1 day", within: str = "12 hours") -> DataFrame:
    """Stream-stream join of messages ``(id, at, ...)`` with replies ``(answers, replied_at, ...)``.

    Both sides carry watermarks and the reply must come within a time, so the state stays bounded.
    """
    a, b = customers.withWatermark("at", late), replies.withWatermark("replied_at", late)
    return a.join(b, F.expr(f"id = answers and replied_at >= at and replied_at <= at + interval {within}"))


def each_batch(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Run a batch function on all available data, micro-batch by micro-batch."""
    return stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def write_jsonl_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """All available data appended to a folder as JSON lines, each micro-batch once."""
    return stream.writeStream.format("json").option("ignoreNullFields", False).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class Progress(StreamingQueryListener):
    """Counts the rows and micro-batches of the session's streams while it is registered."""

    def __init__(self) -> None:
        self.rows = self.batches = self.ended = 0

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        self.batches += 1
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended += 1
