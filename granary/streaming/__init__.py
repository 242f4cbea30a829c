"""Structured Streaming: the store fed by a stream, and event-time windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from granary.operators.store import Store
from granary.schema import TRANSACTION


def landed(spark: SparkSession, path: str) -> DataFrame:
    """A stream of transactions from a folder of Parquet files."""
    return spark.readStream.schema(TRANSACTION).parquet(path)


def into_store(stream: DataFrame, store: Store, name: str, checkpoint: str, run_date: str, available_now: bool = True) -> StreamingQuery:
    """Each micro-batch becomes a batch of the store under <name>-<number>; a batch that is sent again publishes nothing new."""

    def take(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            store.ingest(batch, f"{name}-{number}", run_date, initialize=not store.versions())

    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(take)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")).start()


def windowed(events: DataFrame, time: str, size: str, *keys: str, slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts and values of event-time windows; on a stream, rows later than `late` are left out."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    window = F.window(time, size, slide) if slide else F.window(time, size)
    return marked.groupBy(window.alias("w"), *keys).agg(F.count("*").alias("events"), F.sum(F.col("value").cast("decimal(18,6)")).alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *keys, "events", "value")


def sessions(events: DataFrame, time: str, gap: str, *keys: str, late: str = "1 hour") -> DataFrame:
    """Sessions of events no further apart than a gap."""
    marked = events.withWatermark(time, late) if events.isStreaming else events
    return marked.groupBy(F.session_window(time, gap).alias("w"), *keys).agg(F.count("*").alias("events")).select(F.col("w.start").alias("start"), *keys, "events")


def first_seen(events: DataFrame, keys: list[str], time: str, late: str = "1 hour") -> DataFrame:
    """The first event of each key; a stream forgets keys after `late`."""
    return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys) if events.isStreaming else events.dropDuplicates(keys)
