"""Feeds as Structured Streaming: the scan feed kept as a state, the event feed counted by day.

Both read whatever there is and stop (``availableNow``); run again with the same checkpoint they go on from there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marginalia.operators import state
from marginalia.sources import snapshots


def feed(spark: SparkSession, path: str, files_at_once: int = 20) -> DataFrame:
    """A growing parquet table, a folder or a single file, as a stream."""
    schema = spark.read.parquet(path).schema
    pattern = f"{path[:-1]}[{path[-1]}]"  # a stream takes a single file by pattern only
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_at_once).parquet(pattern)


def merge_scans(known: DataFrame | None, batch: DataFrame) -> DataFrame:
    """``state.newest_scan`` of all batches up to this one; the same in whatever order and however often they come."""
    newest = state.newest_scan(batch)
    return newest if known is None else state.newest_scan(known.unionByName(newest))


def follow_scans(scans: DataFrame, root: str, checkpoint: str) -> None:
    """Publishes, for each micro-batch of ``scans``, the newest version of every path under ``root``."""

    def step(batch: DataFrame, _: int) -> None:
        snapshots.publish(merge_scans(snapshots.current(batch.sparkSession, root), batch), root)

    scans.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def daily_events(events: DataFrame, lateness: str = "2 days") -> DataFrame:
    """Events of each kind and day they were sent on, exact duplicates once; events later than ``lateness`` are left out."""
    timed = events.withColumn("sent_at", F.col("sent_at").cast("timestamp")).filter("sent_at is not null")
    marked = timed.withColumn("mark", F.xxhash64("ask_id", "seq", "event", "data", "received_at"))  # the state keeps no data
    once = marked.withWatermark("sent_at", lateness).dropDuplicates(["mark", "sent_at", "event"])
    return once.groupBy(F.window("sent_at", "1 day").alias("day"), "event").agg(F.count("*").alias("events")).select(F.col("day.start").cast("timestamp_ntz").alias("day"), "event", "events")


def follow_events(events: DataFrame, out: str, checkpoint: str, lateness: str = "2 days") -> None:
    """Keeps the daily counts of ``events`` as versions under ``out``."""

    def step(batch: DataFrame, _: int) -> None:
        snapshots.publish(batch, out)

    stream = daily_events(events, lateness).writeStream.outputMode("complete").foreachBatch(step)
    stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
