"""Queries of the streaming operators, over the tables as feeds."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from marginalia.plans.states import LATEST
from marginalia.sources import snapshots
from marginalia.streaming import feeds
from marginalia.tables import scratch


#: How late an event may be when all of history is read again, in whatever order its files come.
HISTORY = "3650 days"


def stream_scans(spark: SparkSession, folder: str) -> DataFrame:
    """Newest version of every path, kept up by a stream."""
    root = scratch(spark, "scans")
    feeds.follow_scans(feeds.feed(spark, f"{folder}/raw_notes.parquet"), root, f"{root}-checkpoint")
    return snapshots.current(spark, root).drop("scanned_at")


def stream_daily_events(spark: SparkSession, folder: str) -> DataFrame:
    """Events by kind and day, counted by a stream."""
    root = scratch(spark, "events")
    feeds.follow_events(feeds.feed(spark, f"{folder}/ask_events.parquet"), root, f"{root}-checkpoint", HISTORY)
    return snapshots.current(spark, root)


QUERIES = {"stream_scans": stream_scans, "stream_daily_events": stream_daily_events}
SQL = {
    "stream_scans": LATEST,
    "stream_daily_events": "SELECT date_trunc('day', sent_at) AS day, event, count(*) AS events FROM (SELECT DISTINCT * FROM ask_events) WHERE sent_at IS NOT NULL GROUP BY ALL",
}
