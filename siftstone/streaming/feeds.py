"""File streams: the activity log as a feed, and listings that keep the cache up to date."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siftstone.operators import cache
from siftstone.plans.store import Store
from siftstone.sources.logs import SCHEMA as LOG_SCHEMA
from siftstone.sources.logs import ActivitySource


def log_feed(spark: SparkSession, folder: str, since: int = 0, level: str | None = None) -> DataFrame:
    """A stream of log entries from a cursor on.  The query's checkpoint is the cursor that
    survives restarts."""
    rows = spark.readStream.schema(LOG_SCHEMA).json(folder).where(F.col("seq") >= since)
    return rows.where(F.col("level") == level) if level else rows


def activity_feed(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """The activity log's own file as a stream, entry by entry as it grows; see :class:`ActivitySource`."""
    spark.dataSource.register(ActivitySource)
    return spark.readStream.format("activity").option("path", path).options(**options).load()


def level_counts(feed: DataFrame, minutes: int = 5) -> DataFrame:
    """Entries by level in windows of event time; entries an hour late still count."""
    timed = feed.withColumn("at", F.to_timestamp("ts")).withWatermark("at", "1 hour")
    return timed.groupBy(F.window("at", f"{minutes} minutes"), "level").agg(F.count(F.lit(1)).alias("n"))


def ingest(store: Store, listings: DataFrame, checkpoint: str, now: Callable[[], str], scan_id: int = 0):
    """Extension: keep the cache up to date with a stream of hashed listings (the columns
    of the cache's snapshot).  Each batch is one change of the store; a batch that is run
    again after a failure upserts the same rows."""

    def put(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            store.replace({"files": cache.upsert_files(store.read("files"), batch.select(cache.SNAPSHOT), scan_id, now())})

    return listings.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True)


def duplicate_counts(listings: DataFrame) -> DataFrame:
    """Extension: running copies and bytes of each hash, as a stream in update mode."""
    return listings.groupBy("hash").agg(F.count(F.lit(1)).alias("copies"), F.max("size").alias("size"))
