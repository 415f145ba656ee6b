"""Trending objects over an event stream.

Events are counted once, in panes as long as a window's slide; windows are sums of panes. So an event is one update of one
state row however many windows it belongs to, and an object seen rarely has one row per event in state, not one per window.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rostrum.sources.schemas import EVENTS
from rostrum.sources.snapshots import latest, read_snapshot, upsert_snapshot, vacuum, write_snapshot

DAY = 86_400
PANES = "pane STRING, pane_start TIMESTAMP, object_id STRING, events BIGINT, conversions BIGINT"


def event_stream(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """Event files of a folder as a stream."""
    reader = spark.readStream.schema(EVENTS)
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(path)


def event_panes(events: DataFrame, slide: int = DAY, late: str = "1 hour") -> DataFrame:
    """Events and conversions per object and pane of ``slide`` seconds; works on a stream and on a table alike.

    On a stream, a pane is kept until the watermark passes it, and events more than ``late`` behind that belong to a
    closed pane are dropped; ``dropped_late`` counts them.
    """
    if events.isStreaming:
        events = events.withWatermark("ts", late)
    counted = events.groupBy(F.window("ts", f"{slide} seconds"), "object_id").agg(
        F.count("*").alias("events"), F.count_if(F.col("event_type") == "conversion").alias("conversions"))
    # panes of one time lie together in the stored table, so a batch rewrites its newest files only
    name = F.concat_ws("/", F.date_format("window.start", "yyyy-MM-dd HH:mm:ss"), F.coalesce("object_id", F.lit("")))
    return counted.select(name.alias("pane"), F.col("window.start").alias("pane_start"), "object_id", "events", "conversions")


def windows_of(panes: DataFrame, window: int = 7 * DAY, slide: int = DAY) -> DataFrame:
    """Events per object and sliding window of ``window`` seconds, from panes of ``slide`` seconds, which must divide it."""
    if window % slide:
        raise ValueError("a window must be a whole number of slides")
    back = F.explode(F.sequence(F.lit(0), F.lit(window // slide - 1)))
    spread = panes.withColumn("back", back).withColumn("window_start", F.timestamp_seconds(F.unix_timestamp("pane_start") - F.col("back") * slide))
    counted = spread.groupBy("window_start", "object_id").agg(F.sum("events").alias("events"), F.sum("conversions").alias("conversions"))
    end = F.timestamp_seconds(F.unix_timestamp("window_start") + window)
    return counted.select("window_start", end.alias("window_end"), "object_id", "events", "conversions")


def trending_windows(events: DataFrame, window: int = 7 * DAY, slide: int = DAY) -> DataFrame:
    """Events per object and sliding window of a table of events."""
    return windows_of(event_panes(events, slide), window, slide)


def write_trending(events: DataFrame, path: str, checkpoint: str, slide: int = DAY, late: str = "1 hour"):
    """Stream panes into a snapshot table: what a batch changed replaces the panes' former counts, in one commit.

    A replayed batch gives the same table. All panes are there after every run, open ones with their counts so far;
    files of former versions are removed after a day. Processes what is there and stops.
    """
    spark = events.sparkSession
    if latest(spark, path) is None:
        write_snapshot(spark.createDataFrame([], PANES), path, "pane")

    def put(batch: DataFrame, number: int) -> None:
        upsert_snapshot(batch.sparkSession, path, batch, "pane")
        vacuum(batch.sparkSession, path, keep=2)

    return (
        event_panes(events, slide, late)
        .writeStream.outputMode("update")
        .foreachBatch(put)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def dropped_late(query) -> int:
    """Events of a run that came too late for their pane."""
    return sum(int(o["numRowsDroppedByWatermark"]) for p in query.recentProgress for o in p["stateOperators"])


def read_trending(spark: SparkSession, path: str, window: int = 7 * DAY, slide: int = DAY) -> DataFrame:
    """The present counts per window and object."""
    return windows_of(read_snapshot(spark, path), window, slide)
