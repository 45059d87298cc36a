"""Live counts over event logs. File streams see new files, so logs must be rotated."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tableprep.operators.runlog import EVENT_SCHEMA, instant, normalise


def read_event_stream(spark: SparkSession, path: str, *, files_per_trigger: int = 1000) -> DataFrame:
    """Rotated JSON-lines logs as a stream."""
    return (
        spark.readStream.schema(EVENT_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
        .option("recursiveFileLookup", "true").json(path)
    )


def live_counts(events: DataFrame, *, window: str = "1 hour", lateness: str = "10 minutes") -> DataFrame:
    """(window_start, window_end, level, event, events); rows later than `lateness` are dropped."""
    timed = normalise(events).withColumn("at", instant())
    counted = timed.withWatermark("at", lateness).groupBy(F.window("at", window), "level", "event").agg(
        F.count(F.lit(1)).alias("events")
    )
    return counted.select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "level", "event", "events"
    )


def write_counts(counts: DataFrame, path: str, checkpoint: str, *, available_now: bool = False) -> StreamingQuery:
    """Closed windows to parquet, exactly once. With available_now the query ends when caught up."""
    writer = counts.writeStream.outputMode("append").format("parquet").option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="1 minute")
    return writer.start(path)
