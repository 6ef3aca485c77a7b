"""Incremental runs: each takes what has come since the last one, with a checkpoint, and stops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def run_once(spark: SparkSession, source: str, schema, step: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, mode: str = "append") -> None:
    """Puts the Parquet files that are new in `source` through `step` into `sink`. After a failure it goes on where
    it was: the checkpoint holds what is done, and files count once."""
    rows = spark.readStream.schema(schema).parquet(source)
    step(rows).writeStream.format("parquet").outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(sink).awaitTermination()


def timed(events: DataFrame) -> DataFrame:
    """events with ts as a timestamp with a zone, which a watermark needs."""
    return events.withColumn("ts", F.col("ts").cast("timestamp"))


def tumbling(events: DataFrame, length: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Count and sum of value by window and event type; rows later than `late` are out."""
    rows = timed(events).withWatermark("ts", late).groupBy(F.window("ts", length), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("value"))
    return rows.select(F.col("window.start").alias("start"), "event_type", "n", "value")


def sessions(events: DataFrame, gap: str = "30 minutes", late: str = "2 hours") -> DataFrame:
    """One row per user and session: a pause of `gap` ends one."""
    rows = timed(events).withWatermark("ts", late).groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    return rows.select("user_id", F.col("session_window.start").alias("start"), "n")


def first_seen(events: DataFrame, key: list[str], late: str = "2 hours") -> DataFrame:
    """The first row of each key within the watermark."""
    return timed(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(key)
