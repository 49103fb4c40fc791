"""Encounter counts over a stream; an extension, the operators of the engine are batch ones."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def daily_counts(events: DataFrame, above: float = 100.0) -> DataFrame:
    """c, t (day of month), num_nonzero, num_total; the same plan for a table and a stream."""
    return events.groupBy(F.col("event_type").alias("c"), F.dayofmonth("ts").alias("t")).agg(F.count_if(F.col("value") > above).alias("num_nonzero"), F.count("*").alias("num_total"))


def windowed_counts(events: DataFrame, late: str = "1 hour", width: str = "1 day", above: float = 100.0) -> DataFrame:
    """Counts by event time; rows later than the watermark are dropped and finished windows leave the state."""
    stream = events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", late)
    return stream.groupBy(F.window("ts", width), F.col("event_type").alias("c")).agg(F.count_if(F.col("value") > above).alias("num_nonzero"), F.count("*").alias("num_total"))


def start(stream: DataFrame, path: str, checkpoint: str):
    """Append finished windows to Parquet, exactly once for a checkpoint."""
    return stream.writeStream.outputMode("append").format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
