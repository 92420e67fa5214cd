"""Streaming over the event log."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, path: str, schema) -> DataFrame:
    return spark.readStream.schema(schema).parquet(path)


def counts_by_window(events: DataFrame, *, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """(start, event_type, n) by tumbling windows of event time; rows later than the watermark are not counted."""
    timed = events.withColumn("created_at", F.col("created_at").cast("timestamp"))
    timed = timed.withWatermark("created_at", late) if events.isStreaming else timed
    return timed.groupBy(F.window("created_at", width), "event_type").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "event_type", "n")


def run_once(stream: DataFrame, checkpoint: str, name: str) -> DataFrame:
    """Drain the stream into a memory table."""
    query = stream.writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return stream.sparkSession.table(name)
