"""Sliding windows over an event stream.  An addition: the batch operators' windows, for unbounded input."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def sliding(events: DataFrame, time: str = "ts", delay: str = "10 minutes", width: str = "2 hours", step: str = "1 hour") -> DataFrame:
    """Counts and means by window and type; rows later than the watermark are dropped."""
    events = events.withColumn(time, F.col(time).cast("timestamp"))
    w = F.window(time, width, step)
    g = events.withWatermark(time, delay) if events.isStreaming else events
    return g.groupBy(w.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "event_type", "n", "total")


def distinct_events(events: DataFrame, time: str = "ts", delay: str = "10 minutes") -> DataFrame:
    return events.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, delay).dropDuplicatesWithinWatermark(["event_id"])


def run_available(spark: SparkSession, source: DataFrame, path: str, checkpoint: str) -> DataFrame:
    """Process all that is there, append to Parquet, stop, and read the result."""
    q = source.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.schema(source.schema).parquet(path)
