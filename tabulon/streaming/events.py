"""Streams of events: counts by window and type, with late data bounded."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str) -> DataFrame:
    """New Parquet files of a folder as a stream."""
    return spark.readStream.schema(spark.read.parquet(path).schema).parquet(path)


def counts(events: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Events and their sum by window and type."""
    by = F.window("ts", window)
    kept = events.withColumn("ts", F.col("ts").cast("timestamp"))
    kept = kept.withWatermark("ts", late) if events.isStreaming else kept
    return kept.groupBy(by.alias("w"), "event_type").agg(F.count("*").alias("n"), F.sum(F.col("value").cast("decimal(18,4)")).alias("total")).select(F.col("w.start").alias("start"), "event_type", "n", F.col("total").cast("double").alias("total"))


def write(df: DataFrame, path: str, checkpoint: str, mode: str = "append"):
    """Everything there is, then stop; goes on from the checkpoint."""
    return df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(path)
