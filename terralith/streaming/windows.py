"""Structured Streaming over append-only event logs; our own addition, counted the same in batch and in streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def counts(events: DataFrame, width: str, kind: str = "event_type", late: str | None = None) -> DataFrame:
    """Events by window and kind; late sets the watermark of a stream."""
    rows = events.withWatermark("ts", late) if late else events
    return rows.groupBy(F.window("ts", width), kind).agg(F.count("*").alias("n"))


def read_events(spark: SparkSession, folder: str, schema: str, files_a_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def write_counts(df: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Runs until what is there is read; finished windows are appended."""
    flat = df.select(F.col("window.start").alias("start"), *[c for c in df.columns if c != "window"])
    return flat.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).format("parquet").start(folder)
