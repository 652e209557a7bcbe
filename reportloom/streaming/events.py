"""Structured Streaming over events: deduplication and windowed counts with a watermark."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reportloom.session import hand_over, shared_dir

SCHEMA = "event_id bigint, ts timestamp, user_id bigint, event_type string, value double, props string"


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(SCHEMA).parquet(path)


def windowed_counts(events: DataFrame, width: str = "1 hour", lateness: str = "2 hours") -> DataFrame:
    """(start, event_type, events, total) per tumbling window; an event_id counts once within the watermark. Works on batches too."""
    e = events.withWatermark("ts", lateness).dropDuplicatesWithinWatermark(["event_id"]) if events.isStreaming else events.dropDuplicates(["event_id"])
    g = e.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"), F.round(F.sum("value"), 4).alias("total"))
    return g.select(F.col("w.start").alias("start"), "event_type", "events", "total")


def run_available(spark: SparkSession, stream: DataFrame, name: str) -> DataFrame:
    """Process what is there and return the table written; windows that the watermark hasn't closed are still open and left out.

    Checkpoint and output are in the shared folder, so the query can be started again where it ended.
    """
    base = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    q = stream.writeStream.format("parquet").outputMode("append").option("path", f"{base}/out").option("checkpointLocation", f"{base}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    hand_over(spark, base)
    return spark.read.schema(stream.schema).parquet(f"{base}/out")
