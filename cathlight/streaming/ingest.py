"""Incremental work as Structured Streaming: resumable ingestion by key and windowed counts with late data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.sinks import insert_ignore


def ingest_available(spark: SparkSession, source: str, schema, target: str, checkpoint: str, keys: list[str], order: str, pattern: str = "*") -> None:
    """Read the files not seen before and append rows of new keys; safe to run again after a failure."""
    stream = spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(source)

    def put(batch: DataFrame, _: int) -> None:
        insert_ignore(batch.sparkSession, target, batch, keys, order)

    stream.writeStream.foreachBatch(put).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def windowed(events: DataFrame, time: str, key: str, value: str, late: str = "10 minutes", width: str = "5 minutes") -> DataFrame:
    """Counts and sums of each key in event-time windows; works on a stream and on a table."""
    seen = events.withWatermark(time, late) if events.isStreaming else events
    return seen.groupBy(F.window(time, width).alias("w"), key).agg(F.count("*").alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), key, "n", "total")
