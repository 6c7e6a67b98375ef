"""Extensions with Structured Streaming: incremental ingest, deduplication and windows over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def stream(spark: SparkSession, path: str, schema, files_per_batch: int | None = None) -> DataFrame:
    """Parquet files of a folder as a stream."""
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(path)


def event_time(df: DataFrame, ts: str = "ts") -> DataFrame:
    """Watermarks need a timestamp with a zone."""
    return df.withColumn(ts, F.col(ts).cast("timestamp"))


def windowed_counts(events: DataFrame, window: str = "1 day", slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and sums by event type and window; rows later than the delay are left out."""
    w = F.window("ts", window, slide) if slide else F.window("ts", window)
    agg = event_time(events).withWatermark("ts", delay).groupBy(w, "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return agg.select(F.col("window.start").alias("window_start"), "event_type", "n", "total")


def sessions(events: DataFrame, gap: str = "30 minutes", delay: str = "1 hour") -> DataFrame:
    agg = event_time(events).withWatermark("ts", delay).groupBy(F.session_window("ts", gap), "user_id").agg(F.count(F.lit(1)).alias("n"))
    return agg.select(F.col("session_window.start").alias("session_start"), "user_id", "n")


def first_of_each(rows: DataFrame, keys: list[str], ts: str = "ts", delay: str = "1 day") -> DataFrame:
    return event_time(rows, ts).withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)


def run_available(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, written as Parquet; a later call goes on where this one ended."""
    q = df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).start(path, format="parquet")
    q.awaitTermination()
