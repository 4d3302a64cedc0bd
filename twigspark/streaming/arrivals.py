"""Structured Streaming over files as they arrive: annotations flow through the batch plan, and counts by event time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def stream_files(spark: SparkSession, path: str, schema: str, files_a_trigger: int = 100) -> DataFrame:
    """New JSON documents in a folder, each once, at most so many files a trigger."""
    return spark.readStream.schema(schema).option("multiLine", True).option("maxFilesPerTrigger", files_a_trigger).json(path).withColumn("path", F.input_file_name())


def run_batches(stream: DataFrame, plan: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs a batch plan on every micro-batch; each batch writes a folder of its own number, so a repeated batch replaces itself."""
    def each(batch: DataFrame, number: int) -> None:
        plan(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    w = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def windowed_counts(events: DataFrame, time: str = "ts", width: str = "1 hour", late: str = "10 minutes", by: str = "event_type") -> DataFrame:
    """Counts and sums by event-time window and key; rows later than the watermark are dropped from a stream. Works on batches alike."""
    e = events.withColumn(time, F.col(time).cast("timestamp"))
    if e.isStreaming:
        e = e.withWatermark(time, late)
    a = e.groupBy(F.window(time, width), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return a.select(F.col("window.start").alias("start"), by, "n", "total")
