"""Streaming forms of the batch parts: new files, stateful dedupe, sliding counts, micro-batches through the same functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arriving(spark: SparkSession, path: str, schema, fmt: str = "parquet", files_each: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    return (reader.option("maxFilesPerTrigger", files_each) if files_each else reader).load(path)


def first_seen(stream: DataFrame, key: str = "job_id", ts: str | None = None, late: str | None = None) -> DataFrame:
    """Each key once. Without a watermark memory is unbounded, as nothing unseen may be refused; with ts and late it is bounded."""
    return stream.withWatermark(ts, late).dropDuplicatesWithinWatermark([key]) if ts and late else stream.dropDuplicates([key])


def sliding_counts(rows: DataFrame, ts: str = "ts", size: str = "12 hours", step: str = "1 hour") -> DataFrame:
    """(window_start, n) of every window that has rows; batch or stream."""
    return rows.groupBy(F.window(ts, size, step)).agg(F.count("*").alias("n")).select(F.col("window.start").alias("window_start"), "n")


def in_batches(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, once: bool = True) -> StreamingQuery:
    """Runs handle on every micro-batch; handle must be idempotent by batch id, as a batch may run again after a failure."""
    writer = stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
