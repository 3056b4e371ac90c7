"""Streaming forms of accumulating captures (an extension; batches do the same)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text


def new_items(stream: DataFrame, url: str, ts: str, delay: str) -> DataFrame:
    """The first capture of each normalised url within the watermark's delay."""
    keyed = stream.withColumn("key", text.normalize_url(F.col(url))).withColumn(ts, F.col(ts).cast("timestamp"))
    return keyed.withWatermark(ts, delay).dropDuplicatesWithinWatermark(["key"])


def windowed_counts(stream: DataFrame, ts: str, key: str, width: str, delay: str, slide: str | None = None) -> DataFrame:
    """Counts per key and tumbling or sliding window, final once late data is over."""
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(F.window(ts, width, slide), key).agg(F.count("*").alias("n"))


def sessions(stream: DataFrame, ts: str, key: str, gap: str, delay: str, value: Column) -> DataFrame:
    timed = stream.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, delay)
    return timed.groupBy(F.session_window(ts, gap), key).agg(F.count("*").alias("n"), F.sum(value).alias("total"))


def upsert_each_batch(stream: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str):
    """A started query that hands every micro-batch to an idempotent upsert."""
    return stream.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write).start()
