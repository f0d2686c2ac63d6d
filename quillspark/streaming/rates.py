"""Streaming extension: event rates by window, and n-gram counts over arriving documents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def event_rates(events: DataFrame, width: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """start, event_type, n, mean: tumbling windows behind a watermark; runs on a stream or a table."""
    e = events.withWatermark("ts", late) if events.isStreaming else events
    g = e.groupBy(F.window("ts", width), "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"))
    return g.select(F.col("window.start").alias("start"), "event_type", "n", "mean")


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: running counts (update mode on a stream)."""
    return docs.select(F.explode(T.metric_words(F.coalesce("text", F.lit("")))).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
