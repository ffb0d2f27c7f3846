"""Streams of events. The batch model has no event-time operators of its own; these keep its tables current.

Idempotence (an event id counts once), a change feed, and daily counts, with the watermark as the bound of their state.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter


def once(stream: DataFrame, id_col: str, at: str, delay: str = "1 day") -> DataFrame:
    """Each id once, as long as its repeats come within `delay`."""
    return stream.withWatermark(at, delay).dropDuplicatesWithinWatermark([id_col])


def daily_counts(stream: DataFrame, at: str, keys: list[str], delay: str = "1 day") -> DataFrame:
    """Counts by day and keys; a day is final when the watermark has passed it."""
    return stream.withWatermark(at, delay).groupBy(F.window(at, "1 day").alias("day"), *keys).agg(F.count("*").alias("n")).select(F.to_date("day.start").alias("day"), *keys, "n")


def changes(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> DataStreamWriter:
    """Hand each batch of changes to `apply`, with its number, which lets a repeated batch be recognized."""
    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
