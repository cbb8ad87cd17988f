"""Stateful operators over event streams, each with its batch form.

The batch forms are what the streams must add up to when a bounded input has been read to its end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def sessions(events: DataFrame, key: str, ts: str, gap_s: int) -> DataFrame:
    """(key, start, stop, n): runs of events of a key with less than ``gap_s`` seconds between them."""
    w = F.session_window(ts, f"{gap_s} seconds")
    s = events.groupBy(key, w.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("start"), F.max(ts).alias("stop"))
    return s.select(key, "start", "stop", "n")


def latest(events: DataFrame, key: str, order: str, value: str) -> DataFrame:
    """The value of a key's newest event; edits are later events of the same key."""
    return events.groupBy(key).agg(F.max_by(value, order).alias(value))


def bucket(ts: str, period_s: int) -> Column:
    """The number of the period that a time lies in."""
    return F.floor(F.unix_seconds(F.col(ts).cast("timestamp")) / period_s)


def once_a_bucket(events: DataFrame, keys: list[str], ts: str, period_s: int) -> DataFrame:
    """One row per keys and time bucket (a streaming dedup when ``events`` is a stream)."""
    return events.select(*keys, bucket(ts, period_s).alias("bucket")).dropDuplicates([*keys, "bucket"])


def newest_n(events: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """The bounded buffer of a key: its newest ``n`` events with their places."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return events.withColumn("place", F.row_number().over(w)).filter(F.col("place") <= n)
