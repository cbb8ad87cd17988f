"""A durable priority queue as a table: every tick is a function of (tasks, as_of)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def aged_priority(priority: Column, available_at: Column, as_of: Column, step_s: int = 600, most: int = 60) -> Column:
    """Priority plus one for every ``step_s`` seconds waited, ``most`` at most."""
    waited = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(available_at.cast("timestamp"))
    return priority + F.least(F.lit(most), F.floor(waited / step_s)).cast("long")


def claim(tasks: DataFrame, as_of: Column, n: int) -> DataFrame:
    """The ``n`` due queued tasks with the highest aged priority; ties by time, then id."""
    due = tasks.filter((F.col("status") == "queued") & (F.col("available_at") <= as_of))
    ranked = due.withColumn("rank_priority", aged_priority(F.col("priority"), F.col("available_at"), as_of))
    return ranked.orderBy(F.desc("rank_priority"), "available_at", "id").limit(n)


def ready(status: Column, next_at: Column, started_at: Column, as_of: Column, stale_s: int) -> Column:
    """Pending, a due retry, or processing for too long."""
    stale = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(started_at.cast("timestamp")) > stale_s
    return (status == "pending") | ((status == "retry") & (next_at <= as_of)) | ((status == "processing") & stale)


def failed(status: Column, attempts: Column, rate_limited: Column, most: int) -> tuple[Column, Column]:
    """Status and attempts after a failure: a rate limit refunds the attempt, the last one is terminal."""
    left = F.when(rate_limited, F.greatest(attempts - 1, F.lit(0))).otherwise(attempts)
    return F.when(rate_limited | (attempts < most), F.lit("retry")).otherwise(F.lit("failed")), left


def recover(tasks: DataFrame, as_of: Column, stale_s: int) -> DataFrame:
    """Tasks that have run for too long are queued again."""
    stale = (F.col("status") == "running") & (F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("started_at").cast("timestamp")) > stale_s)
    return tasks.withColumns({"status": F.when(stale, "queued").otherwise(F.col("status")), "started_at": F.when(stale, None).otherwise(F.col("started_at"))})
