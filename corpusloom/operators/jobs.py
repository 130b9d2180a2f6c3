"""Job rows in tables: status changes, queues and guarded transitions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import best_per_key


def status_changes(rows: DataFrame, terminal: Sequence[str]) -> DataFrame:
    """``id, status, at, seq`` of rows whose status differs from the one before, up to an id's first terminal one."""
    order = Window.partitionBy("id").orderBy("at", "seq")
    over = F.coalesce(F.max(F.col("status").isin(*terminal).cast("int")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    changed = ~F.col("status").eqNullSafe(F.lag("status").over(order))
    return rows.withColumns({"_over": over, "_changed": changed}).filter("_over = 0 and _changed").select("id", "status", "at", "seq")


def heartbeats(changes: DataFrame, until: Column, seconds: int) -> DataFrame:
    """``id, status, beats`` of each change: how many times ``seconds`` went by before an id's next change, or ``until`` for the last."""
    order = Window.partitionBy("id").orderBy("at", "seq")
    nearest = F.coalesce(F.lead("at").over(order), until)
    gap = F.unix_micros(nearest.cast("timestamp")) - F.unix_micros(F.col("at").cast("timestamp"))
    return changes.select("id", "status", "seq", F.floor(F.greatest(gap, F.lit(0)) / (seconds * 1_000_000)).cast("bigint").alias("beats"))


def queue_order(jobs: DataFrame, queues: Sequence[str]) -> DataFrame:
    """``id, queue, place``: each job once, by its first submission, in the order in which workers take them: queues by priority, then time.

    Places count within a queue; a queue's are dealt out by ranges of time, so no task sorts a whole queue.
    """
    first = best_per_key(jobs, ["id"], [F.col("at"), F.col("seq")], ["queue", "at", "seq"])
    priority = F.array_position(F.array(*[F.lit(q) for q in queues]), F.col("queue"))
    placed = first.filter(priority > 0).withColumn("day", F.date_trunc("hour", "at"))
    days = placed.groupBy("queue", "day").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("queue").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = F.row_number().over(Window.partitionBy("queue", "day").orderBy("at", "seq"))
    return placed.withColumn("k", within).join(days.withColumn("before", before).drop("n"), ["queue", "day"]).select("id", "queue", (F.col("before") + F.col("k")).alias("place"))


def guarded(events: DataFrame, cancel: str, done: Sequence[str]) -> DataFrame:
    """``id, status``: what becomes of queued jobs: a cancellation wins over all that comes after it, a terminal status over a later cancellation."""
    ends = events.filter(F.col("kind").isin(cancel, *done))
    first = best_per_key(ends, ["id"], [F.col("at"), F.col("seq")], ["kind"])
    return events.select("id").distinct().join(first, "id", "left").select("id", F.coalesce("kind", F.lit("queued")).alias("status"))
