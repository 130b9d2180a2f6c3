"""A durable queue of jobs: a stream's batches become versions of a table, each batch once.

A batch holds what happened to jobs: id, kind (submit, start, finish or fail, cancel), queue, at, seq.
A job is what its id is: later submissions of one change nothing. Only a queued job starts, only a
running one ends, a cancellation takes effect on both, and nothing follows an end. A batch and its
number are published in one commit, so a batch that comes again after a failure is known and left out.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.commits import Versions
from ..operators.jobs import queue_order
from ..session import written

PARTS = 32
#: What an event makes of a status; all else leaves it as it is.
STEPS = {("", "submit"): "queued", ("queued", "start"): "running", ("running", "finish"): "completed", ("running", "fail"): "failed", ("queued", "cancel"): "cancelled", ("running", "cancel"): "cancelled"}
SCHEMA = "id string, queue string, at timestamp, seq bigint, status string, part int"


def _step(status: Column, kind: Column) -> Column:
    out = status
    for (before, event), after in STEPS.items():
        out = F.when((status == before) & (kind == event), after).otherwise(out)
    return out


class Queue:
    """The queue at ``path``."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.table = spark, Versions(spark, path, "part")

    def jobs(self) -> DataFrame:
        """All jobs: id, queue, at and seq of the submission, status."""
        return (self.table.read() if self.table.latest() else self.spark.createDataFrame([], SCHEMA)).drop("part")

    def waiting(self, queues: Sequence[str]) -> DataFrame:
        """``id, queue, place`` of queued jobs in the order in which workers take them: earlier named queues first."""
        return queue_order(self.jobs().filter("status = 'queued'"), queues)

    def apply(self, events: DataFrame, batch: int, stream: str = "jobs") -> bool:
        """Publish what a batch's events make of the queue; False if the batch, or a later one, has been published."""
        if self.table.notes().get(stream, -1) >= batch:
            return False
        part = F.pmod(F.xxhash64("id"), F.lit(PARTS)).cast("int")
        known = F.col("kind").isin(sorted({k for _, k in STEPS}))
        new = written(events.filter(F.col("id").isNotNull() & known).select(F.col("id").cast("string").alias("id"), "kind", "queue", "at", F.col("seq").cast("bigint").alias("seq")), "job-events")
        # A job has few events; they are one row for each here.
        each = new.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "seq", "kind", "queue"))).alias("events"))
        parts = [r.part for r in each.select(part.alias("part")).distinct().collect()]
        held = self.table.read(values=parts) if self.table.latest() else self.spark.createDataFrame([], SCHEMA)
        old = held.select("id", F.struct("queue", "at", "seq", "status").alias("old"))
        both = each.join(old, "id", "full")
        first = F.get(F.filter("events", lambda e: e["kind"] == "submit"), F.lit(0))
        ended = F.aggregate(F.coalesce("events", F.expr("array()").cast(each.schema["events"].dataType)), F.coalesce("old.status", F.lit("")), lambda s, e: _step(s, e["kind"]))
        rows = both.select("id", *[F.coalesce(F.col(f"old.{c}"), first[c]).alias(c) for c in ("queue", "at", "seq")], ended.alias("status"), part.alias("part")).filter("status <> ''")
        self.table.replace(rows, parts, notes={stream: batch})
        return True

    def sink(self, stream: str = "jobs") -> Callable[[DataFrame, int], None]:
        """For ``foreachBatch``."""

        def publish(events: DataFrame, batch: int) -> None:
            self.apply(events, batch, stream)

        return publish
