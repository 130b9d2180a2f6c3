"""Streams of job rows: submissions taken once, status changes emitted until a terminal one."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

TERMINAL = ("succeeded", "failed", "cancelled")


def once(jobs: DataFrame, key: str, ts: str, within: str = "1 hour") -> DataFrame:
    """The first row of each key; state is kept for ``within`` of event time. Null keys are one key."""
    return jobs.withWatermark(ts, within).dropDuplicatesWithinWatermark([key])


def counts(rows: DataFrame, ts: str, width: str, by: str, late: str = "10 minutes") -> DataFrame:
    """Rows of each window and value; later ones than ``late`` are left out once a window is closed."""
    w: Column = F.window(ts, width).alias("w")
    return rows.withWatermark(ts, late).groupBy(w, by).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), by, "n")


def status_changes(rows: DataFrame, keep_hours: int = 24) -> DataFrame:
    """``id, status, updated_at`` whenever an id's status differs from its last one.

    Rows of one batch are taken by updated_at, then status; older ones than the last row taken are
    ignored, and so is everything after a terminal status. The state of an id goes ``keep_hours`` of
    event time after its terminal status, so it doesn't grow for ever; a row that comes later still
    begins anew. Null ids or statuses are left out.
    """
    keep = keep_hours * 3_600_000

    def step(key: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        out = []
        if state.hasTimedOut:
            state.remove()
        else:
            last, at = state.get if state.exists else (None, None)
            for r in pd.concat(parts).sort_values(["updated_at", "status"]).itertuples():
                micros = r.updated_at.value // 1000
                if last in TERMINAL or at is not None and micros < at:
                    continue
                if r.status != last:
                    out.append((key[0], r.status, r.updated_at))
                last, at = r.status, micros
            if last is not None:
                state.update((last, at))
                if last in TERMINAL:
                    state.setTimeoutTimestamp(max(at // 1000 + keep, state.getCurrentWatermarkMs() + 1))
        yield pd.DataFrame(out, columns=["id", "status", "updated_at"])

    known = rows.select("id", "status", "updated_at").dropna().withWatermark("updated_at", f"{keep_hours} hours")
    kind = known.schema["id"].dataType.simpleString()
    return known.groupBy("id").applyInPandasWithState(step, f"id {kind}, status string, updated_at timestamp", "status string, at bigint", "append", GroupStateTimeout.EventTimeTimeout)
