"""What a watcher of jobs is told: each change until a job ends, and heartbeats while nothing changes."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .jobs import TERMINAL

EVENTS = "id string, event string, status string, progress int, updated_at timestamp"
COLUMNS = ["id", "event", "status", "progress", "updated_at"]


class Watch(StatefulProcessor):
    """One job: its last version, kept for a time, and a timer that is set anew by each event."""

    def __init__(self, heartbeat_ms: int, keep_ms: int):
        self.heartbeat_ms, self.keep_ms = heartbeat_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "status string, progress int, micros bigint", ttlDurationMs=self.keep_ms)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        last = tuple(self.last.get()) if self.last.exists() else None
        out = []
        for r in pd.concat(rows).sort_values(["updated_at", "progress", "status"]).itertuples():
            version = (r.status, None if pd.isna(r.progress) else int(r.progress), r.updated_at.value // 1000)
            if last and (last[0] in TERMINAL or version[2] < last[2] or version == last):
                continue
            out.append((key[0], r.status, r.status, version[1], r.updated_at))
            last = version
        if out:
            self.last.update(last)
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            if last[0] not in TERMINAL:
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.heartbeat_ms)
        yield _frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: ANN001, N802, N803
        out = []
        if self.last.exists():
            status, progress, micros = self.last.get()
            if status not in TERMINAL:
                out.append((key[0], "heartbeat", status, progress, pd.Timestamp(micros, unit="us")))
                self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.heartbeat_ms)
        yield _frame(out)

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    out = pd.DataFrame(rows, columns=COLUMNS)
    return out.astype({"progress": "Int32", "updated_at": "datetime64[us]"})


def watched(rows: DataFrame, heartbeat_seconds: float = 15.0, keep_hours: float = 24.0) -> DataFrame:
    """``id, event, status, progress, updated_at``: an event for each new version of a job, named by its status, and
    ``heartbeat`` after each ``heartbeat_seconds`` without one.

    ``rows`` is a stream of id, status, progress, updated_at. Rows older than the last version are ignored,
    as is everything after a terminal status, for which there are no heartbeats. The state of a job goes
    ``keep_hours`` after its last version; null ids or statuses are left out. Needs the RocksDB state store.
    """
    known = rows.selectExpr("cast(id as string) id", "status", "cast(progress as int) progress", "updated_at").dropna(subset=["id", "status", "updated_at"])
    processor = Watch(int(heartbeat_seconds * 1000), int(keep_hours * 3_600_000))
    return known.groupBy("id").transformWithStateInPandas(processor, EVENTS, "append", "ProcessingTime")
