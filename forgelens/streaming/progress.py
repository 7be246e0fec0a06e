"""Progress as a stream: the latest state of each job, thinned, with heartbeats."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import islice

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.enums import TERMINAL

OUT = "job_id string, status string, progress double, seq long, kind string, at long"
#: The state store that keeps timers and forgets by age.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Milliseconds: between two changes of a job, until a heartbeat, and for which it is
#: remembered that a job has ended.
THROTTLE, HEARTBEAT, REMEMBER = 250, 25_000, 3_600_000
#: Rows that are handed to a receiver at once.
FRAME = 10_000


def step(state: tuple[str, float, int] | None, rows: list[tuple]) -> tuple[str, float, int]:
    """The state after rows (seq, status, progress): what the batch fold would say."""
    status, progress, last = state or ("queued", 0.0, -1)
    for seq, new, value in sorted(rows, key=lambda r: r[0]):
        if status in TERMINAL or seq <= last:
            continue
        last = seq
        status = new or status
        if value is not None and value == value:
            progress = min(max(float(value), 0.0), 1.0)
        if status == "queued" and progress > 0:
            status = "running"
        if status == "completed":
            progress = 1.0
    return status, progress, last


class Latest(StatefulProcessor):
    """One job: its first change goes out at once, later ones ``throttle`` after the last that
    went, as the latest of what came since; its end always goes at once. While nothing goes
    out for ``heartbeat``, its state goes out again. A job that has ended leaves only a mark,
    which is forgotten after ``remember``; events that come before that change nothing."""

    def __init__(self, throttle: int = THROTTLE, heartbeat: int = HEARTBEAT, remember: int = REMEMBER):
        self.throttle, self.heartbeat, self.remember = throttle, heartbeat, remember

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("state", "status string, progress double, seq long, sent long, waiting boolean")
        self.ended = handle.getValueState("ended", "seq long", self.remember)

    def _again(self, at: int) -> None:
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(at)

    def _out(self, job: str, now: tuple[str, float, int], kind: str, at: int) -> Row:
        self.state.update((*now, at, False))
        self._again(at + self.heartbeat)
        return Row(job_id=job, status=now[0], progress=now[1], seq=now[2], kind=kind, at=at)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        events = [(r.seq, r.status, r.progress) for r in rows]
        if self.ended.exists():
            return
        at, known = timerValues.getCurrentProcessingTimeInMs(), self.state.get() if self.state.exists() else None
        now = step(tuple(known[:3]) if known else None, events)
        if now[0] in TERMINAL:
            for timer in list(self.handle.listTimers()):
                self.handle.deleteTimer(timer)
            self.state.clear()
            self.ended.update((now[2],))
            yield Row(job_id=key[0], status=now[0], progress=now[1], seq=now[2], kind="change", at=at)
        elif known is None or at - known[3] >= self.throttle:
            yield self._out(key[0], now, "change", at)
        elif now != tuple(known[:3]):
            self.state.update((*now, known[3], True))
            self._again(known[3] + self.throttle)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.state.exists():
            known = self.state.get()
            yield self._out(key[0], tuple(known[:3]), "change" if known[4] else "heartbeat", timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def latest(events: DataFrame, throttle: int = THROTTLE, heartbeat: int = HEARTBEAT, remember: int = REMEMBER) -> DataFrame:
    """Changes and heartbeats of a stream of events (see jobs.EVENTS): rows as in OUT, ``at``
    in milliseconds. Sets the session's state store to the one that has timers."""
    events.sparkSession.conf.set(*STORE)
    return events.select("job_id", "seq", "status", "progress").groupBy("job_id").transformWithState(Latest(throttle, heartbeat, remember), OUT, "Update", "ProcessingTime")


def serve(events: DataFrame, send: Callable[[pd.DataFrame, int], None], checkpoint: str, seconds: float = 1, **limits: int):
    """Sends each trigger's rows to ``send(frame, batch)`` as they are read, some thousands at
    a time; between them only the latest of a job is kept, so values in between may be lost,
    the last never. Timers run at triggers, so every trigger makes a batch: the query is
    never idle, and ``processAllAvailable`` does not return."""

    def each(df: DataFrame, batch: int) -> None:
        rows = df.toLocalIterator(prefetchPartitions=True)
        while some := list(islice(rows, FRAME)):
            send(pd.DataFrame([r.asDict() for r in some]), batch)

    query = latest(events, **limits).writeStream.outputMode("update").option("checkpointLocation", checkpoint)
    return query.foreachBatch(each).trigger(processingTime=f"{int(seconds * 1000)} milliseconds").start()
