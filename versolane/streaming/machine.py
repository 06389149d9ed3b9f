"""The state of each translation job as a machine: legal moves, illegal ones, late events and evictions are rows.

A job waits (`pending`), runs (`processing`) and ends (`completed` or `error`). One rule, `Job`, says what an event does; a stream keeps one `Job` for each
job as value state with an event-time timer, and a batch walks sorted partitions with it. So both give the same rows.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from .jobs import started

#: The moves that a job can make, as state and kind of event to the next state.
MOVES = {("pending", "started"): "processing", ("processing", "progress"): "processing", ("processing", "completed"): "completed", ("processing", "error"): "error"}
SILENCE = 6 * 3600 * 1000  # milliseconds without an event after which a job is forgotten
STATE = "state string, last long, events long"
ROWS = "job_id long, event_id long, at_ms long, kind string, from_state string, to_state string, verdict string"
NAMES = [x.split()[0] for x in ROWS.split(", ")]
#: Spark's state store that can hold timers.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Job:
    """State, time of the last event in milliseconds, and how many events there were."""

    def __init__(self, state: str = "pending", last: int | None = None, events: int = 0, silence: int = SILENCE):
        self.state, self.last, self.events, self.silence = state, last, events, silence

    @property
    def until(self) -> int | None:
        """When the job is forgotten if nothing happens."""
        return None if self.last is None else self.last + self.silence

    def evict(self, job_id: Any) -> tuple:
        row = (job_id, None, self.until, None, self.state, None, "evicted")
        self.state, self.last, self.events = "pending", None, 0
        return row

    def take(self, job_id: Any, event_id: int, at: int, kind: str | None) -> Iterator[tuple]:
        """The rows that an event makes. One before the job's last event is late and changes nothing. One after its silence finds a new job."""
        if self.last is not None and at < self.last:
            yield job_id, event_id, at, kind, self.state, self.state, "late"
            return
        if self.last is not None and at >= self.until:
            yield self.evict(job_id)
        to = MOVES.get((self.state, kind))
        yield job_id, event_id, at, kind, self.state, to or self.state, "moved" if to else "illegal"
        self.state, self.last, self.events = to or self.state, at, self.events + 1


def _frame(rows: list[tuple]) -> pd.DataFrame:
    return pd.DataFrame({name: pd.Series(column, dtype=object) for name, column in zip(NAMES, zip(*rows) if rows else [()] * len(NAMES))})  # as they are: no types to guess for each job


class Machine(StatefulProcessor):
    """Keeps a job's state until it has been silent; the timer that ends it moves with each event."""

    def __init__(self, silence: int = SILENCE):
        self.silence = silence

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", STATE)

    def _load(self) -> Job:
        return Job(*self.job.get(), silence=self.silence) if self.job.exists() else Job(silence=self.silence)

    def handleInputRows(self, key: Any, rows: Iterator[pd.DataFrame], timerValues: Any) -> Iterator[pd.DataFrame]:
        job = self._load()
        before = job.until
        # a job's events of one micro-batch, in order of arrival
        events = sorted((event for batch in rows for event in zip(*(batch[c].tolist() for c in ("event_id", "at_ms", "kind")))), key=lambda event: event[0])
        out = [row for event in events for row in job.take(int(key[0]), *event)]
        if job.until != before:
            if before is not None:
                self.handle.deleteTimer(before)
            self.handle.registerTimer(job.until)
        self.job.update((job.state, job.last, job.events))
        yield _frame(out)

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[pd.DataFrame]:
        job = self._load()
        self.job.clear()
        yield _frame([job.evict(key[0])] if job.last is not None else [])

    def close(self) -> None:
        pass


def _told(events: DataFrame) -> DataFrame:
    return events.select("job_id", "event_id", "ts", F.unix_millis("ts").alias("at_ms"), "kind")


def transitions(events: DataFrame, lateness: str = "1 hour", silence: int = SILENCE) -> DataFrame:
    """ROWS for a stream of job events (job_id, event_id, ts, kind): each event's verdict, and an eviction for each job that was silent for `silence` milliseconds.

    Events of a job in one micro-batch are taken in order of event_id. Spark drops events behind the watermark, which is `lateness` behind the latest. Needs the state store in STORE.
    """
    rows = _told(events).withWatermark("ts", lateness)
    return rows.groupBy("job_id").transformWithStateInPandas(Machine(silence), outputStructType=ROWS, outputMode="append", timeMode="eventTime")


def folded(events: DataFrame, until: int | None = None, silence: int = SILENCE) -> DataFrame:
    """The rows of `transitions` for a whole table, jobs still silent evicted if their time is before `until` (milliseconds). A job's events stream by; none is gathered."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        job, of = Job(silence=silence), None
        for batch in batches:
            out = []
            for job_id, event_id, at, kind in zip(batch["job_id"], batch["event_id"], batch["at_ms"], batch["kind"]):
                if job_id != of:
                    out += ended(job, of)
                    job, of = Job(silence=silence), job_id
                out += job.take(job_id, event_id, at, kind)
            yield _frame(out)
        yield _frame(ended(job, of))

    def ended(job: Job, of: Any) -> list[tuple]:
        return [job.evict(of)] if until is not None and job.until is not None and job.until < until else []

    return _told(events).drop("ts").repartition("job_id").sortWithinPartitions("job_id", "event_id").mapInPandas(run, ROWS)


def with_timers(spark: SparkSession, start: Callable[[], Any]) -> Any:
    """start(), a query of `transitions`, with the state store that it needs; the session's own choice stays as it was."""
    return started(spark, *STORE, start)
