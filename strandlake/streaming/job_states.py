"""The life of a job as a state machine over its events, in order of event time whatever order they arrive in.

A job begins with its first `start`, goes on with `running`, and closes with `end` or `error`, or by itself when nothing that
counts has come for as long as `timeout`. Every event gets an outcome: accepted, early (the job has not begun), repeated
(another start) or closed (the job has ended); a timeout is a row of its own.

Events wait in state, by their time, until the watermark has passed them; a timer then hands them on in order, so the
result is that of the same events in batch (operators.jobs.transitions). Only the events of one millisecond of one job are in
memory at a time, however hot the job is: the rest lies in the state store. Events behind the watermark are dropped by Spark, and
a deadline that is set behind it falls due in the next micro-batch.
The store has to be RocksDB: set spark.sql.streaming.stateStore.providerClass to PROVIDER.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUTCOMES = "job_id long, event_id long, outcome string, status string"
CLOSING = {"end": "done", "error": "error"}


class JobStates(StatefulProcessor):
    def __init__(self, timeout_ms: int):
        self.timeout = timeout_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "ms long", "ids array<long>, statuses array<string>")
        self.job = handle.getValueState("job", "status string, last long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for row in rows:
            held = self.waiting.getValue((row.ms,)) if self.waiting.containsKey((row.ms,)) else ([], [])
            if not held[0]:
                self.handle.registerTimer(row.ms)
            self.waiting.updateValue((row.ms,), ([*held[0], row.event_id], [*held[1], row.status]))
        yield from ()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        status, last = self.job.get() if self.job.exists() else (None, None)
        events = []
        if self.waiting.containsKey((now,)):
            ids, statuses = self.waiting.getValue((now,))
            events = sorted(zip(ids, statuses, strict=True))
            self.waiting.removeKey((now,))
        # The deadline may lie before these events, or be what this timer is for.
        open_ = status in ("submitted", "running")
        if open_ and (now > last + self.timeout or not events and now == last + self.timeout):
            status = "timeout"
            yield Row(job_id=key[0], event_id=None, outcome="timeout", status=status)
        for event_id, said in events:
            outcome = "accepted"
            if status is None:
                outcome, status = ("accepted", "submitted") if said == "start" else ("early", None)
            elif said == "start":
                outcome = "repeated"
            elif status not in ("submitted", "running"):
                outcome = "closed"
            else:
                status = CLOSING.get(said, "running")
            if outcome == "accepted":
                last = now
                if status in ("submitted", "running"):
                    self.handle.registerTimer(last + self.timeout)
            yield Row(job_id=key[0], event_id=event_id, outcome=outcome, status=status)
        if status is not None:
            if status in ("submitted", "running") and now == last + self.timeout:
                self.handle.registerTimer(now + 1)  # the deadline was this very millisecond, and nothing in it counted
            self.job.update((status, last))

    def close(self) -> None:
        pass


def transitions(events: DataFrame, timeout_ms: int, delay: str = "0 seconds") -> DataFrame:
    """job_id, event_id, outcome and status of a stream of events (job_id, event_id, ts, status), delay late at most."""
    at = F.col("ts").cast("timestamp")
    rows = events.where(F.col("job_id").isNotNull()).select("job_id", "event_id", "status", F.unix_millis(at).alias("ms"), at.alias("at")).withWatermark("at", delay)
    return rows.groupBy("job_id").transformWithState(statefulProcessor=JobStates(timeout_ms), outputStructType=OUTCOMES, outputMode="Append", timeMode="EventTime")
