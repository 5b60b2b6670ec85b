"""Streams that remember: re-scored candidates, expiring caches, stalled jobs (survey R4, R5, R11, R13).

Each is a StatefulProcessor by key with event-time timers, so what happens when is decided by the rows' own
times and is the same after a restart from the checkpoint. State lives in the checkpoint beside the shared
folder. The session needs a state store with timers: call prepare() first.

A key's rows of one micro-batch go by their time; a candidate or job has a handful, and of a cached entry only
the newest is kept, so no key's rows are gathered. Rows with a null key or time are left out.
"""

from __future__ import annotations

import datetime
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.observations import MOST_ATTEMPTS, RETRY_MINUTES
from ..operators.scoring import dynamic_score

MOST_CONFIDENCE = 98
STALL_SECONDS, MOST_REQUEUES = 120, 2


def prepare(spark: SparkSession) -> None:
    """Sets the state store that keeps timers."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def _ms(at: datetime.datetime) -> int:
    return round(at.timestamp() * 1000)


def _at(ms: int) -> datetime.datetime:
    return datetime.datetime.fromtimestamp(ms / 1000)


def _row(schema: str) -> Row:
    """Makes rows with the schema's names."""
    return Row(*[field.split()[0] for field in schema.split(", ")])


def _by_time(rows: Iterator[Row]) -> list[Row]:
    return sorted(rows, key=lambda r: r["at"])


# ---- R5, R4: measurements of a candidate -----------------------------------------------------------------------------

_MEASURED = (
    "candidate_id long, at timestamp, target_hours int, views long, status string, attempts int, previous_views long, previous_elapsed double, elapsed_hours double, baseline_views long, initial_score int, initial_vph double, peer_median double, peer_p85 double, due_at timestamp"
)
_RESCORED = "candidate_id long, at timestamp, target_hours int, status string, attempts int, score int, stage string, outcome string, confidence int, event string, due_at timestamp"
_EXPIRING, _RESUMED = "key string, at timestamp, payload string, gone boolean", "job_id string, at timestamp, state string, requeues int, done int, left int"


class Measured(StatefulProcessor):
    """Emits each measurement with the one before it. A failed one (null views) is due again after some minutes, by a timer, and an error after as many attempts as there may be."""

    def __init__(self, retry_minutes: int, attempts: int):
        self.retry_ms, self.attempts = retry_minutes * 60_000, attempts

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "views long, elapsed double")
        self.tried = handle.getMapState("tried", "target_hours int", "attempts int")
        self.due = handle.getMapState("due", "target_hours int", "due_at long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in _by_time(rows):
            hours = (r["target_hours"],)
            elapsed = (r["at"] - r["baseline_at"]).total_seconds() / 3600
            before = self.last.get() if self.last.exists() else (None, None)
            if r["views"] is not None:
                status, n = "done", self.tried.getValue(hours)[0] if self.tried.containsKey(hours) else 0
                self.last.update((r["views"], elapsed))
                self.tried.removeKey(hours)
                self.due.removeKey(hours)
                due = None
            else:
                due, n = None, 1 + (self.tried.getValue(hours)[0] if self.tried.containsKey(hours) else 0)
                status = "error" if n >= self.attempts else "retry"
                self.tried.updateValue(hours, (n,))
                if status == "retry":
                    due = _ms(r["at"]) + self.retry_ms
                    self.due.updateValue(hours, (due,))
                    self.handle.registerTimer(due)
            yield _row(_MEASURED)(*key, r["at"], *hours, r["views"], status, n, *before, elapsed, r["baseline_views"], r["initial_score"], r["initial_vph"], r["peer_median"], r["peer_p85"], due and _at(due))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        for hours, (due,) in list(self.due.iterator()):
            if due <= now:
                self.due.removeKey(hours)
                # What goes on to the next step has to be later than the watermark.
                yield _row(_MEASURED)(*key, _at(timerValues.getCurrentWatermarkInMs() + 1), *hours, None, "due", self.tried.getValue(hours)[0], *[None] * 8, _at(due))

    def close(self) -> None: ...


class Resolved(StatefulProcessor):
    """Adds up a candidate's evidence and sets its outcome once."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.known = handle.getValueState("known", "confidence int, outcome string, stage string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        for r in _by_time(rows):
            confidence, outcome, stage = self.known.get() if self.known.exists() else (0, "pending", "watch")
            event = None
            if r["status"] == "done":
                confidence = min(MOST_CONFIDENCE, confidence + (5 if r["target_hours"] <= 1 else 10 if r["target_hours"] <= 3 else 15))
                event = "winner" if r["stage"] == "early_winner" != stage else None
                if outcome == "pending" != r["outcome"]:
                    outcome = r["outcome"]
                    event = "confirmed" if outcome == "confirmed" else event
                stage = r["stage"]
                self.known.update((confidence, outcome, stage))
            yield _row(_RESCORED)(*key, r["at"], r["target_hours"], r["status"], r["attempts"], r["score"], stage, outcome, confidence, event, r["due_at"])

    def close(self) -> None: ...


def rescored(measurements: DataFrame, late: str = "90 minutes", retry_minutes: int = RETRY_MINUTES, attempts: int = MOST_ATTEMPTS) -> DataFrame:
    """Measurements (candidate_id, at, target_hours, views or null if it failed, baseline_at, baseline_views, initial_score, initial_vph, peer_median, peer_p85) as they change a candidate.

    Gives candidate_id, at, target_hours, status (done, retry, due, error), attempts, score, stage, outcome, confidence, event, due_at (of a retry).
    """
    rows = measurements.filter("candidate_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    seen = rows.groupBy("candidate_id").transformWithState(statefulProcessor=Measured(retry_minutes, attempts), outputStructType=_MEASURED, outputMode="Append", timeMode="EventTime", eventTimeColumnName="at")
    scored = dynamic_score(seen).withColumn("score", F.when(F.col("status") == "done", F.col("score")))
    columns = ["candidate_id", "at", "target_hours", "status", "attempts", "score", "stage", "outcome", "due_at"]
    return scored.select(*columns).groupBy("candidate_id").transformWithState(statefulProcessor=Resolved(), outputStructType=_RESCORED, outputMode="Append", timeMode="None")


# ---- R13: entries that expire ----------------------------------------------------------------------------------------


class Expiring(StatefulProcessor):
    """Keeps the newest payload of a key; emits what it keeps, and the entry once more when its time is over."""

    def __init__(self, seconds: int):
        self.ms = seconds * 1000

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.entry = handle.getValueState("entry", "at long, payload string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        newest = max(((_ms(r["at"]), r["payload"]) for r in rows), key=lambda x: (x[0], x[1] or ""))
        if not self.entry.exists() or newest[0] >= self.entry.get()[0]:
            self.entry.update(newest)
            self.handle.registerTimer(newest[0] + self.ms)
            yield _row(_EXPIRING)(*key, _at(newest[0]), newest[1], False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        if self.entry.exists() and self.entry.get()[0] + self.ms <= expiredTimerInfo.getExpiryTimeInMs():
            at, payload = self.entry.get()
            self.entry.clear()
            yield _row(_EXPIRING)(*key, _at(at), payload, True)

    def close(self) -> None: ...


def expiring(entries: DataFrame, seconds: int, late: str = "1 minute") -> DataFrame:
    """Entries (key string, at, payload string) with gone: false as they come, true when `seconds` have passed without a newer one."""
    rows = entries.filter("key IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return rows.groupBy("key").transformWithState(statefulProcessor=Expiring(seconds), outputStructType=_EXPIRING, outputMode="Append", timeMode="EventTime")


# ---- R11: jobs that stall --------------------------------------------------------------------------------------------


class Stalling(StatefulProcessor):
    """Keeps which parts of a job are done. A job without progress is queued again with what is left, a few times, then handed over."""

    def __init__(self, seconds: int, requeues: int):
        self.ms, self.requeues = seconds * 1000, requeues

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", "total int, last long, requeues int")
        self.done = handle.getMapState("done", "url string", "views long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        total, last, again = self.job.get() if self.job.exists() else (0, 0, 0)
        for r in rows:
            total, last = max(total, r["total"] or 0), max(last, _ms(r["at"]))
            if r["url"] is not None:
                self.done.updateValue((r["url"],), (r["views"],))
        n = sum(1 for _ in self.done.keys())
        if total and n >= total:
            yield _row(_RESUMED)(*key, _at(last), "done", again, n, 0)
            self.job.clear()
            self.done.clear()
            return
        self.job.update((total, last, again))
        self.handle.registerTimer(last + self.ms)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        now = expiredTimerInfo.getExpiryTimeInMs()
        if not self.job.exists():
            return
        total, last, again = self.job.get()
        if last + self.ms > now:
            return
        n = sum(1 for _ in self.done.keys())
        if again >= self.requeues:
            yield _row(_RESUMED)(*key, _at(now), "fallback", again, n, total - n)
            self.job.clear()
            self.done.clear()
            return
        self.job.update((total, now, again + 1))
        self.handle.registerTimer(now + self.ms)
        yield _row(_RESUMED)(*key, _at(now), "requeued", again + 1, n, total - n)

    def close(self) -> None: ...


def resumed(progress: DataFrame, seconds: int = STALL_SECONDS, requeues: int = MOST_REQUEUES, late: str = "0 seconds") -> DataFrame:
    """Progress (job_id string, at, total, url or null, views) of jobs with their ends: done, requeued (with what is left) or fallback."""
    rows = progress.filter("job_id IS NOT NULL AND at IS NOT NULL").withWatermark("at", late)
    return rows.groupBy("job_id").transformWithState(statefulProcessor=Stalling(seconds, requeues), outputStructType=_RESUMED, outputMode="Append", timeMode="EventTime")
