"""The ingestion queue as keyed state of a stream, with timers for retry, lease and giving up.

Events of a job go in: that it was submitted, and what became of an attempt. Transitions
come out: claims, which workers take as orders to work, and what follows from their
outcomes. An outcome counts only for the attempt that is in work, so what is told twice, or
told by a worker whose lease has ended, changes nothing. Time is the events' own: timers
run out as the watermark passes, the same way whenever a query starts again from its
checkpoint. State lies in RocksDB, by job; nothing of it passes through the driver.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, Row, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from sedge.functions import columns as C
from sedge.operators.jobs import MOST_ATTEMPTS

#: kind: submitted, done, failed, or tick, which only moves the time on (job_id null).
EVENTS = "job_id bigint, kind string, attempt int, error string, at timestamp"
TRANSITIONS = "job_id bigint, status string, attempts int, last_error string, next_retry_at timestamp, at timestamp"
_STATE = "status string, attempts int, last_error string, due bigint"
#: The error of an attempt whose worker didn't say in time what became of it.
LEASE_ENDED = "The lease of the attempt ended"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _time(ms: int) -> datetime:
    return datetime(1970, 1, 1) + timedelta(milliseconds=ms)


class Jobs(StatefulProcessor):
    """A job's state; ``due`` is when its timer runs out: the retry or the end of its lease."""

    def __init__(self, lease_minutes: int):
        self.lease = lease_minutes * 60_000

    def init(self, handle) -> None:
        self.handle = handle
        self.job = handle.getValueState("job", _STATE)

    def close(self) -> None:
        pass

    def _set(self, key: tuple, status: str, attempts: int, error: str | None, at: int, due: int | None) -> Row:
        old = self.job.get()
        if old is not None and old[3] is not None:
            self.handle.deleteTimer(old[3])
        if due is not None:
            self.handle.registerTimer(due)
        self.job.update((status, attempts, error, due))
        return Row(job_id=key[0], status=status, attempts=attempts, last_error=error, next_retry_at=_time(due) if status == "queued" and due is not None else None, at=_time(at))

    def _claim(self, key: tuple, attempts: int, at: int) -> Row:
        return self._set(key, "processing", attempts + 1, None, at, at + self.lease)

    def _fail(self, key: tuple, attempts: int, error: str | None, at: int) -> Row:
        if attempts >= MOST_ATTEMPTS:
            return self._set(key, "failed", attempts, error, at, None)
        return self._set(key, "queued", attempts, error, at, at + min(60, 2**attempts) * 60_000)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        order = {"submitted": 0, "failed": 1, "done": 2}
        # rows of a job and batch: what was submitted comes first, of one attempt's outcomes the first told
        for r in sorted(rows, key=lambda r: (r["kind"] != "submitted", r["attempt"] or 0, r["ms"], order.get(r["kind"], 3))):
            state = self.job.get()
            if r["kind"] == "submitted":
                if state is None:
                    yield self._claim(key, 0, r["ms"])
            elif state is not None and state[0] == "processing" and r["attempt"] == state[1] and r["ms"] < state[3]:
                if r["kind"] == "done":
                    yield self._set(key, "completed", state[1], None, r["ms"], None)
                elif r["kind"] == "failed":
                    yield self._fail(key, state[1], r["error"], r["ms"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        state, at = self.job.get(), expiredTimerInfo.getExpiryTimeInMs()
        if state is not None and state[3] == at:
            # Spark has dropped this timer itself
            self.job.update((*state[:3], None))
            if state[0] == "queued":
                yield self._claim(key, state[1], at)
            elif state[0] == "processing":
                yield self._fail(key, state[1], LEASE_ENDED, at)


def event_stream(spark: SparkSession, path: str) -> DataFrame:
    """Events as JSON files that arrive in a folder."""
    return spark.readStream.schema(EVENTS).json(path)


def transitions(events: DataFrame, lease_minutes: int = 30, delay: str = "0 seconds") -> DataFrame:
    """``TRANSITIONS`` of a stream of ``EVENTS``; ``delay``: how late an event may come.

    A job is claimed as soon as it is submitted, and again 2, 4, 8, 16 minutes after an
    attempt failed; after the fifth it has failed. An attempt without an outcome within
    the lease has failed too. Of several events of an attempt the first counts; events of
    unknown kind, null times, and times not after the watermark are passed over. A tick moves the time of all jobs.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)
    rows = events.filter("at is not null").withColumn("ms", F.unix_millis("at")).withWatermark("at", delay)
    # a tick keeps the time going and belongs to no job
    jobs = rows.filter("kind = 'tick' or job_id is not null").withColumn("job_id", F.when(F.col("kind") == "tick", F.lit(None)).otherwise(F.col("job_id")))
    moved = jobs.groupBy("job_id").transformWithState(statefulProcessor=Jobs(lease_minutes), outputStructType=TRANSITIONS, outputMode="Append", timeMode="EventTime")
    return moved.filter("job_id is not null")


def final_states(submitted: DataFrame, outcomes: DataFrame) -> DataFrame:
    """job_id, status, attempts, last_error, next_retry_at of ``submitted`` (job_id) after
    ``outcomes`` (job_id, attempt, error, at), in one go over a table of them.

    What ``transitions`` leads to where no lease ends: the first outcome of an attempt
    counts, attempts beyond a gap, a success or the fifth don't.
    """
    first = outcomes.filter(F.col("attempt").between(1, MOST_ATTEMPTS)).groupBy("job_id", "attempt").agg(F.min(F.struct("at", F.col("error").isNull().alias("done"), "error")).alias("o"))
    # five rows of a job at most
    before = Window.partitionBy("job_id").orderBy("attempt").rowsBetween(Window.unboundedPreceding, -1)
    told = first.withColumns({"nth": F.count("*").over(before) + 1, "over": F.coalesce(F.max("o.done").over(before), F.lit(False))}).filter("nth = attempt and not over")
    last = told.groupBy("job_id").agg(F.max_by("o", "attempt").alias("o"), F.max("attempt").alias("n"))
    rows = submitted.select("job_id").join(last, "job_id", "left")
    again = ~F.col("o.done") & (F.col("n") < MOST_ATTEMPTS)
    return rows.select(
        "job_id",
        F.when(F.col("o").isNull(), "processing").when(F.col("o.done"), "completed").when(again, "queued").otherwise("failed").alias("status"),
        F.coalesce("n", F.lit(1)).alias("attempts"),
        F.col("o.error").alias("last_error"),
        F.when(again, C.plus_minutes(F.col("o.at"), C.backoff_minutes("n"))).alias("next_retry_at"),
    )

