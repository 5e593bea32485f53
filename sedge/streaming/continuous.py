"""Structured Streaming forms of billing events, usage and the ingestion queue."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from sedge import schema as S
from sedge.operators import jobs as J
from sedge.operators import notices
from sedge.sources import versions


def notice_stream(spark: SparkSession, path: str, schema: str = "seq bigint, ts timestamp, body string") -> DataFrame:
    """Billing notices as JSON files that arrive in a folder."""
    return spark.readStream.schema(schema).json(path)


def first_notices(stream: DataFrame, delay: str = "1 hour", lifecycle: bool = False) -> DataFrame:
    """The first notice of each id within the watermark; state older than it goes."""
    return notices.read_notices(stream, lifecycle=lifecycle).withWatermark("ts", delay).dropDuplicatesWithinWatermark(["gateway", "event_id"])


def usage_by_window(stream: DataFrame, window: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Sums of usage for each user, metric and window; late events up to ``delay``."""
    return stream.withWatermark("occurred_at", delay).groupBy("user_id", "metric", F.window("occurred_at", window)).agg(F.sum("quantity").alias("quantity")).select("user_id", "metric", F.col("window.start").alias("window_start"), "quantity")


def each_batch(stream: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, interval: str | None = None) -> StreamingQuery:
    """Run ``apply`` on every micro-batch; without an interval, on what is there."""
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=interval) if interval else writer.trigger(availableNow=True)).start()


def work_queue(jobs: DataFrame, now, work: Callable[[DataFrame], DataFrame], limit: int = 2, lease_minutes: int | None = None) -> DataFrame:
    """Jobs after one turn: due ones are claimed, worked on and settled.

    ``work`` takes the claimed jobs and returns (id, error). The driver alone claims,
    so no job is worked on twice.
    """
    due = J.due_jobs(jobs, now, limit, lease_minutes).select("id").persist()
    claimed = J.claim(jobs.join(F.broadcast(due), "id", "left_semi"), now)  # 20 rows at most
    settled = J.settle(claimed, work(claimed), now)
    return jobs.join(F.broadcast(due), "id", "left_anti").select(*jobs.columns).unionByName(settled.select(*jobs.columns))


def subscription_sink(spark: SparkSession, events_path: str, subscriptions_path: str, prices: DataFrame, now: Column, stream: str = "notices", lifecycle: bool = False) -> Callable[[DataFrame, int], None]:
    """What ``each_batch`` runs on notices (seq, body): events and subscriptions after them.

    Both are tables in versions, and a version says which batch of ``stream`` it holds. The
    subscriptions are written first, the events that make repeats known last; a batch that
    broke off between runs again, finds the same notices new, and writes only what it hadn't.
    So each notice counts once, however often a batch is replayed.
    """

    def table(path: str, empty: str) -> DataFrame:
        return versions.read(spark, path) if versions.latest(spark, path) else spark.createDataFrame([], empty)

    def apply(batch: DataFrame, number: int) -> None:
        if versions.tags(spark, events_path).get(stream, -1) >= number:
            return
        rows = batch.persist()
        try:
            events, subscriptions = table(events_path, "gateway string, event_id string"), table(subscriptions_path, S.SUBSCRIPTIONS)
            new, after = notices.take_in(events, subscriptions, rows, prices, now, lifecycle=lifecycle)
            if versions.tags(spark, subscriptions_path).get(stream, -1) < number:
                users = notices.subscription_changes(notices.read_notices(rows, lifecycle=lifecycle), prices, "seq").select("user_id").distinct()
                versions.replace(after.join(users, "user_id", "left_semi").select(*subscriptions.columns), subscriptions_path, key="user_id", tags={stream: number})
            versions.replace(new, events_path, key="event_id", tags={stream: number})
        finally:
            rows.unpersist()

    return apply
