"""The queue as a stream, against a plain loop over the same events."""

import json
from datetime import UTC, datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sedge.streaming import queue

T0 = datetime(2024, 1, 1, tzinfo=UTC)


class Folder:
    def __init__(self, spark, tmp):
        self.spark, self.dir, self.n = spark, tmp, 0
        (tmp / "in").mkdir()

    def tell(self, *events):
        """(job, kind, attempt, error, minute)"""
        self.n += 1
        rows = [{"job_id": j, "kind": k, "attempt": a, "error": e, "at": (T0 + timedelta(minutes=m)).isoformat()} for j, k, a, e, m in events]
        (self.dir / "in" / f"{self.n:04d}.json").write_text("\n".join(map(json.dumps, rows)))

    def run(self, lease=30, spoil=None):
        """Each call starts the query again from its checkpoint and takes in what is there."""
        moved = queue.transitions(queue.event_stream(self.spark, str(self.dir / "in")), lease)
        if spoil is not None:
            moved = moved.withColumn("status", F.when(spoil, F.raise_error(F.lit("killed")).cast("string")).otherwise(F.col("status")))
        q = moved.writeStream.format("parquet").option("path", str(self.dir / "out")).option("checkpointLocation", str(self.dir / "check")).trigger(availableNow=True).start()
        if not q.awaitTermination(100):
            q.stop()
            raise AssertionError("the stream didn't end")

    def moved(self):
        minute = ((F.unix_millis("at") - int(T0.timestamp() * 1000)) / 60000).cast("int")
        again = ((F.unix_millis("next_retry_at") - int(T0.timestamp() * 1000)) / 60000).cast("int")
        return sorted(tuple(r) for r in self.spark.read.parquet(str(self.dir / "out")).select("job_id", minute, "status", "attempts", "last_error", again).collect())


@pytest.fixture
def folder(spark, tmp_path):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "2")
    yield Folder(spark, tmp_path)
    spark.conf.set("spark.sql.shuffle.partitions", old)


def test_retries_leases_and_restarts(folder):
    folder.tell((1, "submitted", None, None, 0), (2, "submitted", None, None, 0), (3, "submitted", None, None, 0), (1, "submitted", None, None, 0))
    folder.run()
    assert folder.moved() == [(j, 0, "processing", 1, None, None) for j in (1, 2, 3)]
    folder.tell((1, "done", 1, None, 1), (2, "failed", 1, "broken", 1), (9, "done", 1, None, 1), (None, "done", 1, None, 1))
    # told twice, and by a worker of another attempt
    folder.tell((1, "done", 1, None, 1), (2, "failed", 1, "broken", 1), (2, "done", 2, None, 1))
    folder.run()
    folder.tell((None, "tick", None, None, 4))
    # a batch that breaks off in the middle, and a new start
    with pytest.raises(Exception, match="killed"):
        folder.run(spoil=F.col("attempts") == 2)
    folder.run()
    want = [(1, 0, "processing", 1, None, None), (1, 1, "completed", 1, None, None), (2, 0, "processing", 1, None, None), (2, 1, "queued", 1, "broken", 3), (2, 3, "processing", 2, None, None), (3, 0, "processing", 1, None, None)]
    assert folder.moved() == want
    # the lease of 2's second attempt ends at 33, 3's first at 30; what 3 says later is too late
    folder.tell((None, "tick", None, None, 31))
    folder.run()
    folder.tell((3, "done", 1, None, 31), (2, "failed", 2, "again", 32))
    folder.run()
    folder.tell((None, "tick", None, None, 60))
    folder.run()
    got = folder.moved()
    assert [x for x in got if x[0] == 3] == [(3, 0, "processing", 1, None, None), (3, 30, "queued", 1, queue.LEASE_ENDED, 32), (3, 32, "processing", 2, None, None)]
    assert [x for x in got if x[0] == 2][-2:] == [(2, 32, "queued", 2, "again", 36), (2, 36, "processing", 3, None, None)]
    assert len(got) == len(set(got))


def test_five_failures_end_a_job(folder):
    minute = 0
    folder.tell((7, "submitted", None, None, 0))
    folder.run(lease=100)
    for n in range(1, 6):
        folder.tell((7, "failed", n, f"e{n}", minute + 2))  # what isn't later than the last tick is too late
        folder.run(lease=100)
        minute += 2 + 2**n
        folder.tell((None, "tick", None, None, minute + 1))
        folder.run(lease=100)
    got = folder.moved()
    assert [x[2:5] for x in got] == [y for n in range(1, 6) for y in (("processing", n, None), ("queued" if n < 5 else "failed", n, f"e{n}"))]
    assert [x[5] - x[1] for x in got if x[5] is not None] == [2, 4, 8, 16]


def test_one_go_over_a_table(spark):
    at = [T0 + timedelta(minutes=i) for i in range(9)]
    outcomes = [(1, 1, None, at[1]), (2, 1, "a", at[1]), (2, 1, None, at[2]), (2, 3, None, at[3]), (3, 1, "a", at[1]), (3, 2, None, at[2]), (3, 3, "b", at[3]), *[(4, n, f"e{n}", at[n]) for n in range(1, 7)], (6, 1, None, at[1]), (None, 1, None, at[1])]
    got = queue.final_states(spark.createDataFrame([(j,) for j in (1, 2, 3, 4, 5)], "job_id long"), spark.createDataFrame(outcomes, "job_id long, attempt int, error string, at timestamp"))
    assert sorted(tuple(r)[:4] for r in got.collect()) == [(1, "completed", 1, None), (2, "queued", 1, "a"), (3, "completed", 2, None), (4, "failed", 5, "e5"), (5, "processing", 1, None)]
    assert [r[0] for r in got.filter("job_id = 2").select((F.unix_millis("next_retry_at") - int(T0.timestamp() * 1000)) / 60000).collect()] == [3.0]
