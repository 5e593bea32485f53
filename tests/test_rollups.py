"""Hourly roll-ups against sums over all events."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from sedge.operators import billing, rollups
from sedge.streaming import continuous

NOW = datetime(2024, 1, 20, 12)
KINDS = ["model_input_tokens", "model_output_tokens", "embedding_input_tokens", "storage_gb_day", "unknown"]


def events(n, seed):
    rng = random.Random(seed)
    start = datetime(2024, 1, 1)
    moments = [start, start - timedelta(microseconds=1), datetime(2024, 1, 31, 23, 59, 59, 999999), datetime(2024, 2, 1)]
    at = lambda: rng.choice(moments) if rng.random() < 0.1 else start + timedelta(minutes=rng.randrange(-3000, 60000))
    big = 2**60
    return [(big + i, at(), 0, rng.choice("abc"), rng.choice(KINDS), rng.randrange(100)) for i in range(n)]


def sums(rows):
    """By user, metric and hour, from the highest revision of each event."""
    last = {}
    for r in rows:
        if r[1] and r[0] is not None:
            last[r[:2]] = max(last.get(r[:2], r), r, key=lambda x: (x[2], x[3:]))
    out = {}
    for r in [*last.values(), *(r for r in rows if r[0] is None and r[1])]:
        k = (r[3], r[4], r[1].replace(minute=0, second=0, microsecond=0))
        q, n = out.get(k, (0, 0))
        out[k] = q + (r[5] or 0), n + 1
    return out


def got(df):
    return {(r.user_id, r.metric, r.hour): (r.quantity, r.events) for r in df.collect()}


@pytest.fixture
def batches():
    first = events(120, 1)
    second = [*events(200, 2)[120:], *first[:40], *[(*r[:2], 1, "c", r[4], r[5] + 5) for r in first[:20]], (None, NOW, 0, "a", KINDS[0], 7), (None, NOW, 0, "a", KINDS[0], 7), (5, None, 0, "a", KINDS[0], 7), (6, NOW, None, "a", KINDS[0], None)]
    third = [*[(*r[:2], 0, *r[3:]) for r in first[:20]], *[(*r[:2], 2, r[3], KINDS[1], 1) for r in first[5:9]], *second[80:100]]
    return [first, second, third]


def test_batches_with_repeats_and_corrections(spark, tmp_path, batches, monkeypatch):
    path, frame = str(tmp_path / "usage"), lambda rows: spark.createDataFrame(rows, rollups.EVENTS)
    seen = []
    for number, rows in enumerate(batches):
        if number == 1:
            hourly = rollups.hourly
            monkeypatch.setattr(rollups, "hourly", lambda _: (_ for _ in ()).throw(RuntimeError("killed")))
            with pytest.raises(RuntimeError, match="killed"):
                rollups.take_in(frame(rows), path, number)
            assert got(rollups.read(spark, path)) == sums(seen)
            monkeypatch.setattr(rollups, "hourly", hourly)
        seen += rows
        for _ in range(2):
            rollups.take_in(frame(rows), path, number)
        assert got(rollups.read(spark, path)) == sums(seen)
        if number == 1:
            rollups.compact(spark, path)
            assert got(rollups.read(spark, path)) == sums(seen)
    month = rollups.read(spark, path, NOW)
    assert got(month) == {k: v for k, v in sums(seen).items() if k[2].strftime("%Y-%m") == "2024-01"}
    last = {r[:2]: max((x for x in seen if x[:2] == r[:2]), key=lambda x: (x[2] or 0, x[3:5], x[5] or 0)) for r in seen if r[0] is not None and r[1]}
    flat = frame([*last.values(), *[r for r in seen if r[0] is None]])
    assert sorted(map(tuple, rollups.month_totals(month, NOW).collect())) == sorted(map(tuple, billing.usage_totals(flat, NOW, half_open=True).collect()))


def test_as_a_stream(spark, tmp_path, batches):
    source, path = tmp_path / "in", str(tmp_path / "usage")
    for number, rows in enumerate(batches):
        spark.createDataFrame(rows, rollups.EVENTS).coalesce(1).write.mode("append").parquet(str(source))
        q = continuous.each_batch(spark.readStream.schema(rollups.EVENTS).parquet(str(source)), rollups.sink(path), str(tmp_path / "check"))
        assert q.awaitTermination(100)
        assert got(rollups.read(spark, path)) == sums([r for b in batches[: number + 1] for r in b])


def test_nothing(spark, tmp_path):
    none = spark.createDataFrame([], rollups.EVENTS)
    path = str(tmp_path / "usage")
    assert rollups.read(spark, path).isEmpty()
    rollups.take_in(none, path, 0)
    rollups.compact(spark, path)
    assert rollups.read(spark, path, NOW).isEmpty() and rollups.merged(rollups.read(spark, path), rollups.hourly(rollups.counted(none.drop("revision"), spark.createDataFrame([], rollups.LEDGER)))).isEmpty()
    extra = spark.createDataFrame([(1, NOW, "a", "m", 2, "x")], "id bigint, occurred_at timestamp_ntz, user_id string, metric string, quantity bigint, old string").withColumn("fresh", F.lit("y"))
    assert [tuple(r) for r in rollups.hourly(rollups.counted(extra, spark.createDataFrame([], rollups.LEDGER))).collect()] == [("a", "m", NOW, 2, 1)]
