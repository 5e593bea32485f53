"""Notices to subscriptions as a stream that is killed and started again."""

import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from sedge import schema
from sedge.operators import notices
from sedge.sources import versions
from sedge.streaming import continuous


def body(event, at, user, sub):
    entity = {"id": sub, "plan_id": "p1", "status": "active", "notes": {"userId": user}, "current_start": 1, "current_end": 2}
    return json.dumps({"event": event, "created_at": at, "payload": {"subscription": {"entity": entity}}})


def test_killed_between_its_two_writes(spark, tmp_path, monkeypatch):
    now = F.lit(datetime(2024, 2, 10, 12)).cast("timestamp_ntz")
    prices = schema.price_ids(spark, {("pro", notices.GATEWAY, "INR"): "p1"})
    source, events, subs = tmp_path / "in", str(tmp_path / "events"), str(tmp_path / "subs")
    source.mkdir()
    said = []

    def tell(n, *rows):
        said.extend(rows)
        (source / f"{n}.json").write_text("\n".join(json.dumps({"seq": s, "ts": "2024-02-10T12:00:00Z", "body": b}) for s, b in rows))

    def run():
        sink = continuous.subscription_sink(spark, events, subs, prices, now, lifecycle=True)
        q = continuous.each_batch(continuous.notice_stream(spark, str(source)), sink, str(tmp_path / "check"))
        if not q.awaitTermination(100):
            q.stop()
            raise AssertionError("the stream didn't end")

    tell(1, (1, body("subscription.activated", 1, "u", "s1")), (2, body("subscription.activated", 1, "u", "s1")), (3, body("subscription.activated", 2, "v", "s2")))
    run()
    tell(2, (4, body("subscription.cancelled", 9, "u", "s1")), (5, body("subscription.activated", 2, "v", "s2")), (6, body("subscription.activated", 3, "w", "s3")), (7, "junk"))
    replace = versions.replace

    def broken(rows, path, **more):
        if path == events:
            raise RuntimeError("killed")
        return replace(rows, path, **more)

    monkeypatch.setattr(versions, "replace", broken)
    with pytest.raises(Exception, match="killed"):
        run()
    assert versions.tags(spark, subs) == {"notices": 1} and versions.tags(spark, events) == {"notices": 0}
    monkeypatch.setattr(versions, "replace", replace)
    run()
    assert versions.tags(spark, events) == {"notices": 1} and versions.latest(spark, subs) == 2
    # a batch that is replayed though all of it is there
    continuous.subscription_sink(spark, events, subs, prices, now, lifecycle=True)(spark.createDataFrame(said[3:], "seq bigint, body string"), 1)
    none = spark.createDataFrame([], "gateway string, event_id string")
    after = spark.createDataFrame([], schema.SUBSCRIPTIONS)
    known = none
    for part in (said[:3], said[3:]):
        new, after = notices.take_in(known, after, spark.createDataFrame(part, "seq bigint, body string"), prices, now, lifecycle=True)
        known = new if known is none else known.unionByName(new)
    names = ["id", "user_id", "gateway", "plan_code", "status", "provider_subscription_id"]
    got = versions.read(spark, subs)
    assert sorted(map(tuple, got.select(*names).collect())) == sorted(map(tuple, after.select(*names).collect())) and got.count() == 3
    assert sorted(r.event_id for r in versions.read(spark, events).collect()) == sorted(r.event_id for r in known.collect())
