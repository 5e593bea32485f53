"""Billing notices: read, told apart from repeats, and turned into subscriptions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge import schema
from sedge.functions import columns as C
from sedge.operators import tables
from sedge.operators.billing import plan_for_price

GATEWAY = "razorpay"


def read_notices(rows: DataFrame, body: str = "body", lifecycle: bool = False) -> DataFrame:
    """``rows`` with notice, gateway, event_id and event_type.

    The id is the subscription's, the payment's, or made of event and time. With
    ``lifecycle`` event and time are part of it, so that later notices of the same
    subscription aren't taken for repeats.
    """
    read = rows.withColumn("notice", F.from_json(body, schema.NOTICE)).filter("notice.event is not null")
    own = C.notice_id("notice")
    if lifecycle:
        own = F.concat_ws(":", own, F.col("notice.event"), F.col("notice.created_at").cast("string"))
    return read.withColumns({"gateway": F.lit(GATEWAY), "event_id": own, "event_type": F.col("notice.event")})


def subscription_changes(notices: DataFrame, prices: DataFrame, seq: str) -> DataFrame:
    """Changes for an upsert, of notices that name a user and a subscription or payment."""
    n, e = F.col("notice"), F.col("notice.payload.subscription.entity")
    rows = notices.filter(C.concerns_subscription("notice")).select(
        e["notes"]["userId"].alias("user_id"), "gateway", e["id"].alias("provider_subscription_id"), C.notice_status(n).alias("status"), C.from_epoch(e["current_start"]).alias("current_period_start"),
        C.from_epoch(e["current_end"]).alias("current_period_end"), F.coalesce(e["cancel_at_cycle_end"], F.lit(False)).alias("cancel_at_period_end"), e["plan_id"].alias("price_id"), F.col(seq).alias("seq"),
    )
    return plan_for_price(rows, prices).drop("price_id")


def take_in(stored_events: DataFrame, subscriptions: DataFrame, rows: DataFrame, prices: DataFrame, now, seq: str = "seq", lifecycle: bool = False) -> tuple[DataFrame, DataFrame]:
    """(new events, subscriptions after them). The first of equal ids counts; the same
    batch again changes nothing."""
    new = tables.insert_new(stored_events, read_notices(rows, lifecycle=lifecycle), ["gateway", "event_id"], [seq])
    events = new.select("gateway", "event_id", "event_type", F.col("body").alias("payload"), F.lit(True).alias("processed"), now.alias("processed_at"), now.alias("created_at"))
    return events, tables.upsert_subscriptions(subscriptions, subscription_changes(new, prices, seq), now)


def paid_subscriptions(payments: DataFrame, now) -> DataFrame:
    """Changes for verified payments (user_id, plan_code, seq): active for 30 days."""
    none = F.lit(None).cast("string")
    return payments.select("user_id", F.lit(GATEWAY).alias("gateway"), none.alias("provider_subscription_id"), F.lit("active").alias("status"), now.alias("current_period_start"), C.plus_days(now).alias("current_period_end"), F.lit(False).alias("cancel_at_period_end"), "plan_code", "seq")
