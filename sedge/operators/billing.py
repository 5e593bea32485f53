"""Usage, plans, rating and gates for all users at once."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge import schema
from sedge.functions import columns as C


def usage_event(rows: DataFrame, user, metric: str, quantity, source_type: str, source_id, estimated: bool, now) -> DataFrame:
    """Events for an append to the usage log."""
    return rows.select(
        user.alias("user_id"), F.lit(metric).alias("metric"), C.quantity(quantity).alias("quantity"), F.lit(schema.METRICS.get(metric, "units")).alias("unit"),
        F.lit(source_type).alias("source_type"), source_id.cast("string").alias("source_id"), F.lit(estimated).alias("is_estimated"), now.alias("occurred_at"), now.alias("created_at"),
    )


def usage_totals(events: DataFrame, now: datetime, half_open: bool = False) -> DataFrame:
    """user_id and the sum of each metric in the month of ``now``; other metrics don't
    count. Storage in GB-days. The bounds are literals, so they reach the scan."""
    start, end = C.cycle_bounds(now)
    at = F.col("occurred_at")
    inside = at.between(F.lit(start).cast("timestamp_ntz"), F.lit(end).cast("timestamp_ntz"))
    if half_open:
        inside = (at >= F.lit(start).cast("timestamp_ntz")) & (at < C.cycle_end(F.lit(now).cast("timestamp_ntz")) + F.expr("INTERVAL '0.001' SECOND"))
    total = lambda m: F.coalesce(F.sum(F.when(F.col("metric") == m, F.col("quantity"))), F.lit(0)).cast("bigint")
    return events.filter(inside & F.col("metric").isin(*schema.METRICS)).groupBy("user_id").agg(
        total("model_input_tokens").alias("used_input"), total("model_output_tokens").alias("used_output"), total("embedding_input_tokens").alias("used_embedding"), total("storage_gb_day").alias("used_storage"),
    )


def latest_subscription(subscriptions: DataFrame, keys: list[str], active_only: bool = False) -> DataFrame:
    """The row of each key that was changed last, ties by the larger id."""
    rows = subscriptions.filter(F.col("status") == "active") if active_only else subscriptions
    order = Window.partitionBy(*keys).orderBy(F.col("updated_at").desc(), F.col("id").desc())
    return rows.withColumn("_n", F.row_number().over(order)).filter("_n = 1").drop("_n")


def current_plan(subscriptions: DataFrame) -> DataFrame:
    """user_id, plan_code: of the latest active row; an unknown code means free."""
    best = subscriptions.filter(F.col("status") == "active").groupBy("user_id").agg(F.max_by("plan_code", F.struct("updated_at", "id")).alias("code"))
    return best.select("user_id", F.when(F.col("code").isin([p[0] for p in schema.PLANS]), F.col("code")).otherwise("free").alias("plan_code"))


def usage_summary(events: DataFrame, subscriptions: DataFrame, users: DataFrame, now: datetime) -> DataFrame:
    """For each of ``users`` (user_id): plan, limits, usage, projected overage and
    whether further use is blocked."""
    spark = events.sparkSession
    rows = users.select("user_id").distinct().join(usage_totals(events, now), "user_id", "left").join(current_plan(subscriptions), "user_id", "left")
    rows = rows.fillna(0, ["used_input", "used_output", "used_embedding", "used_storage"]).withColumn("plan_code", F.coalesce("plan_code", F.lit("free")))
    rated = rows.join(F.broadcast(schema.plans(spark)), "plan_code")  # three rows
    over = C.overage_inr("used_input", "used_output", "used_embedding", "used_storage")
    start, end = C.cycle_bounds(now)
    return rated.select(
        "user_id", "plan_code", F.lit(start).cast("timestamp_ntz").alias("period_start"), F.lit(end).cast("timestamp_ntz").alias("period_end"),
        "used_input", "used_output", "used_embedding", "used_storage", "input_tokens", "output_tokens", "embedding_tokens", "storage_gb", "allow_overage", over.alias("overage_inr"),
    ).withColumn("is_blocked", ~F.col("allow_overage") & (F.col("overage_inr") > 0))


def plan_for_price(rows: DataFrame, prices: DataFrame, column: str = "price_id") -> DataFrame:
    """``rows`` with plan_code: what the provider's id stands for, else free."""
    return rows.join(prices.select(F.col("price_id").alias(column), "plan_code").dropDuplicates([column]), column, "left").withColumn("plan_code", F.coalesce("plan_code", F.lit("free")))


def upload_limits(users: DataFrame, subscriptions: DataFrame) -> DataFrame:
    """user_id, plan_code, max_mb, max_bytes."""
    rows = users.select("user_id").distinct().join(current_plan(subscriptions), "user_id", "left").withColumn("plan_code", F.coalesce("plan_code", F.lit("free")))
    limit = C.upload_cap_bytes("max_file_mb")
    return rows.join(F.broadcast(schema.plans(users.sparkSession)), "plan_code").select("user_id", "plan_code", F.least("max_file_mb", F.lit(schema.ABSOLUTE_MB)).alias("max_mb"), limit.alias("max_bytes"))


def upload_decisions(requests: DataFrame, limits: DataFrame, summary: DataFrame) -> DataFrame:
    """``requests`` (user_id, file_name, file_size, file_type) with status and reason:
    402 over quota, 413 too large, 400 not valid, else 200."""
    rows = requests.join(limits.select("user_id", "max_bytes"), "user_id", "left").join(summary.select("user_id", "is_blocked"), "user_id", "left")
    valid = (F.coalesce(F.length("file_name"), F.lit(0)) > 0) & (F.coalesce("file_size", F.lit(0)) > 0) & (F.coalesce(F.length("file_type"), F.lit(0)) > 0)
    status = F.when(F.coalesce("is_blocked", F.lit(False)), 402).when(~valid, 400).when(F.col("file_size") > F.coalesce("max_bytes", F.lit(schema.PLANS[0][3] * 1048576)), 413).otherwise(200)
    reason = F.when(status == 402, "quota").when(status == 400, "invalid").when(status == 413, "too large")
    return rows.withColumn("status", status).withColumn("reason", reason).drop("is_blocked", "max_bytes")
