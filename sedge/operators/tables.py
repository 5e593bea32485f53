"""Changes of tables as new snapshots: upserts, deletes and replacements."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.operators.billing import latest_subscription


def replace_by_key(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` in place of all rows of its keys; run twice, the same."""
    return old.join(new.select(key).distinct(), key, "left_anti").select(*old.columns).unionByName(new.select(*old.columns))


def latest(log: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The last row of each key of an append-only log."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c).desc() for c in order])
    return log.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def insert_new(stored: DataFrame, arriving: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The rows of ``arriving`` whose key isn't stored, the first of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return arriving.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n").join(stored.select(*keys), keys, "left_anti").select(*arriving.columns)


def numbered(rows: DataFrame, keys: list[str], parts: int = 64) -> DataFrame:
    """``rows``, unique by ``keys``, with ``_n``: 1, 2, ... in the order of the keys.

    Ranges of keys are numbered side by side, each from the count of those before it.
    The bounds of the ranges come from the ``parts`` * 16 keys with the least hashes.
    """
    least = rows.select(*keys).orderBy(F.xxhash64(*keys), *keys).limit(parts * 16).collect()
    place = F.struct(*keys)
    sample = sorted(least, key=lambda r: [(v is not None, v) for v in r])[16::16]
    bounds = [F.struct(*[F.lit(v).cast(rows.schema[k].dataType).alias(k) for k, v in zip(keys, r, strict=True)]) for r in sample]
    part = F.size(F.filter(F.array(*bounds), lambda b: b <= place)) if bounds else F.lit(0)
    dealt = rows.withColumn("_part", part)
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # one row for each range
    offsets = dealt.groupBy("_part").count().select("_part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*keys))
    return dealt.withColumn("_n", within).join(F.broadcast(offsets), "_part").withColumn("_n", F.col("_n") + F.col("_before")).drop("_part", "_before")


def upsert_subscriptions(old: DataFrame, changes: DataFrame, now) -> DataFrame:
    """``old`` with ``changes`` put into the latest row of (user_id, gateway), or added.

    The last change of a batch (by ``seq``) counts. Null fields keep what was there,
    but cancel_at_period_end is false if it isn't said.
    """
    keys = ["user_id", "gateway"]
    last = latest(changes, keys, ["seq"])
    fields = ["plan_code", "status", "provider_subscription_id", "current_period_start", "current_period_end"]
    new = last.select(*keys, *[F.col(c).alias(f"_{c}") for c in fields], F.coalesce("cancel_at_period_end", F.lit(False)).alias("_cancel"))
    target = latest_subscription(old, keys).select("id", *keys).join(new, keys)
    hit = F.col("_cancel").isNotNull()
    updated = old.join(target.drop(*keys), "id", "left").withColumns({c: F.coalesce(f"_{c}", c) for c in fields} | {"cancel_at_period_end": F.when(hit, F.col("_cancel")).otherwise(F.col("cancel_at_period_end")), "updated_at": F.when(hit, now).otherwise(F.col("updated_at"))}).select(*old.columns)
    missing = new.join(old.select(*keys).distinct(), keys, "left_anti")
    # ids go on from the largest and keep their type: one that it can't hold is an error
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    added = numbered(missing, keys).crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_n")).cast(old.schema["id"].dataType).alias("id"), *keys, *[F.col(f"_{c}").alias(c) for c in fields], F.col("_cancel").alias("cancel_at_period_end"), now.alias("created_at"), now.alias("updated_at"))
    return updated.unionByName(added.withColumns({"status": F.coalesce("status", F.lit("inactive"))}).select(*old.columns))


def upsert_customers(old: DataFrame, changes: DataFrame, now) -> DataFrame:
    """``old`` with a customer for each of ``changes`` (user_id, gateway,
    gateway_customer_id or null), which keeps what is known."""
    new = changes.groupBy("user_id").agg(F.max("gateway_customer_id").alias("_id"), F.max("gateway").alias("_gateway"))
    merged = old.join(new, "user_id", "left").withColumns({"gateway_customer_id": F.coalesce("_id", "gateway_customer_id"), "default_gateway": F.coalesce(F.when(F.col("_id").isNotNull(), F.col("_gateway")), "default_gateway"), "updated_at": F.when(F.col("_id").isNotNull(), now).otherwise(F.col("updated_at"))}).select(*old.columns)
    missing = new.join(old.select("user_id"), "user_id", "left_anti")
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("_top"))
    added = numbered(missing, ["user_id"]).crossJoin(F.broadcast(top)).select((F.col("_top") + F.col("_n")).cast(old.schema["id"].dataType).alias("id"), "user_id", F.col("_id").alias("gateway_customer_id"), F.col("_gateway").alias("default_gateway"), F.lit(None).cast("string").alias("billing_country"), F.lit("INR").alias("currency"), now.alias("created_at"), now.alias("updated_at"))
    return merged.unionByName(added)


def delete_owned(table: DataFrame, wanted: DataFrame) -> DataFrame:
    """``table`` without the rows of ``wanted`` (id, user_id), owner included: with a
    whole list of them, a clear-all."""
    return table.join(wanted.select("id", "user_id"), ["id", "user_id"], "left_anti").select(*table.columns)


def cascade(children: DataFrame, parents: DataFrame, key: str) -> DataFrame:
    """``children`` whose parent is still there."""
    return children.join(parents.select(F.col("id").alias(key)), key, "left_semi").select(*children.columns)


def orphans(parents: DataFrame, children: DataFrame, key: str) -> DataFrame:
    return parents.join(children.select(F.col(key).alias("id")).distinct(), "id", "left_anti")


def change_dimensions(chunks: DataFrame, files: DataFrame, dimensions: int) -> tuple[DataFrame, DataFrame]:
    """Chunks of the new length only, and files that still have one."""
    kept = chunks.filter(F.size("embeddings") == dimensions)
    return kept, files.join(kept.select(F.col("file_id").alias("id")).distinct(), "id", "left_semi").select(*files.columns)
