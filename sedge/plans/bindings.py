"""The logical tables as views of the driver's tables."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The moment that queries take for now: within the events' month.
NOW = datetime(2024, 1, 20, 12, 0)


class Tables:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    def files(self) -> DataFrame:
        d = self.raw("documents")
        return d.select(F.col("doc_id").alias("id"), F.concat(F.lit("doc-"), F.col("doc_id").cast("string"), F.lit(".txt")).alias("name"), F.lit("text/plain").alias("type"), F.col("n_chars").alias("size"), F.col("source").alias("user_id"), "text", "lang")

    def chunks(self) -> DataFrame:
        return self.raw("embeddings").select(F.col("vec_id").alias("id"), F.col("vec_id").alias("file_id"), F.concat(F.lit("u"), (F.col("label") % 3).cast("string")).alias("user_id"), F.concat(F.lit("chunk "), F.col("vec_id").cast("string")).alias("content"), F.col("embedding").alias("embeddings"), "label")

    def search_queries(self) -> DataFrame:
        """Every row whose id is divisible by 20 asks within its own tenant."""
        return self.chunks().filter(F.col("id") % 20 == 0).select(F.col("id").alias("query_id"), "user_id", F.col("embeddings").alias("vector"))

    def usage(self) -> DataFrame:
        kinds = {"view": "model_input_tokens", "click": "model_output_tokens", "purchase": "embedding_input_tokens", "signup": "storage_gb_day"}
        metric = F.coalesce(*[F.when(F.col("event_type") == k, F.lit(v)) for k, v in kinds.items()], F.lit("unknown"))
        return self.raw("events").select(F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("user_id"), metric.alias("metric"), F.floor(F.col("value") * 20000 + 0.5).cast("bigint").alias("quantity"), F.col("ts").alias("occurred_at"))

    def subscriptions(self) -> DataFrame:
        plan = F.when(F.col("o_orderpriority").startswith("1"), "team").when(F.col("o_orderpriority").startswith("2"), "pro").when(F.col("o_orderpriority").startswith("3"), "free").otherwise("legacy")
        status = F.when(F.col("o_orderstatus") == "O", "active").when(F.col("o_orderstatus") == "F", "canceled").otherwise("past_due")
        gateway = F.when(F.col("o_orderkey") % 2 == 0, "razorpay").otherwise("other")
        return self.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("user_id"), plan.alias("plan_code"), gateway.alias("gateway"), status.alias("status"), F.col("o_orderdate").alias("updated_at"))

    def jobs(self) -> DataFrame:
        status = F.when(F.col("o_orderstatus") == "O", "queued").when(F.col("o_orderstatus") == "F", "failed").otherwise("processing")
        retry = F.when(F.col("o_orderkey") % 3 == 0, F.timestamp_add("DAY", (F.col("o_orderkey") % 10).cast("int"), "o_orderdate"))
        none = F.lit(None).cast("timestamp_ntz")
        return self.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("file_id"), status.alias("status"), (F.col("o_orderkey") % 6).cast("int").alias("attempts"), F.lit(None).cast("string").alias("last_error"), retry.alias("next_retry_at"), F.col("o_orderdate").alias("started_at"), none.alias("finished_at"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))

    def messages(self) -> DataFrame:
        return self.raw("conversations").select(F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.col("conv_id").cast("string").alias("chat_id"), "role", F.col("text").alias("content"), "turn")
