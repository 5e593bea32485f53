"""Schemas of the logical tables and nested payloads, and the plan dimension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

NOW = "timestamp_ntz"
FILES = f"id int, name string, type string, size int, user_id string, file_data string, extracted_text string, storage_key string, storage_url string, status string, processing_error string, text_bytes int, created_at {NOW}"
METADATA = "struct<chunkIndex: int, totalChunks: int, fileName: string, estimatedPage: int, totalPages: int, positionPercent: int, section: int, charOffset: int, charLength: int>"
CHUNKS = f"id int, file_id int, content string, metadata {METADATA}, embeddings array<float>"
CHATS = f"id string, title string, user_id string, created_at {NOW}, updated_at {NOW}"
PART = "struct<type: string, text: string, toolName: string, args: string, toolCallId: string>"
MESSAGES = f"id string, chat_id string, role string, content string, parts array<{PART}>, created_at {NOW}"
CUSTOMERS = f"id int, user_id string, gateway_customer_id string, default_gateway string, billing_country string, currency string, created_at {NOW}, updated_at {NOW}"
SUBSCRIPTIONS = f"id int, user_id string, plan_code string, gateway string, provider_subscription_id string, status string, current_period_start {NOW}, current_period_end {NOW}, cancel_at_period_end boolean, created_at {NOW}, updated_at {NOW}"
USAGE_EVENTS = f"id int, user_id string, metric string, quantity bigint, unit string, source_type string, source_id string, is_estimated boolean, occurred_at {NOW}, created_at {NOW}"
BILLING_CYCLES = f"id int, user_id string, period_start {NOW}, period_end {NOW}, included_inr double, consumed_inr double, overage_inr double, settled boolean, created_at {NOW}, updated_at {NOW}"
PAYMENT_EVENTS = f"id int, gateway string, event_id string, event_type string, payload string, processed boolean, processed_at {NOW}, created_at {NOW}"
JOBS = f"id int, file_id int, status string, attempts int, last_error string, next_retry_at {NOW}, started_at {NOW}, finished_at {NOW}, created_at {NOW}, updated_at {NOW}"
#: What a billing notice holds; fields that are missing read as null.
NOTICE = "struct<event: string, created_at: bigint, payload: struct<subscription: struct<entity: struct<id: string, plan_id: string, status: string, notes: struct<userId: string>, current_start: bigint, current_end: bigint, cancel_at_cycle_end: boolean>>, payment: struct<entity: struct<id: string>>>>"
UPLOAD_TOKEN = "struct<userId: string, fileName: string, fileSize: bigint, fileType: string, expiresAt: bigint>"
UPLOAD_REQUEST = "struct<fileName: string, fileSize: int, fileType: string>"
CHECKOUT_REQUEST = "struct<planCode: string, gateway: string, currency: string, successUrl: string, cancelUrl: string>"

# Plans (code, INR and USD a month, largest file in MB, storage in GB,
# input, output and embedding tokens, whether use beyond them is billed).
PLANS = [
    ("free", 0, 0, 25, 0.5, 1_000_000, 300_000, 1_000_000, False),
    ("pro", 99, 2, 25, 5.0, 5_000_000, 1_000_000, 5_000_000, True),
    ("team", 299, 4, 25, 25.0, 20_000_000, 5_000_000, 20_000_000, True),
]
PLAN_SCHEMA = "plan_code string, price_inr int, price_usd int, max_file_mb int, storage_gb double, input_tokens bigint, output_tokens bigint, embedding_tokens bigint, allow_overage boolean"
# INR for a thousand tokens, and for a GB and month.
RATES = {"input": "0.06", "output": "0.5", "embedding": "0.04", "storage": "20"}
CURRENCY = "INR"
#: Caps on an upload in MB: for all plans, inline storage, and the synchronous path.
ABSOLUTE_MB, INLINE_MB, SYNCHRONOUS_MB = 100, 25, 10
#: Metrics of usage events, and the unit of each.
METRICS = {"model_input_tokens": "tokens", "model_output_tokens": "tokens", "embedding_input_tokens": "tokens", "storage_gb_day": "milli_gb_day"}


def plans(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PLANS, PLAN_SCHEMA)


def price_ids(spark: SparkSession, ids: dict[tuple[str, str, str], str]) -> DataFrame:
    """(plan_code, gateway, currency, price_id); ids come from the deployment."""
    return spark.createDataFrame([(*k, v) for k, v in ids.items() if v], "plan_code string, gateway string, currency string, price_id string")
