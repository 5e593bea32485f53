"""One query for each operator over the driver's tables, with equivalent SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge import schema
from sedge.functions import arrow as A
from sedge.functions import columns as C
from sedge.operators import billing, cells, chunking, context, costs, embedding, jobs, reports, rollups, search, tables
from sedge.plans.bindings import NOW, Tables
from sedge.sources import blobs, extract, pdf, sinks
from sedge.streaming import queue

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Callable[[Tables], DataFrame]):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def now():
    return F.lit(NOW).cast("timestamp_ntz")


_CHUNKS = "(SELECT vec_id AS id, 'u' || (label % 3)::VARCHAR AS user_id, label, embedding::DOUBLE[] AS v FROM embeddings)"
_HITS = f"""(SELECT q.id AS query_id, c.id, list_cosine_similarity(q.v, c.v) AS similarity FROM {_CHUNKS} q JOIN {_CHUNKS} c ON q.user_id = c.user_id WHERE q.id % 20 = 0)"""
_TOP = f"""(SELECT query_id, id, similarity, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM {_HITS} WHERE similarity > 0.3)"""
_TOP_SQL = f"SELECT query_id, id, round(similarity, 6) AS similarity, rank::INTEGER AS rank FROM {_TOP} WHERE rank <= 10"
_USAGE = """(SELECT event_id AS id, user_id::VARCHAR AS user_id, CASE event_type WHEN 'view' THEN 'model_input_tokens' WHEN 'click' THEN 'model_output_tokens' WHEN 'purchase' THEN 'embedding_input_tokens' WHEN 'signup' THEN 'storage_gb_day' ELSE 'unknown' END AS metric,
 floor(value * 20000 + 0.5)::BIGINT AS quantity, ts AS occurred_at FROM events)"""
_SUBS = """(SELECT o_orderkey AS id, o_custkey::VARCHAR AS user_id, CASE o_orderpriority[1] WHEN '1' THEN 'team' WHEN '2' THEN 'pro' WHEN '3' THEN 'free' ELSE 'legacy' END AS plan_code,
 CASE WHEN o_orderkey % 2 = 0 THEN 'razorpay' ELSE 'other' END AS gateway, CASE o_orderstatus WHEN 'O' THEN 'active' WHEN 'F' THEN 'canceled' ELSE 'past_due' END AS status, o_orderdate AS updated_at FROM orders)"""
_PLAN = f"""(SELECT user_id, CASE WHEN code IN ('free', 'pro', 'team') THEN code ELSE 'free' END AS plan_code FROM (SELECT user_id, plan_code AS code, row_number() OVER (PARTITION BY user_id ORDER BY updated_at DESC, id DESC) AS n FROM {_SUBS} WHERE status = 'active') WHERE n = 1)"""
_PLANS = "(VALUES ('free', 25, 0.5, 1000000, 300000, 1000000, false), ('pro', 25, 5.0, 5000000, 1000000, 5000000, true), ('team', 25, 25.0, 20000000, 5000000, 20000000, true)) AS p(plan_code, max_file_mb, storage_gb, lim_in, lim_out, lim_emb, allow_overage)"
_TOTALS = f"""(SELECT user_id, coalesce(sum(quantity) FILTER (metric = 'model_input_tokens'), 0)::BIGINT AS used_input, coalesce(sum(quantity) FILTER (metric = 'model_output_tokens'), 0)::BIGINT AS used_output,
 coalesce(sum(quantity) FILTER (metric = 'embedding_input_tokens'), 0)::BIGINT AS used_embedding, coalesce(sum(quantity) FILTER (metric = 'storage_gb_day'), 0)::BIGINT AS used_storage
 FROM {_USAGE} WHERE metric <> 'unknown' AND occurred_at BETWEEN TIMESTAMP '2024-01-01' AND TIMESTAMP '2024-01-31 23:59:59.999' GROUP BY user_id)"""
_SUMMARY = f"""(SELECT u.user_id, p.plan_code, coalesce(used_input, 0) AS used_input, coalesce(used_output, 0) AS used_output, coalesce(used_embedding, 0) AS used_embedding, coalesce(used_storage, 0) AS used_storage, allow_overage,
 round(greatest(coalesce(used_input, 0) - lim_in, 0)::DECIMAL(20,0) * 0.00006 + greatest(coalesce(used_output, 0) - lim_out, 0)::DECIMAL(20,0) * 0.0005 + greatest(coalesce(used_embedding, 0) - lim_emb, 0)::DECIMAL(20,0) * 0.00004
  + (greatest(coalesce(used_storage, 0) * 10 - (storage_gb * 300000)::BIGINT, 0)::DECIMAL(20,0) * 20 / 300000)::DECIMAL(30,12), 2)::DOUBLE AS overage_inr
 FROM (SELECT DISTINCT user_id::VARCHAR AS user_id FROM events) u LEFT JOIN {_TOTALS} t USING (user_id) LEFT JOIN {_PLAN} s USING (user_id) JOIN {_PLANS} ON p.plan_code = coalesce(s.plan_code, 'free'))"""
_JOBS = """(SELECT o_orderkey AS id, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'F' THEN 'failed' ELSE 'processing' END AS status, (o_orderkey % 6)::INTEGER AS attempts, CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate + to_days((o_orderkey % 10)::INTEGER) END AS next_retry_at, o_orderdate AS created_at FROM orders)"""


# search
def _rounded(df: DataFrame) -> DataFrame:
    return df.select("query_id", "id", F.round("similarity", 6).alias("similarity"), "rank")


@query(_TOP_SQL)
def search_many(t: Tables) -> DataFrame:
    return _rounded(search.search_many(t.search_queries(), t.chunks()))


@query(_TOP_SQL)
def search_joined(t: Tables) -> DataFrame:
    return _rounded(search.search_joined(t.search_queries(), t.chunks()))


@query(_TOP_SQL)
def search_pruned(t: Tables) -> DataFrame:
    return _rounded(cells.search(t.search_queries(), cells.build(t.chunks())))


@query(f"SELECT id, round(similarity, 6) AS similarity FROM (SELECT c.id, list_cosine_similarity(q.v, c.v) AS similarity FROM {_CHUNKS} q, {_CHUNKS} c WHERE q.id = 0 AND c.user_id = q.user_id) WHERE similarity > 0.3 ORDER BY similarity DESC, id LIMIT 10")
def search_one(t: Tables) -> DataFrame:
    first = t.chunks().filter("id = 0").first()
    files = t.chunks().select("id", F.lit("f").alias("name"), F.lit("t").alias("type"), "user_id")
    hits = search.search(list(first["embeddings"]), t.chunks().withColumn("metadata", F.lit(None).cast(schema.METADATA)), files, first["user_id"])
    return hits.select("id", F.round("similarity", 6).alias("similarity"))


@query(f"""SELECT q.id AS query_id, coalesce(string_agg('[Citation ' || rank || '] Source: [f' || h.id || '](/files/' || h.id || ') | Chunk ' || (h.id + 1) || '/?' || chr(10) || 'Content: chunk ' || h.id, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY rank), '{C.NOTHING_FOUND}') AS context, count(h.id)::INTEGER AS n_hits
 FROM (SELECT id FROM {_CHUNKS} WHERE id % 20 = 0) q LEFT JOIN (SELECT * FROM {_TOP} WHERE rank <= 10) h ON h.query_id = q.id GROUP BY q.id""")
def citation_contexts(t: Tables) -> DataFrame:
    return context.build_context(t.search_queries(), _cited(t))


def _cited(t: Tables) -> DataFrame:
    own = t.chunks().select("id", "content", F.from_json(F.concat(F.lit('{"chunkIndex":'), F.col("id").cast("string"), F.lit("}")), schema.METADATA).alias("metadata"), F.struct("id", F.concat(F.lit("f"), F.col("id").cast("string")).alias("name"), F.lit("t").alias("type")).alias("file"))
    return search.search_many(t.search_queries(), t.chunks()).join(own, "id")


@query(f"SELECT query_id, (rank - 1)::INTEGER AS position, '[Citation ' || rank || '] Source: [f' || id || '](/files/' || id || ') | Chunk ' || (id + 1) || '/?' AS source, 'chunk ' || id AS content FROM {_TOP} WHERE rank <= 10")
def parsed_contexts(t: Tables) -> DataFrame:
    return context.parse_context(context.build_context(t.search_queries(), _cited(t))).select("query_id", "position", "source", "content")


# usage and plans
@query("""WITH p AS (SELECT 'm' || o_custkey % 5 AS model, date_trunc('month', o_orderdate) AS valid_from, max((o_totalprice::DECIMAL(18,2), (o_totalprice * 2)::DECIMAL(18,2))) AS own FROM orders GROUP BY 1, 2),
 u AS (SELECT 'm' || l_suppkey % 5 AS model, l_shipdate AS told, l_quantity::BIGINT AS input_tokens, l_linenumber::BIGINT AS output_tokens FROM lineitem)
 SELECT u.model, year(told)::INTEGER AS year, count(*) FILTER (own IS NULL) AS unpriced, round(sum(input_tokens::DECIMAL(18,0) * own[1]::DECIMAL(18,6) + output_tokens::DECIMAL(18,0) * own[2]::DECIMAL(18,6))::DECIMAL(28,6) * 0.000001::DECIMAL(7,6), 4)::DOUBLE AS cost_usd FROM u ASOF LEFT JOIN p ON u.model = p.model AND told >= valid_from GROUP BY 1, 2""")
def context_costs(t: Tables) -> DataFrame:
    model = lambda c: F.concat(F.lit("m"), (F.col(c) % 5).cast("string"))
    money = lambda c: c.cast("decimal(18,2)").cast("decimal(18,6)")
    prices = t.raw("orders").select(model("o_custkey").alias("model"), F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("valid_from"), money(F.col("o_totalprice")).alias("input_usd"), money(F.col("o_totalprice") * 2).alias("output_usd"))
    usage = t.raw("lineitem").select(model("l_suppkey").alias("model"), F.col("l_shipdate").cast("timestamp_ntz").alias("at"), F.col("l_quantity").cast("bigint").alias("input_tokens"), F.col("l_linenumber").cast("bigint").alias("output_tokens"))
    priced = costs.context_costs(usage, prices)
    return priced.groupBy("model", F.year("at").alias("year")).agg(F.count_if(F.col("cost_usd").isNull()).alias("unpriced"), F.round(F.sum("cost_usd"), 4).cast("double").alias("cost_usd"))


@query(f"SELECT * FROM {_TOTALS}")
def usage_totals(t: Tables) -> DataFrame:
    return billing.usage_totals(t.usage(), NOW)


@query(f"""SELECT user_id, metric, date_trunc('hour', occurred_at) AS hour, sum(quantity + CASE WHEN id % 21 = 0 THEN 5 ELSE 0 END)::BIGINT AS quantity, count(*) AS events FROM {_USAGE} GROUP BY 1, 2, 3""")
def rolled_usage(t: Tables) -> DataFrame:
    """Two batches; the second repeats the first, and a seventh of that is corrected."""
    usage, third = t.usage().withColumn("revision", F.lit(0)), F.col("id") % 3 == 0
    early = rollups.counted(usage.filter(third), t.spark.createDataFrame([], rollups.LEDGER))
    fixed = F.col("id") % 21 == 0
    late = usage.withColumns({"quantity": F.col("quantity") + F.when(fixed, 5).otherwise(0), "revision": F.when(fixed, 1).otherwise(0)})
    return rollups.merged(rollups.hourly(early), rollups.hourly(rollups.counted(late, early)))


@query(f"SELECT * FROM {_PLAN}")
def current_plans(t: Tables) -> DataFrame:
    return billing.current_plan(t.subscriptions())


@query(f"SELECT user_id, gateway, id, plan_code, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id, gateway ORDER BY updated_at DESC, id DESC) AS n FROM {_SUBS}) WHERE n = 1")
def latest_subscriptions(t: Tables) -> DataFrame:
    return billing.latest_subscription(t.subscriptions(), ["user_id", "gateway"]).select("user_id", "gateway", "id", "plan_code", "status")


@query(f"SELECT user_id, plan_code, used_input, used_output, used_embedding, used_storage, overage_inr, NOT allow_overage AND overage_inr > 0 AS is_blocked FROM {_SUMMARY}")
def usage_summaries(t: Tables) -> DataFrame:
    s = billing.usage_summary(t.usage(), t.subscriptions(), t.usage(), NOW)
    return s.select("user_id", "plan_code", "used_input", "used_output", "used_embedding", "used_storage", F.col("overage_inr").cast("double").alias("overage_inr"), "is_blocked")


@query(f"SELECT u.user_id, coalesce(s.plan_code, 'free') AS plan_code, 25 AS max_mb, 26214400::BIGINT AS max_bytes FROM (SELECT DISTINCT c_custkey::VARCHAR AS user_id FROM customer) u LEFT JOIN {_PLAN} s USING (user_id)")
def upload_limits(t: Tables) -> DataFrame:
    return billing.upload_limits(t.raw("customer").select(F.col("c_custkey").cast("string").alias("user_id")), t.subscriptions())


@query(f"""SELECT l_orderkey AS order_id, l_linenumber AS line, status, CASE status WHEN 402 THEN 'quota' WHEN 400 THEN 'invalid' WHEN 413 THEN 'too large' END AS reason FROM (SELECT l_orderkey, l_linenumber, CASE WHEN coalesce(NOT allow_overage AND overage_inr > 0, false) THEN 402 WHEN l_discount = 0 THEN 400 WHEN floor(l_extendedprice * 1000) > 26214400 THEN 413 ELSE 200 END AS status
 FROM lineitem LEFT JOIN {_SUMMARY} s ON s.user_id = (l_partkey)::VARCHAR)""")
def upload_decisions(t: Tables) -> DataFrame:
    rows = t.raw("lineitem").select(F.col("l_orderkey").alias("order_id"), F.col("l_linenumber").alias("line"), F.col("l_partkey").cast("string").alias("user_id"), F.when(F.col("l_discount") == 0, "").otherwise("f").alias("file_name"), F.floor(F.col("l_extendedprice") * 1000).alias("file_size"), F.lit("t").alias("file_type"))
    limits = billing.upload_limits(rows, t.subscriptions())
    summary = billing.usage_summary(t.usage(), t.subscriptions(), t.usage(), NOW)
    return billing.upload_decisions(rows, limits, summary).select("order_id", "line", "status", "reason")


@query("SELECT o_orderkey AS id, CASE o_orderpriority WHEN '1-URGENT' THEN 'pro' WHEN '2-HIGH' THEN 'team' ELSE 'free' END AS plan_code FROM orders")
def plans_for_prices(t: Tables) -> DataFrame:
    prices = schema.price_ids(t.spark, {("pro", "razorpay", "INR"): "1-URGENT", ("team", "razorpay", "INR"): "2-HIGH"})
    return billing.plan_for_price(t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderpriority").alias("price_id")), prices).select("id", "plan_code")


# the queue
@query(f"SELECT id, attempts FROM {_JOBS} WHERE status = 'queued' AND (next_retry_at IS NULL OR next_retry_at <= TIMESTAMP '2024-01-20 12:00:00') ORDER BY created_at, id LIMIT 20")
def due_jobs(t: Tables) -> DataFrame:
    return jobs.due_jobs(t.jobs(), now(), limit=50).select("id", "attempts")


@query(f"""SELECT id, attempts + 1 AS attempts, CASE WHEN attempts + 1 < 5 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN attempts + 1 < 5 THEN TIMESTAMP '2024-01-20 12:00:00' + to_minutes(least(60, pow(2, attempts + 1))::BIGINT) END AS next_retry_at,
 CASE WHEN attempts + 1 >= 5 THEN TIMESTAMP '2024-01-20 12:00:00' END AS finished_at FROM {_JOBS} WHERE status = 'queued'""")
def failed_jobs(t: Tables) -> DataFrame:
    return jobs.fail(jobs.claim(t.jobs().filter("status = 'queued'"), now()), F.lit("error"), now()).select("id", "attempts", "status", "next_retry_at", "finished_at")


@query(f"SELECT id, CASE WHEN id % 4 <> 0 THEN 'completed' WHEN attempts + 1 < 5 THEN 'queued' ELSE 'failed' END AS status, CASE WHEN id % 4 = 0 THEN 'bad' END AS last_error FROM {_JOBS} WHERE status = 'queued'")
def settled_jobs(t: Tables) -> DataFrame:
    claimed = jobs.claim(t.jobs().filter("status = 'queued'"), now())
    return jobs.settle(claimed, claimed.select("id", F.when(F.col("id") % 4 == 0, "bad").alias("error")), now()).select("id", "status", "last_error")


# events and tables
@query("SELECT min(event_id) AS event_id, user_id, event_type FROM events e WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = e.user_id AND o_orderstatus = 'P' AND e.event_type = 'click') GROUP BY user_id, event_type")
def new_payment_events(t: Tables) -> DataFrame:
    known = t.raw("orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("user_id"), F.lit("click").alias("event_type")).distinct()
    return tables.insert_new(known, t.raw("events").select("event_id", "user_id", "event_type"), ["user_id", "event_type"], ["event_id"])


@query("""WITH c AS (SELECT user_id::VARCHAR AS user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS n FROM events WHERE event_type IN ('purchase', 'error')), l AS (SELECT * FROM c WHERE n = 1),
 s AS (SELECT o_orderkey AS id, o_custkey::VARCHAR AS user_id, o_orderpriority AS plan_code, o_orderstatus AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders)
 SELECT s.id::BIGINT AS id, s.user_id, CASE WHEN s.n = 1 AND l.event_type = 'purchase' THEN 'pro' ELSE s.plan_code END AS plan_code, CASE WHEN s.n = 1 AND l.user_id IS NOT NULL THEN (CASE WHEN l.event_type = 'error' THEN 'past_due' ELSE 'active' END) ELSE s.status END AS status FROM s LEFT JOIN l ON l.user_id = s.user_id
 UNION ALL SELECT (SELECT max(o_orderkey) FROM orders) + row_number() OVER (ORDER BY l.user_id), l.user_id, CASE WHEN event_type = 'purchase' THEN 'pro' END, CASE WHEN event_type = 'error' THEN 'past_due' ELSE 'active' END FROM l WHERE l.user_id NOT IN (SELECT o_custkey::VARCHAR FROM orders)""")
def upserted_subscriptions(t: Tables) -> DataFrame:
    none, when_ = F.lit(None).cast("string"), F.lit(None).cast("timestamp_ntz")
    old = t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderpriority").alias("plan_code"), F.lit("razorpay").alias("gateway"), none.alias("provider_subscription_id"), F.col("o_orderstatus").alias("status"), when_.alias("current_period_start"), when_.alias("current_period_end"), F.lit(False).alias("cancel_at_period_end"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"))
    changes = t.raw("events").filter(F.col("event_type").isin("purchase", "error")).select(F.col("user_id").cast("string").alias("user_id"), F.lit("razorpay").alias("gateway"), none.alias("provider_subscription_id"), F.when(F.col("event_type") == "error", "past_due").otherwise("active").alias("status"), when_.alias("current_period_start"), when_.alias("current_period_end"), F.lit(None).cast("boolean").alias("cancel_at_period_end"), F.when(F.col("event_type") == "purchase", "pro").alias("plan_code"), F.col("event_id").alias("seq"))
    return tables.upsert_subscriptions(old, changes, now()).select(F.col("id").cast("bigint").alias("id"), "user_id", "plan_code", "status")


@query("SELECT c_custkey AS id, c_name AS name FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'P')")
def orphan_files(t: Tables) -> DataFrame:
    return tables.orphans(t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name")), t.raw("orders").filter("o_orderstatus = 'P'").select("o_custkey"), "o_custkey")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_mktsegment <> 'BUILDING')")
def cascaded_delete(t: Tables) -> DataFrame:
    customers = t.raw("customer").select(F.col("c_custkey").alias("id"), F.col("c_mktsegment").alias("user_id"))
    left = tables.delete_owned(customers, customers.filter("user_id = 'BUILDING'"))
    return tables.cascade(t.raw("orders").select("o_orderkey", "o_custkey"), left, "o_custkey").select("o_orderkey")


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P') UNION ALL SELECT o_orderkey, 0, o_totalprice FROM orders WHERE o_orderstatus = 'P'")
def replaced_rows(t: Tables) -> DataFrame:
    new = t.raw("orders").filter("o_orderstatus = 'P'").select(F.col("o_orderkey").alias("l_orderkey"), F.lit(0).alias("l_linenumber"), F.col("o_totalprice").alias("l_quantity"))
    return tables.replace_by_key(t.raw("lineitem").select("l_orderkey", "l_linenumber", "l_quantity"), new, "l_orderkey")


@query("SELECT vec_id AS id, label::INTEGER AS label FROM embeddings WHERE len(embedding) = 64")
def resized_vectors(t: Tables) -> DataFrame:
    kept, _ = tables.change_dimensions(t.chunks(), t.chunks().select("id"), 64)
    return kept.select("id", F.col("label").cast("int").alias("label"))


# reads
@query(f"""SELECT (SELECT count(*) FROM {_SUBS} WHERE status = 'active') AS active_subscriptions, (SELECT count(DISTINCT source) FROM documents) AS total_users, (SELECT count(*) FROM documents) AS total_files,
 (SELECT count(*) FROM {_JOBS} WHERE status = 'failed') AS failed_ingestions, (SELECT count(DISTINCT conv_id) FROM conversations) AS total_chats""")
def admin_metrics(t: Tables) -> DataFrame:
    return reports.admin_metrics(t.subscriptions(), t.files(), t.jobs(), t.messages().select("chat_id").distinct())


@query("SELECT o_orderkey AS id, o_orderdate AS created_at FROM orders WHERE o_custkey = 7")
def chat_list(t: Tables) -> DataFrame:
    return reports.chats_of(t.raw("orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderdate").alias("created_at")), "7").select("id", "created_at")


@query("SELECT conv_id || '-' || turn AS id, CASE role WHEN 'data' THEN 'system' ELSE role END AS role, text AS content FROM conversations WHERE conv_id = 3")
def chat_messages(t: Tables) -> DataFrame:
    none = F.lit(None).cast(f"array<{schema.PART}>")
    messages = t.messages().withColumn("parts", none).withColumn("created_at", F.col("turn"))
    chats = messages.select(F.col("chat_id").alias("id"), F.lit("me").alias("user_id")).distinct()
    own = reports.messages_of(messages, chats, "3", "me")
    return reports.restored_history(own).select("id", "role", C.message_text("parts").alias("content"))


@query("SELECT conv_id::VARCHAR AS chat_id, count(*) AS messages, greatest(count(*) FILTER (role = 'assistant' AND turn % 2 = 1), count(*) FILTER (role = 'user')) AS searches FROM conversations GROUP BY conv_id")
def retrieval_counters(t: Tables) -> DataFrame:
    tool = F.array(F.from_json(F.lit('{"type":"tool-invocation","toolName":"searchKnowledgeBase"}'), schema.PART))
    return reports.retrieval_counters(t.messages().withColumn("parts", F.when((F.col("role") == "assistant") & (F.col("turn") % 2 == 1), tool)))


@query("SELECT source AS user_id, doc_id AS id, 'doc-' || doc_id || '.txt' AS name, n_chars AS size FROM documents WHERE source = 'src3'")
def file_list(t: Tables) -> DataFrame:
    return reports.files_of(t.files().select("user_id", "id", "name", "size", F.col("id").alias("created_at"), F.col("text").alias("file_data"), F.col("text").alias("extracted_text")), "src3").select("user_id", "id", "name", "size")


@query("SELECT d.doc_id AS id, coalesce(n, 0)::INTEGER AS n_chunks, coalesce(txt, '') AS text FROM documents d LEFT JOIN (SELECT vec_id // 3 AS f, count(*) AS n, string_agg('chunk ' || vec_id, chr(10) || chr(10) ORDER BY vec_id) AS txt FROM embeddings GROUP BY 1) c ON c.f = d.doc_id")
def files_with_chunks(t: Tables) -> DataFrame:
    none = F.lit(None).cast("string")
    files = t.files().select("id", "name", "type", "size", F.lit("ready").alias("status"), none.alias("file_data"), none.alias("storage_url"), none.alias("extracted_text"))
    chunks = t.chunks().withColumn("file_id", F.floor(F.col("id") / 3))
    return reports.files_with_chunks(files, chunks).select("id", F.size("chunks").alias("n_chunks"), "text")


@query("SELECT role AS suite, count(*) FILTER (turn % 2 = 0) AS passed, count(*) FILTER (turn % 2 = 1) AS failed, count(*) AS total FROM conversations GROUP BY role")
def pass_rates(t: Tables) -> DataFrame:
    rows = t.messages().select(F.col("role").alias("suite"), F.when(F.col("turn") % 2 == 0, "passed").otherwise("failed").alias("status"))
    return reports.pass_rates(rows).select("suite", "passed", "failed", "total")


@query("SELECT user_id, event_type, max(event_id) AS event_id FROM events GROUP BY user_id, event_type")
def last_of_each(t: Tables) -> DataFrame:
    return reports.last_of_each(t.raw("events").select("user_id", "event_type", "event_id"), ["user_id", "event_type"], "event_id").select("user_id", "event_type", "event_id")


# functions
@query(r"""SELECT doc_id AS id, ceil(length(text) / 4.0)::INTEGER AS tokens, length(text)::INTEGER AS utf16, CASE WHEN length(text) > 300 THEN text[:300] || '...' ELSE text END AS preview, text[:50] AS title, (instr(text, 'the') - 1)::INTEGER AS first_the,
 ceil(n_chars / 1073741824.0 * 1000)::BIGINT AS storage_units, CASE WHEN n_chars < 1024 THEN n_chars || ' B' ELSE ((n_chars * 20 + 1024) // 20480) || '.' || ((n_chars * 20 + 1024) // 2048 % 10) || ' KB' END AS size_label FROM documents""")
def text_measures(t: Tables) -> DataFrame:
    return t.files().select("id", C.estimate_tokens("text").alias("tokens"), C.utf16_length("text").alias("utf16"), C.preview("text").alias("preview"), C.title_of("text").alias("title"), C.index_of("text", F.lit("the")).alias("first_the"), C.storage_units("size").alias("storage_units"), C.size_label("size").alias("size_label"))


@query(r"SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations")
def collapsed_texts(t: Tables) -> DataFrame:
    return t.raw("conversations").select("conv_id", "turn", C.collapse_space("text").alias("text"))


@query(f"""SELECT conv_id, turn, CASE WHEN b = '' THEN b ELSE CASE WHEN regexp_matches(b, '(^|\\n)#{{0,3}}\\s*Answer($|[^A-Za-z0-9_])', 'i') THEN '' ELSE '## Answer' || chr(10) END || b || CASE WHEN regexp_matches(b, '(^|\\n)#{{0,3}}\\s*Key Points($|[^A-Za-z0-9_])', 'i') THEN '' ELSE chr(10) || chr(10) || '## Key Points' || chr(10) || '- Summarized above.' END
 || CASE WHEN turn % 2 = 1 AND NOT regexp_matches(b, '(^|\\n)#{{0,3}}\\s*Sources($|[^A-Za-z0-9_])', 'i') THEN chr(10) || chr(10) || '## Sources' || chr(10) || '{C.SOURCES.split(chr(10))[-1]}' ELSE '' END END AS answer FROM (SELECT conv_id, turn, trim(text, ' ' || chr(10) || chr(9)) AS b FROM conversations)""")
def structured_answers(t: Tables) -> DataFrame:
    return t.raw("conversations").select("conv_id", "turn", C.structured_answer("text", F.col("turn") % 2 == 1).alias("answer"))


@query("SELECT event_id AS id, greatest(0, floor(value - 50 + 0.5))::BIGINT AS quantity, CASE WHEN value > 0 THEN least(100, floor(100.0 * 30 / value + 0.5))::INTEGER ELSE 0 END AS percent, CASE WHEN event_id < 1000 THEN event_id || 'ms' ELSE ((event_id + 5) // 1000) || '.' || lpad(((event_id + 5) // 10 % 100)::VARCHAR, 2, '0') || 's' END AS duration, date_trunc('month', ts)::TIMESTAMP AS cycle_start, date_trunc('month', ts) + INTERVAL 1 MONTH - INTERVAL 1 MILLISECOND AS cycle_end FROM events")
def number_functions(t: Tables) -> DataFrame:
    return t.raw("events").select(F.col("event_id").alias("id"), C.quantity(F.col("value") - 50).alias("quantity"), C.percent(F.lit(30), "value").alias("percent"), C.duration_label("event_id").alias("duration"), C.cycle_start("ts").alias("cycle_start"), C.cycle_end("ts").alias("cycle_end"))


@query("SELECT page_id AS id, 'data:text/html;base64,' || to_base64(encode(html)) AS uri, 'text/html' AS mime, md5(html) AS digest FROM pages")
def data_addresses(t: Tables) -> DataFrame:
    files = t.raw("pages").select(F.col("page_id").alias("id"), C.data_uri(F.encode("html", "UTF-8"), F.lit("text/html")).alias("file_data"), F.lit("x").alias("type"))
    return files.join(sinks.served(files), "id").select("id", F.col("file_data").alias("uri"), C.media_type("file_data").alias("mime"), F.md5("content").alias("digest"))


@query("SELECT page_id AS id, CASE WHEN page_id % 3 = 0 THEN 'image' WHEN page_id % 3 = 1 THEN 'document' ELSE 'unknown' END AS category, page_id % 3 = 0 AS accepted FROM pages")
def media_kinds(t: Tables) -> DataFrame:
    mime = F.when(F.col("page_id") % 3 == 0, "image/png").when(F.col("page_id") % 3 == 1, "text/csv").otherwise("x")
    return t.raw("pages").select(F.col("page_id").alias("id"), C.media_category(F.lit("file"), mime).alias("category"), C.accepts(F.lit("image/*, text/plain"), mime).alias("accepted"))


# ingestion and row builders
@query(f"SELECT o_orderkey AS id, 'doc-' || doc_id || '.txt' AS name, CASE WHEN doc_id IS NULL THEN '{jobs.NO_FILE}' END AS error FROM orders LEFT JOIN documents ON doc_id = o_custkey")
def job_files(t: Tables) -> DataFrame:
    return jobs.with_files(t.jobs().select("id", "file_id"), t.files().select("id", "name")).select("id", F.col("file.name").alias("name"), "error")


@query(f"SELECT id, status FROM {_JOBS} WHERE status IN ('queued', 'processing')")
def pending_jobs(t: Tables) -> DataFrame:
    return jobs.pending(t.jobs()).select("id", "status")


@query("SELECT doc_id AS file_id, 'queued' AS status, 0 AS attempts FROM documents")
def queued_uploads(t: Tables) -> DataFrame:
    return sinks.job_rows(t.files(), now()).select("file_id", "status", "attempts")


@query("SELECT substr(sha256('chat' || chr(31) || conv_id || '-' || turn), 1, 21) AS id, text[:50] AS title, 'u' || conv_id AS user_id FROM conversations")
def made_chats(t: Tables) -> DataFrame:
    requests = t.messages().select(F.col("id").alias("request_id"), F.concat(F.lit("u"), "chat_id").alias("user_id"), C.title_of("content").alias("title"))
    return sinks.chat_rows(requests, now()).select("id", "title", "user_id")


_DONE = "'## Answer' || chr(10) || 'done' || chr(10) || chr(10) || '## Key Points' || chr(10) || '- Summarized above.'"


@query(f"""SELECT CASE WHEN turn % 2 = 1 THEN substr(sha256('user' || chr(31) || conv_id || '-' || turn), 1, 21) ELSE conv_id || '-' || turn END AS id, conv_id::VARCHAR AS chat_id, role, CASE WHEN trim(coalesce(text, ''), ' ' || chr(9) || chr(10)) = '' THEN '' ELSE text END AS content, 1 AS n_parts FROM conversations WHERE turn % 7 <> 0
 UNION ALL SELECT substr(sha256('assistant' || chr(31) || conv_id || '-' || turn), 1, 21), conv_id::VARCHAR, 'assistant', {_DONE} || CASE WHEN turn % 2 = 1 THEN '{C.SOURCES}' ELSE '' END, CASE WHEN turn % 2 = 1 THEN 2 ELSE 1 END FROM conversations WHERE turn % 7 <> 0""")
def ended_turns(t: Tables) -> DataFrame:
    odd, none = F.col("turn") % 2 == 1, F.lit(None).cast(f"array<{schema.PART}>")
    kind = "array<struct<type: string, toolName: string, args: string, toolCallId: string>>"
    called = F.from_json(F.lit(f'[{{"type":"tool-call","toolName":"{C.SEARCH_TOOL}","args":"{{}}","toolCallId":"1"}}]'), kind)
    message = F.struct(F.when(~odd, F.col("id")).alias("id"), "role", C.restored_parts(none, "content").alias("parts"))
    turns = t.messages().select(F.col("id").alias("request_id"), F.when(F.col("turn") % 7 != 0, F.col("chat_id")).alias("chat_id"), message.alias("message"), F.lit("done").alias("answer"), F.when(odd, called).otherwise(F.array().cast(kind)).alias("calls"))
    return sinks.message_rows(turns, now()).select("id", "chat_id", "role", "content", F.size("parts").alias("n_parts"))


@query("SELECT conv_id::VARCHAR AS chat_id, arg_max(conv_id || '-' || turn, turn) AS id FROM conversations GROUP BY conv_id")
def last_messages(t: Tables) -> DataFrame:
    return reports.last_messages(t.messages(), "turn").select("chat_id", "id")


@query("""SELECT page_id AS id, CASE page_id % 4 WHEN 0 THEN html WHEN 1 THEN page_id || ' a "' || page_id || '"' || chr(10) || 'b' || chr(10) || 'x ' || page_id END AS text,
 CASE page_id % 4 WHEN 2 THEN 'Unsupported file type: .png' WHEN 3 THEN 'No text extracted from p' || page_id || '.TXT. Scanned PDFs and image-only documents are not supported yet.' END AS error FROM pages""")
def extracted_files(t: Tables) -> DataFrame:
    page, kind = F.col("page_id").cast("string"), F.col("page_id") % 4
    cells = F.concat(page, F.lit(',"a ""'), page, F.lit('""\nb"\n\nx,'), page, F.lit("\n"))
    content = F.when(kind == 0, F.col("html")).when(kind == 1, cells).otherwise(F.lit(" \n"))
    name = F.concat(F.lit("p"), page, F.when(kind == 0, ".md").when(kind == 1, ".csv").when(kind == 2, ".png").otherwise(".TXT"))
    files = t.raw("pages").select(F.col("page_id").alias("id"), name.alias("name"), F.lit(None).cast("string").alias("type"), F.encode(content, "UTF-8").alias("content"))
    return extract.extract(files).select("id", "text", "error")


@query("""WITH o AS (SELECT l_orderkey AS job_id, l_linenumber AS n, l_shipdate AS told, CASE WHEN l_returnflag <> 'N' THEN 'error ' || l_suppkey END AS error FROM lineitem WHERE l_linenumber BETWEEN 1 AND 5 QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_shipdate, l_returnflag = 'N', 'error ' || l_suppkey) = 1),
 c AS (SELECT *, row_number() OVER w AS nth, coalesce(bool_or(error IS NULL) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM o WINDOW w AS (PARTITION BY job_id ORDER BY n)),
 l AS (SELECT job_id, max(n) AS n, max_by(told, n) AS told, arg_max_null(error, n) AS error FROM c WHERE nth = n AND NOT done GROUP BY job_id)
 SELECT o_orderkey AS job_id, CASE WHEN l.n IS NULL THEN 'processing' WHEN error IS NULL THEN 'completed' WHEN l.n < 5 THEN 'queued' ELSE 'failed' END AS status, coalesce(l.n, 1)::INTEGER AS attempts, error AS last_error,
 CASE WHEN error IS NOT NULL AND l.n < 5 THEN told + to_minutes((2 ** l.n)::INTEGER) END AS next_retry_at FROM orders LEFT JOIN l ON job_id = o_orderkey""")
def job_states(t: Tables) -> DataFrame:
    error = F.when(F.col("l_returnflag") != "N", F.concat(F.lit("error "), F.col("l_suppkey").cast("string")))
    outcomes = t.raw("lineitem").select(F.col("l_orderkey").alias("job_id"), F.col("l_linenumber").alias("attempt"), error.alias("error"), F.col("l_shipdate").alias("at"))
    return queue.final_states(t.raw("orders").select(F.col("o_orderkey").alias("job_id")), outcomes)


_PAGE_PATH = "'uploads/u' || page_id % 3 || '/' || (1705752000000 + page_id) || '-page ' || page_id || '-' || sha256('run' || chr(31) || sha256(html))[:32] || '.html'"


@query(f"SELECT page_id AS id, {_PAGE_PATH} AS pathname, replace({_PAGE_PATH}, ' ', '%20') AS address, strlen(html)::INTEGER AS size FROM pages")
def blob_puts(t: Tables) -> DataFrame:
    page = F.col("page_id")
    path = sinks.blob_path(F.concat(F.lit("u"), (page % 3).cast("string")), page + 1705752000000, F.concat(F.lit("page "), page.cast("string"), F.lit(".html")))
    made = blobs.suffixed_column(path, F.lit("run"), F.encode("html", "UTF-8"))
    return t.raw("pages").select(page.alias("id"), made.alias("pathname"), C.url_path(made).alias("address"), F.octet_length("html").alias("size"))


@query("SELECT page_id AS id, CASE WHEN page_id % 5 > 1 THEN md5(html) END AS digest, CASE page_id % 5 WHEN 0 THEN 'No source payload available for ingestion' WHEN 1 THEN 'Invalid data URI content' END AS error FROM pages")
def page_bodies(t: Tables) -> DataFrame:
    kind = F.col("page_id") % 5
    data = F.when(kind == 1, F.col("html")).when(kind > 1, C.data_uri(F.encode("html", "UTF-8"), F.lit("text/html")))
    files = t.raw("pages").select(F.col("page_id").alias("id"), F.lit(None).cast("string").alias("storage_url"), data.alias("file_data"))
    return blobs.with_bodies(files).select("id", F.md5("content").alias("digest"), F.col("body_error").alias("error"))


@query("SELECT page_id AS id, 1 AS page, array_to_string(list_filter(string_split(html, chr(10)), lambda x: x <> ''), chr(10)) AS text, NULL::VARCHAR AS error FROM pages")
def pdf_pages(t: Tables) -> DataFrame:
    lanes = max(int(t.spark.conf.get("spark.sql.shuffle.partitions")), 4 * t.spark.sparkContext.defaultParallelism)
    pages = t.raw("pages").select("page_id", "html").repartition(lanes, "page_id")  # reading takes longer than moving, and a file may be one split
    return pdf.page_rows(pages.select(F.col("page_id").alias("id"), pdf.one_page(F.col("html")).alias("content")))


@query(SQL["structured_answers"])
def sql_structured_answers(t: Tables) -> DataFrame:
    A.register(t.spark)
    return t.raw("conversations").selectExpr("conv_id", "turn", "ensure_structured_answer(text, turn % 2 = 1) AS answer")


@query(r"SELECT conv_id, turn, ceil(length(text) / 4.0)::INTEGER AS tokens, trim(regexp_replace(text, '\s+', ' ', 'g')) AS text FROM conversations")
def sql_text_functions(t: Tables) -> DataFrame:
    A.register(t.spark)
    return t.raw("conversations").selectExpr("conv_id", "turn", "estimate_tokens(text) AS tokens", "sanitize_text(text) AS text")


# no SQL: tested on fixtures
@query()
def chunked_documents(t: Tables) -> DataFrame:
    return chunking.chunk(t.files()).select("id", "chunk_index", "content", F.col("metadata.charOffset").alias("offset"), F.col("metadata.positionPercent").alias("percent"), F.col("metadata.totalChunks").alias("total"))


@query()
def embedded_documents(t: Tables) -> DataFrame:
    return embedding.embed(t.files().select("id", "text"), "text", embedding.HashingEmbedder(64)).select("id", F.transform("embeddings", lambda x: F.round(x.cast("double"), 6)).alias("vector"))


_INNER, _OUTER = (p.hex() for p in A.pads("secret"))


@query(f"SELECT page_id AS id, sha256(from_hex('{_OUTER}') || from_hex(sha256(from_hex('{_INNER}') || encode(html)))) AS signature FROM pages")
def signed_bodies(t: Tables) -> DataFrame:
    return t.raw("pages").select(F.col("page_id").alias("id"), A.hmac_hex(F.col("html"), "secret").alias("signature"))
