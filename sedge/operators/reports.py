"""Reads for pages: histories, files with their chunks, and figures."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions import columns as C


def admin_metrics(subscriptions: DataFrame, files: DataFrame, jobs: DataFrame, chats: DataFrame) -> DataFrame:
    """One row; each table is read once, and only its column that counts."""
    one = [
        subscriptions.agg(F.count_if(F.col("status") == "active").alias("active_subscriptions")),
        files.agg(F.countDistinct("user_id").alias("total_users"), F.count("*").alias("total_files")),
        jobs.agg(F.count_if(F.col("status") == "failed").alias("failed_ingestions")),
        chats.agg(F.count("*").alias("total_chats")),
    ]
    return reduce(lambda a, b: a.crossJoin(b), one)  # single rows


def chats_of(chats: DataFrame, user_id: str) -> DataFrame:
    return chats.filter(F.col("user_id") == user_id).orderBy(F.col("created_at").desc(), "id")


def messages_of(messages: DataFrame, chats: DataFrame, chat_id: str, user_id: str) -> DataFrame:
    """Messages of a chat in their order, if the user owns it."""
    own = chats.filter((F.col("id") == chat_id) & (F.col("user_id") == user_id)).select(F.col("id").alias("chat_id"))
    return messages.filter(F.col("chat_id") == chat_id).join(own, "chat_id", "left_semi").select("id", "chat_id", "role", "content", "parts", "created_at").orderBy("created_at", "id")


def last_messages(messages: DataFrame, order: str = "created_at") -> DataFrame:
    """The last message of each chat."""
    return messages.groupBy("chat_id").agg(F.max_by(F.struct(*messages.columns), F.struct(order, "id")).alias("r")).select("r.*")


def restored_history(messages: DataFrame) -> DataFrame:
    return messages.select("id", C.restored_role("role").alias("role"), C.restored_parts("parts", "content").alias("parts"))


def files_of(files: DataFrame, user_id: str) -> DataFrame:
    """Newest first, without bodies."""
    return files.filter(F.col("user_id") == user_id).drop("file_data", "extracted_text").orderBy(F.col("created_at").desc(), F.col("id").desc())


def files_with_chunks(files: DataFrame, chunks: DataFrame) -> DataFrame:
    """Each file with whether it has a body and its chunks in order."""
    listed = chunks.groupBy("file_id").agg(F.sort_array(F.collect_list(F.struct("id", "content"))).alias("chunks"))
    head = files.select("id", "name", "type", "size", "status", F.col("file_data").isNotNull().alias("has_file_data"), F.col("storage_url").isNotNull().alias("has_storage_url"), "extracted_text")
    return head.join(listed.withColumnRenamed("file_id", "id"), "id", "left").withColumn("chunks", F.coalesce("chunks", F.array())).withColumn("text", F.coalesce("extracted_text", F.array_join(F.transform("chunks", lambda c: c["content"]), "\n\n")))


def chunk_counts(chunks: DataFrame) -> DataFrame:
    return chunks.groupBy("file_id").agg(F.count("*").alias("chunks"))


def retrieval_counters(messages: DataFrame) -> DataFrame:
    """For each chat: messages, and searches (those called, but one for each question
    of the user at least)."""
    calls = F.size(F.filter(F.coalesce("parts", F.array()), lambda p: p["toolName"] == C.SEARCH_TOOL))
    return messages.groupBy("chat_id").agg(F.count("*").alias("messages"), F.greatest(F.sum(calls), F.count_if(F.col("role") == "user")).cast("bigint").alias("searches"))


def last_search(messages: DataFrame) -> DataFrame:
    """The last search call of each chat."""
    each = messages.select("chat_id", "created_at", "id", F.posexplode("parts").alias("place", "part")).filter(F.col("part.toolName") == C.SEARCH_TOOL)
    return each.groupBy("chat_id").agg(F.max_by("part", F.struct("created_at", "id", "place")).alias("last"))


def active_segments(segments: DataFrame, at) -> DataFrame:
    """Segments that are not blank and hold the moment: from start on, before end."""
    return segments.filter((C.trim_all("text") != "") & (F.col("start") <= at) & (at < F.col("end")))


def last_of_each(rows: DataFrame, keys: list[str], order: str) -> DataFrame:
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rows.columns), order).alias("r")).select("r.*")


def pass_rates(results: DataFrame) -> DataFrame:
    """passed and failed in percent of each suite; 0 of none."""
    total = results.groupBy("suite").agg(F.count_if(F.col("status") == "passed").alias("passed"), F.count_if(F.col("status") == "failed").alias("failed"), F.count("*").alias("total"))
    share = lambda c: F.coalesce(F.try_divide(100.0 * F.col(c), F.col("total")), F.lit(0.0))
    return total.withColumns({"passed_percent": share("passed"), "failed_percent": share("failed")})


def admitted(uploads: DataFrame, accept: str, max_size: int | None, capacity: int | None) -> DataFrame:
    """Uploads (id, type, size) that a form takes: type, then size, then the first
    ``capacity`` of them."""
    rows = uploads.filter(C.accepts(F.lit(accept), "type"))
    rows = rows if max_size is None else rows.filter(F.col("size") <= max_size)
    return rows if capacity is None else rows.orderBy("id").limit(capacity)
