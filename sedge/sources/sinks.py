"""Writers: appended logs, snapshots that replace partitions, and stored bodies."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge import schema
from sedge.functions import columns as C


def append(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    writer = df.write.mode("append")
    (writer.partitionBy(*partition_by) if partition_by else writer).parquet(path)


def _staged(spark, path: str):
    """(address of what is staged for ``path``, its file system, its Hadoop path)."""
    address = f"{path.rstrip('/')}.staged"
    place = spark._jvm.org.apache.hadoop.fs.Path(address)
    return address, place.getFileSystem(spark._jsc.hadoopConfiguration()), place


def recover_chunks(spark, path: str) -> None:
    """Ends a replacement that broke off: staged buckets that are whole, as Spark's mark
    of success says, are put in place (again, if need be); others are dropped."""
    staged, files, place = _staged(spark, path)
    if files.exists(spark._jvm.org.apache.hadoop.fs.Path(place, "_SUCCESS")):
        ready = spark.read.parquet(staged)
        ready.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
    files.delete(place, True)


def replace_chunks(chunks: DataFrame, path: str, buckets: int = 64) -> None:
    """Chunks of whole files in place of what these files had.

    Partitions are buckets of files; a bucket is rewritten with its other files' rows
    kept, so a second run changes nothing. A run counts once its buckets are staged:
    if it breaks off before, nothing has changed; if later, the next run (or
    ``recover_chunks``) ends it first.
    """
    spark = chunks.sparkSession
    recover_chunks(spark, path)
    new = chunks.withColumn("bucket", F.pmod(F.xxhash64("file_id"), F.lit(buckets)).cast("int")).persist()
    try:
        old = spark.read.parquet(path)
        touched = new.select("bucket").distinct()  # ``buckets`` rows at most
        keep = old.join(F.broadcast(touched), "bucket", "left_semi").join(new.select("file_id").distinct(), "file_id", "left_anti")
        merged = new.unionByName(keep.select(*new.columns))
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e) and "UNABLE_TO_INFER_SCHEMA" not in str(e):
            raise
        merged = new
    merged.write.mode("overwrite").partitionBy("bucket").parquet(_staged(spark, path)[0])
    recover_chunks(spark, path)
    new.unpersist()


def job_rows(files: DataFrame, now) -> DataFrame:
    """A queued job for each file, not tried yet."""
    no_time = F.lit(None).cast(schema.NOW)
    return files.select(
        F.col("id").alias("file_id"), F.lit("queued").alias("status"), F.lit(0).alias("attempts"), F.lit(None).cast("string").alias("last_error"),
        no_time.alias("next_retry_at"), no_time.alias("started_at"), no_time.alias("finished_at"), now.alias("created_at"), now.alias("updated_at"),
    )


def made_id(*parts) -> Column:
    """21 characters that are the same whenever a task runs again."""
    return F.substring(F.sha2(F.concat_ws("\x1f", *parts).cast("binary"), 256), 1, 21)


def chat_rows(requests: DataFrame, now) -> DataFrame:
    """A chat for each request (request_id, user_id, title)."""
    return requests.select(made_id(F.lit("chat"), F.col("request_id").cast("string")).alias("id"), "title", "user_id", now.alias("created_at"), now.alias("updated_at"))


def message_rows(turns: DataFrame, now) -> DataFrame:
    """The rows of ended turns (request_id, chat_id, message, answer, calls): what the user
    said, under its own id if it has one, and the answer with its headers and calls.

    ``message`` is a struct of id, role and parts, ``calls`` as ``C.tool_calls`` gives
    them. Turns without a chat have no rows.
    """
    rows = turns.filter(F.coalesce("chat_id", F.lit("")) != "").withColumn("_answer", C.structured_answer("answer", C.had_lookup(F.col("calls"))))
    request = F.col("request_id").cast("string")
    said, parts = F.col("message"), F.array().cast(f"array<{schema.PART}>")
    user = F.struct(F.coalesce(F.nullif(said["id"], F.lit("")), made_id(F.lit("user"), request)).alias("id"), "chat_id", said["role"].alias("role"), C.message_text(said["parts"]).alias("content"), F.coalesce(said["parts"], parts).alias("parts"), now.alias("created_at"))
    answer = F.struct(made_id(F.lit("assistant"), request).alias("id"), "chat_id", F.lit("assistant").alias("role"), F.col("_answer").alias("content"), F.coalesce(C.assistant_parts("_answer", "calls"), parts).alias("parts"), now.alias("created_at"))
    return rows.select(F.inline(F.array(user, answer)))


def file_rows(uploads: DataFrame, blob_token: bool, now) -> DataFrame:
    """File rows for uploads (user_id, name, type, size, content, url): queued, the
    body by address, or inline up to ``INLINE_MB``; error where it is neither."""
    mime = F.coalesce(F.nullif("type", F.lit("")), F.lit("application/octet-stream"))
    inline = F.lit(not blob_token) & (F.col("size") <= schema.INLINE_MB * 1024 * 1024)
    return uploads.select(
        "user_id", "name", mime.alias("type"), "size", F.when(F.lit(blob_token), F.col("url")).alias("storage_url"),
        F.when(inline, C.data_uri("content", mime)).alias("file_data"), F.lit("queued").alias("status"),
        F.when(~inline & F.lit(not blob_token), "Storage is not configured for files of this size").alias("error"), now.alias("created_at"),
    )


def blob_path(user, millis, name):
    return F.concat_ws("/", F.lit("uploads"), user, F.concat(millis.cast("string"), F.lit("-"), name))


def write_bodies(rows: DataFrame, put, path_col: str = "path", content_col: str = "content") -> DataFrame:
    """(path, size) of bodies put into a store by ``put(path, bytes)``, one by one in
    their tasks; putting again overwrites the same."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for p, c in zip(b[path_col], b[content_col], strict=True):
                put(p, bytes(c))
            yield pd.DataFrame({"path": b[path_col], "size": [len(c) for c in b[content_col]]})

    return rows.select(path_col, content_col).mapInPandas(run, "path string, size long")


def served(files: DataFrame) -> DataFrame:
    """id, type and the original bytes of inline files."""
    return files.select("id", F.coalesce(C.media_type("file_data"), F.col("type")).alias("type"), C.data_uri_bytes("file_data").alias("content"))
