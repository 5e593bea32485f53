"""The ingestion queue as a table: what is due, and what becomes of a job."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions import columns as C

MOST_ATTEMPTS = 5
#: Fixed value: the error of a job whose file is missing.
NO_FILE = "File not found for ingestion job"


def clamp_limit(limit, default: int = 2) -> int:
    """1 to 20; what is no number is an error."""
    return max(1, min(int(default if limit is None else limit), 20))


def due_jobs(jobs: DataFrame, now, limit: int = 2, lease_minutes: int | None = None) -> DataFrame:
    """Queued jobs whose time has come, oldest first. With a lease, jobs that have been
    in work for longer count as queued again."""
    due = (F.col("status") == "queued") & (F.col("next_retry_at").isNull() | (F.col("next_retry_at") <= now))
    if lease_minutes is not None:
        due = due | ((F.col("status") == "processing") & (F.col("started_at") < C.plus_minutes(now, -lease_minutes)))
    return jobs.filter(due).orderBy("created_at", "id").limit(clamp_limit(limit))


def with_files(jobs: DataFrame, files: DataFrame) -> DataFrame:
    """``jobs`` with ``file``, a struct of their file's columns, and ``error``, which says
    so if there is none."""
    own = files.select(F.col("id").alias("_file"), F.struct(*files.columns).alias("file"))
    return jobs.join(own, F.col("file_id") == F.col("_file"), "left").withColumn("error", F.when(F.col("_file").isNull(), NO_FILE)).drop("_file")


def pending(rows: DataFrame) -> DataFrame:
    """Files or jobs that wait or are in work."""
    return rows.filter(F.col("status").isin("queued", "processing"))


def claim(jobs: DataFrame, now) -> DataFrame:
    return jobs.withColumns({"status": F.lit("processing"), "attempts": F.col("attempts") + 1, "started_at": now, "last_error": F.lit(None).cast("string"), "updated_at": now})


def complete(jobs: DataFrame, now) -> DataFrame:
    return jobs.withColumns({"status": F.lit("completed"), "finished_at": now, "updated_at": now})


def fail(jobs: DataFrame, error, now) -> DataFrame:
    """Claimed jobs after an error: queued again after 2, 4, 8, 16 minutes, then failed."""
    again = F.col("attempts") < MOST_ATTEMPTS
    return jobs.withColumns({
        "next_retry_at": F.when(again, C.plus_minutes(now, C.backoff_minutes("attempts"))),
        "finished_at": F.when(~again, now),
        "status": F.when(again, "queued").otherwise("failed"),
        "last_error": error,
        "updated_at": now,
    })


def settle(claimed: DataFrame, outcomes: DataFrame, now) -> DataFrame:
    """Claimed jobs with their outcomes (id, error; null: done) applied."""
    rows = claimed.join(outcomes.select("id", F.col("error").alias("_error")), "id")
    columns = claimed.columns
    done = complete(rows.filter("_error is null"), now).select(*columns)
    return done.unionByName(fail(rows.filter("_error is not null"), F.col("_error"), now).select(*columns))


def file_outcomes(files: DataFrame, outcomes: DataFrame) -> DataFrame:
    """Files after a run. ``outcomes``: file_id, text, error. A failed one says so even
    if its job will run again; text_bytes counts UTF-16 units."""
    rows = files.join(outcomes.select(F.col("file_id").alias("id"), "text", "error", F.lit(True).alias("_ran")), "id", "left")
    ran, bad = F.col("_ran").isNotNull(), F.col("error").isNotNull()
    return rows.withColumns({
        "status": F.when(ran & bad, "failed").when(ran, "ready").otherwise(F.col("status")),
        "processing_error": F.when(ran, F.col("error")).otherwise(F.col("processing_error")),
        "extracted_text": F.when(ran & ~bad, F.col("text")).otherwise(F.col("extracted_text")),
        "text_bytes": F.when(ran & ~bad, C.utf16_length("text")).otherwise(F.col("text_bytes")),
    }).select(*files.columns)


def run_summary(results: DataFrame) -> DataFrame:
    """processed_jobs, and the results themselves, of one bounded run."""
    return results.agg(F.count("*").alias("processed_jobs"), F.sort_array(F.collect_list(F.struct(*results.columns))).alias("results"))
