"""Hourly sums of usage that take in late, repeated and corrected events batch by batch.

An event is known by its id and its time. What a batch changes is a ledger of the events
that it counts, with what they counted before, and the sums of that by user, metric and
hour. Sums of any two sets of batches add up, so a month is read from hours, never from
events.
"""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions import columns as C
from sedge.operators import billing
from sedge.sources.versions import _Folder

EVENTS = "id bigint, occurred_at timestamp_ntz, revision int, user_id string, metric string, quantity bigint"
LEDGER = f"{EVENTS}, old struct<user_id: string, metric: string, quantity: bigint>, fresh boolean"
SUMS = "user_id string, metric string, hour timestamp_ntz, quantity bigint, events bigint"
_DONE, _BASE = "_done", "_base"


def counted(batch: DataFrame, ledger: DataFrame) -> DataFrame:
    """The rows that ``batch`` (EVENTS, revision may be missing) adds to ``ledger``.

    Of rows with equal id and time the highest revision counts, of equal revisions the
    greatest row. It is new to the ledger, or its revision is higher than the one there;
    ``old`` then says what that one counted. A correction keeps id and time. Rows without
    id can't be recognised and count each; rows without a time count never; a null
    quantity is 0, a null revision the first.
    """
    if "revision" not in batch.columns:
        batch = batch.withColumn("revision", F.lit(0))
    counts = F.struct("user_id", "metric", "quantity")
    rows = batch.filter("occurred_at is not null").select("id", "occurred_at", F.coalesce("revision", F.lit(0)).alias("revision"), "user_id", "metric", F.coalesce("quantity", F.lit(0)).alias("quantity"))
    best = lambda df: df.filter("id is not null").groupBy("id", "occurred_at").agg(F.max(F.struct("revision", counts.alias("counts"))).alias("best"))
    known = best(ledger).select("id", "occurred_at", F.col("best.revision").alias("before"), F.col("best.counts").alias("old"))
    some = best(rows).select("id", "occurred_at", "best.revision", "best.counts.*").join(known, ["id", "occurred_at"], "left").filter("before is null or revision > before")
    none = F.lit(None).cast("struct<user_id: string, metric: string, quantity: bigint>")
    nameless = rows.filter("id is null").withColumns({"old": none, "fresh": F.lit(True)})
    out = some.withColumn("fresh", F.col("before").isNull()).drop("before").unionByName(nameless)
    return out.selectExpr(*[f"CAST({name} AS {kind}) AS {name}" for name, kind in (c.split(" ", 1) for c in EVENTS.split(", "))], "old", "fresh")


def hourly(rows: DataFrame) -> DataFrame:
    """SUMS of ledger rows: what they count less what they counted before."""
    signs = F.array(F.struct("user_id", "metric", "quantity", F.lit(1).alias("events")), F.when(F.col("old").isNotNull(), F.struct("old.user_id", "old.metric", (-F.col("old.quantity")).alias("quantity"), F.lit(-1).alias("events"))))
    each = rows.select(F.date_trunc("HOUR", "occurred_at").cast("timestamp_ntz").alias("hour"), F.explode(F.array_compact(signs)).alias("x")).select("hour", "x.*")
    return _summed(each)


def _summed(rows: DataFrame) -> DataFrame:
    total = rows.groupBy("user_id", "metric", "hour").agg(F.sum("quantity").alias("quantity"), F.sum("events").alias("events"))
    return total.filter("quantity <> 0 or events <> 0").select("user_id", "metric", "hour", "quantity", F.col("events").cast("bigint").alias("events"))


def merged(*sums: DataFrame) -> DataFrame:
    """One table of SUMS from several; hours of which nothing is left go."""
    return _summed(reduce(DataFrame.unionByName, sums))


def month_totals(sums: DataFrame, now: datetime) -> DataFrame:
    """``billing.usage_totals`` of the month of ``now``, with its last hour whole."""
    return billing.usage_totals(sums.withColumnRenamed("hour", "occurred_at"), now)


def take_in(batch: DataFrame, path: str, number: int) -> None:
    """Add batch ``number`` to the roll-ups in ``path``; a batch that is there changes nothing.

    Batches come one after the other. The ledger lies by day and batch, and only days that
    the batch touches are read; sums lie by month and batch. A run that breaks off is seen
    by no reader, and running it again writes the same files anew.
    """
    spark = batch.sparkSession
    folder = _Folder(spark, path)
    if folder.files.exists(folder.at(_DONE, str(number))):
        return
    rows = batch.persist()
    try:
        day = F.date_format("occurred_at", "yyyy-MM-dd")
        days = [r[0] for r in rows.filter("occurred_at is not null").select(day).distinct().collect()]  # a row a day

        def ledger() -> DataFrame:
            there = [f"{path}/ledger/day={d}" for d in days if folder.files.exists(folder.at("ledger", f"day={d}"))]
            kept = spark.read.schema(f"{LEDGER}, day string, batch bigint").option("basePath", f"{path}/ledger")
            return kept.parquet(*there) if there else spark.createDataFrame([], f"{LEDGER}, day string, batch bigint")

        _write(counted(rows, ledger().filter(F.col("batch") < number)).withColumn("day", day), f"{path}/ledger", "day", number)
        _write(hourly(ledger().filter(F.col("batch") == number)).withColumn("month", F.date_format("hour", "yyyy-MM")), f"{path}/sums", "month", number)
        folder.files.create(folder.at(_DONE, str(number)), True).close()
    finally:
        rows.unpersist()


def _write(df: DataFrame, path: str, by: str, number: int) -> None:
    rows = df.withColumn("batch", F.lit(number).cast("bigint")).repartition(by, F.pmod(F.xxhash64(*[c for c in ("id", "user_id", "hour") if c in df.columns]), F.lit(8)))
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by, "batch").parquet(path)


def sink(path: str) -> Callable[[DataFrame, int], None]:
    """What ``continuous.each_batch`` runs on a stream of events: each batch counts once."""
    return lambda batch, number: take_in(batch, path, number)


def _state(folder: _Folder) -> tuple[int, int]:
    """The last batch that is there, and the last that the base holds; -1 for none."""
    last = lambda name: max((int(n) for n, _ in folder.names(name) if n.isdigit()), default=-1)
    return last(_DONE), last(_BASE)


def read(spark: SparkSession, path: str, now: datetime | None = None) -> DataFrame:
    """SUMS of all batches that are whole; with ``now``, only files of its month are read."""
    folder = _Folder(spark, path)
    done, base = _state(folder)
    parts = [spark.createDataFrame([], SUMS)]
    for place, wanted in ((f"base/{base}", base >= 0), ("sums", done > base)):
        if wanted and folder.files.exists(folder.at(place)):
            rows = spark.read.schema(f"{SUMS}, month string, batch bigint").parquet(f"{path}/{place}").filter(F.col("batch").between(base + 1, done) if place == "sums" else F.lit(True))
            parts.append((rows.filter(F.col("month") == C.cycle_bounds(now)[0].strftime("%Y-%m")) if now else rows).drop("month", "batch"))
    return merged(*parts)


def compact(spark: SparkSession, path: str) -> None:
    """Put the sums of all whole batches into one base; readers see it once it is whole."""
    folder = _Folder(spark, path)
    done, base = _state(folder)
    if done > base:
        _write(read(spark, path).withColumn("month", F.date_format("hour", "yyyy-MM")), f"{path}/base/{done}", "month", done)
        folder.files.create(folder.at(_BASE, str(done)), True).close()
