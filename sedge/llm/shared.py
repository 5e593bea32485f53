"""What several operators of this subpackage need: tables on shared storage,
ranks in hot groups, connected components and shipping of this package."""

from __future__ import annotations

import atexit
import ctypes
import shutil
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, as a character class body for Java and Python expressions.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"

#: Bytes of an Arrow batch: texts are long, ten thousand of them fill a worker.
_BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 1 << 20
_own_dirs: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give the executors this package, once for each application, and bound Arrow batches by
    bytes unless the session does; that changes no result of any query."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    folder = tempfile.mkdtemp(prefix="sedge-ship-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    target = Path(folder) / "sedge_package.zip"
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    spark.sparkContext.addPyFile(str(target))
    if not spark.conf.get(_BATCH, None):
        spark.conf.set(_BATCH, str(BATCH_BYTES))
    _shipped.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Only where the session names none and has a local master (tests) a temporary
    folder is made for the application and removed when the driver ends.
    """
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return f"{root.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    if app not in _own_dirs:
        _own_dirs[app] = tempfile.mkdtemp(prefix="sedge-shared-")
        atexit.register(shutil.rmtree, _own_dirs[app], ignore_errors=True)
    return f"file://{_own_dirs[app]}"


def stored(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    Cuts the lineage: what follows reads the files, also after an executor
    is lost, and computes nothing twice.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


#: Arrow's types of what ``small_table`` takes.
_KINDS = {"long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "string": pa.string()}


def small_table(spark: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """``rows`` by way of Arrow: a list would go through Python workers on the executors,
    and a process of their own that forks them stays with each executor."""
    fields = [x.split() for x in schema.split(", ")]
    return spark.createDataFrame(pa.table({name: pa.array([r[i] for r in rows], _KINDS[kind]) for i, (name, kind) in enumerate(fields)}), schema)


def trim() -> None:
    """Give what this worker has freed back to the system."""
    pa.default_memory_pool().release_unused()
    if give := getattr(ctypes.CDLL(None), "malloc_trim", None):  # of the GNU C library
        give(0)


def trimmed(f: Callable) -> Callable:
    """``f``, a generator over batches, trimmed at the end of its task.

    Workers are kept for other tasks, and what they hold counts against their executor.
    """

    def run(batches: Iterator) -> Iterator:
        try:
            yield from f(batches)
        finally:
            trim()

    return run


def trimmed_group(f: Callable) -> Callable:
    """``f``, of one large group, trimmed after each."""

    def run(group: pd.DataFrame) -> pd.DataFrame:
        try:
            return f(group)
        finally:
            trim()

    return run


#: Classes into which a task deals packed rows at once: each of its flushes makes a row for
#: each class at most, so with more the rows would be small and many.
COARSE = 4096


def resplit(packed: DataFrame, schema: str, split: Callable[[pd.DataFrame], pd.DataFrame], flush: int) -> DataFrame:
    """``packed`` rows (part, binary columns) dealt into finer classes (part, fine).

    Rows are first brought together by part, so a task sees few parts; it gathers
    ``flush`` rows' worth of bytes of a part before ``split(rows of one part)`` deals them.
    """
    names = [x.split()[0] for x in schema.split(", ")]

    def deal(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: dict[int, list[pd.DataFrame]] = {}
        size: dict[int, int] = {}
        for batch in batches:
            for part, rows in batch.groupby("part"):
                held.setdefault(part, []).append(rows)
                size[part] = size.get(part, 0) + int(sum(rows[c].map(len).sum() for c in names[1:]))
                if size[part] >= 16 * flush:
                    yield split(pd.concat(held.pop(part)))
                    del size[part]
        for rows in held.values():
            yield split(pd.concat(rows))

    return packed.repartition(shuffle_partitions(packed.sparkSession), "part").sortWithinPartitions("part").mapInPandas(trimmed(deal), schema.replace("part int", "part int, fine int"))


def as_text(df: DataFrame, *ids: str) -> DataFrame:
    """``df`` with ``ids`` as text, for a way through pandas, which makes a column of
    64-bit integers with a null one of doubles; cast them back behind it."""
    return df.withColumns({c: F.col(c).cast("string") for c in ids})


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranked(df: DataFrame, keys: list[str], order: list[str], per_key: DataFrame | None = None, salts: int = 256, ties: list[str] | None = None) -> DataFrame:
    """``df`` with ``rank``: 0, 1, ... within each combination of ``keys``.

    The order within a group is (salt, ``order``), the salt being a hash of
    ``order``: pseudo-random but the same in every run. A group is split over
    ``salts`` windows, so one key may hold a third of all rows; only counts for
    each key and salt are summed by key. ``keys`` must not be null. Columns of
    ``per_key`` (unique in ``keys``) are joined on the way. Rows that are equal in
    ``order`` stand in that of ``ties``.
    """
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    before = Window.partitionBy(*keys).orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        salted.groupBy(*keys, "_salt")
        .agg(F.count("*").alias("_n"))
        .withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0)))
        .drop("_n")
    )
    if per_key is not None:
        base = base.join(per_key, keys, "left")
    within = Window.partitionBy(*keys, "_salt").orderBy(*order, *(ties or []))
    return (
        salted.withColumn("_at", F.row_number().over(within) - 1)
        .join(base, [*keys, "_salt"])
        .withColumn("rank", (F.col("_base") + F.col("_at")).cast("long"))
        .drop("_salt", "_at", "_base")
    )


def numbered(df: DataFrame, keys: list[str], order: list[str], label: str) -> DataFrame:
    """``df`` with ``rank``: 0, 1, ... in ``order`` within each combination of ``keys``.

    Rows are dealt by ranges of (keys, order), so a group that holds a third of all
    rows lies in many tasks; only counts for each key and task are summed by key.
    ``df`` should be stored (ranges are sampled) and ``keys`` must not be null.
    """
    dealt = stored(df.repartitionByRange(shuffle_partitions(df.sparkSession), *keys, *order).withColumn("_part", F.spark_partition_id()), label)
    before = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    base = dealt.groupBy(*keys, "_part").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    at = F.row_number().over(Window.partitionBy(*keys, "_part").orderBy(*order)) - 1
    return dealt.withColumn("_at", at).join(base, [*keys, "_part"]).withColumn("rank", (F.col("_base") + F.col("_at")).cast("long")).drop("_part", "_at", "_base")


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], weight: str) -> DataFrame:
    """Left join of ``rows`` with ``table``, unique in ``keys``, without shuffling a
    hot key. ``weight``: how many of ``rows`` an entry meets. Entries that meet over
    a thousandth of what all meet are fewer than a thousand, so those are broadcast.
    ``rows`` should be stored: it is read twice."""
    total = table.agg(F.sum(weight)).first()[0] or 0
    limit = max(2, total // 1000)
    hot = rows.join(F.broadcast(table.filter(F.col(weight) > limit).withColumn("_hot", F.lit(True))), keys, "left")
    names = [c for c in table.columns if c not in keys]
    cold = hot.filter("_hot is null").drop("_hot", *names).join(table.filter(F.col(weight) <= limit), keys, "left")
    return hot.filter("_hot").drop("_hot").unionByName(cold)


def components(edges: DataFrame, label: str = "components", rounds: int = 50) -> DataFrame:
    """(node, component) for the nodes of ``edges`` (a, b); component is the
    smallest node reachable.

    Alternates the two star operations on edges (large: neighbours above a node
    move to its least neighbour; small: neighbours below do), which reaches
    stars in a logarithmic number of rounds; each round is stored, and rounds end
    when no edge changes. The edge count never grows by more than the nodes.
    """
    e = stored(
        edges.filter(F.col("a") != F.col("b"))
        .select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        .distinct(),
        label,
    )
    seen = None
    for _ in range(rounds):
        both = e.union(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").filter(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u != v").distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = (
            large.join(lower, "u")
            .select(F.explode(F.array(F.struct(F.col("u"), F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("x"))
            .select("x.u", "x.v")
            .filter("u != v")
            .distinct()
        )
        e = stored(small, label)
        now = e.agg(F.count("*"), F.coalesce(F.bit_xor(F.xxhash64("u", "v")), F.lit(0))).first()
        if tuple(now) == seen:
            break
        seen = tuple(now)
    else:
        raise RuntimeError("components did not settle")
    stars = e.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    return stars.union(e.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
