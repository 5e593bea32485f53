"""Exact search that leaves out what can't be a hit: cells with centres and radii.

Every vector belongs to the cell of its nearest centre; a cell of a tenant has as its radius
the largest angle to the centre. Angles obey the triangle inequality, so a query's angle to
the centre less the radius bounds how near any vector of the cell can be. A query meets the
nearest cells that hold k vectors first, then only those that may beat the k-th best.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from math import acos

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Most centres, which are broadcast, and rows of a block of chunks and of queries.
CENTRES, BLOCK = 1024, 4096
#: Vectors that are multiplied with a block, or with all centres, at once.
STEP = 256
#: What angles, and cosines from a matrix product, may be off by rounding.
SLACK, ROUNDING = 1e-6, 1e-9
_CELL = ["user_id", "size", "cell"]


@dataclass
class Index:
    """members: id, user_id, size, cell, embeddings; cells: user_id, size, cell, radius, members."""

    members: DataFrame
    cells: DataFrame
    centres: dict[int, np.ndarray]


def usable(df: DataFrame, vector: str) -> DataFrame:
    """Rows with an owner and a finite vector that isn't zero, as doubles, with its size."""
    v = F.transform(vector, lambda x: x.cast("double"))
    fine = F.col("user_id").isNotNull() & F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(vector, lambda x: x != 0)
    return df.filter(fine).withColumn(vector, v).withColumn("size", F.size(vector))


def _units(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    whole = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    x = whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _angles(rows: DataFrame, vector: str, centres: dict[int, np.ndarray], all_of_them: bool) -> DataFrame:
    """``rows`` with ``near``: the nearest centre's number and angle, or the angles to all."""
    shared = rows.sparkSession.sparkContext.broadcast(centres)  # CENTRES vectors
    kind = "angles array<double>" if all_of_them else "cell int, angle double"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for some in (batch.slice(at, STEP) for batch in batches for at in range(0, len(batch), STEP)):
            sizes = np.asarray(some.column("size"))
            for n in np.unique(sizes):
                own = some.filter(pa.array(sizes == n))
                found = _units(own.column(vector)) @ shared.value[int(n)].T
                found = np.arccos(np.clip(found, -1, 1, out=found), out=found)
                cell = found.argmin(axis=1)
                more = [pa.FixedSizeListArray.from_arrays(pa.array(found.ravel()), found.shape[1]).cast(pa.list_(pa.float64()))] if all_of_them else [pa.array(cell, pa.int32()), pa.array(found[np.arange(len(cell)), cell])]
                yield pa.RecordBatch.from_arrays([*own.columns, *more], [*own.schema.names, *[c.split()[0] for c in kind.split(", ")]])

    plain = ", ".join(f"{name} {t}" for name, t in rows.dtypes)
    return rows.filter(F.col("size").isin(*centres)).mapInArrow(measure, f"{plain}, {kind}")


def build(chunks: DataFrame, centres: int | None = None) -> Index:
    """Index of ``chunks`` (id, user_id, embeddings; other columns are left out).

    Rows without an owner and null, zero and non-finite vectors are never hits and not in
    it. Centres are a sample of the vectors, chosen by hash: twice the root of their number,
    ``CENTRES`` at most; each length that the sample lacks has one axis for a centre.
    """
    rows = usable(chunks.select("id", "user_id", "embeddings"), "embeddings")
    many = centres or int(min(CENTRES, max(8, 2 * rows.count() ** 0.5)))
    sample = rows.select("size", "embeddings").orderBy(F.xxhash64("id", "embeddings")).limit(many).collect()
    by_size = {r["size"]: [np.eye(1, r["size"])[0]] for r in rows.select("size").distinct().collect()}  # a row for each length
    for n in by_size:
        if own := [r["embeddings"] for r in sample if r["size"] == n]:
            x = np.unique(np.array(own), axis=0)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            by_size[n] = x / np.linalg.norm(x, axis=1, keepdims=True)
    held = {n: np.array(x) for n, x in by_size.items()}
    if not held:
        none = rows.withColumn("cell", F.lit(0))
        return Index(none, none.groupBy(*_CELL).agg(F.max(F.lit(0.0)).alias("radius"), F.count("*").alias("members")), {})
    near = _angles(rows, "embeddings", held, False)
    return Index(near.drop("angle"), near.groupBy(*_CELL).agg(F.max("angle").alias("radius"), F.count("*").alias("members")), held)


def write(index: Index, path: str) -> None:
    """The index as Parquet, parted by cell, so that cells without a query aren't read."""
    spark = index.members.sparkSession
    index.members.repartition("cell", F.pmod(F.xxhash64("id"), F.lit(8))).sortWithinPartitions("cell", "user_id").write.mode("overwrite").partitionBy("cell").parquet(f"{path}/members")
    index.cells.write.mode("overwrite").parquet(f"{path}/cells")
    rows = [(n, i, [float(v) for v in x]) for n, own in index.centres.items() for i, x in enumerate(own)]
    spark.createDataFrame(rows, "size int, number int, centre array<double>").coalesce(1).write.mode("overwrite").parquet(f"{path}/centres")


def read(spark: SparkSession, path: str) -> Index:
    centres: dict[int, list] = {}
    for r in spark.read.parquet(f"{path}/centres").orderBy("size", "number").collect():  # CENTRES vectors
        centres.setdefault(r["size"], []).append(r["centre"])
    return Index(spark.read.parquet(f"{path}/members"), spark.read.parquet(f"{path}/cells"), {n: np.array(x) for n, x in centres.items()})


def _bounds(queries: DataFrame, index: Index, threshold: float) -> DataFrame:
    """query_id, user_id, size, cell, members, near (the least possible angle), before (vectors
    in nearer cells): the cells that may hold a hit for each query."""
    asked = _angles(queries, "vector", index.centres, True).drop("vector")
    far = acos(max(-1.0, min(1.0, threshold))) + SLACK
    met = asked.join(index.cells, ["user_id", "size"]).withColumn("near", F.greatest(F.lit(0.0), F.element_at("angles", F.col("cell") + 1) - F.col("radius"))).drop("angles", "radius").filter(F.col("near") <= far)
    order = Window.partitionBy("query_id").orderBy("near", "cell").rowsBetween(Window.unboundedPreceding, -1)
    return met.withColumn("before", F.coalesce(F.sum("members").over(order), F.lit(0)))


def _vectors(column: pa.ChunkedArray) -> np.ndarray:
    whole = column.combine_chunks()
    if len(pc.unique(pc.list_value_length(whole))) > 1:
        raise ValueError("vectors of unlike length")
    return whole.flatten().to_numpy(zero_copy_only=False).reshape(len(whole), -1)


def _lengths(x: np.ndarray) -> np.ndarray:
    """Norms, summed from the first component to the last like every sum here that decides: equal vectors get equal ones."""
    return np.sqrt(np.cumsum(x * x, axis=1)[:, -1])


def nearest(x: np.ndarray, q: np.ndarray, k: int, threshold: float) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For each row of ``q`` its number, and places and cosines of the k best rows of ``x``; of equal cosines the first.

    A matrix product, whose rounding depends on a row's place, finds what may be among the
    k best; their cosines are then summed as ``columns.cosine`` does.
    """
    if x.shape[1] != q.shape[1]:
        raise ValueError("vectors of unlike length")
    with np.errstate(over="ignore", invalid="ignore"):
        far, wide = _lengths(x), _lengths(q)
    mine = np.flatnonzero((far > 0) & np.isfinite(far))
    x, far = x[mine], far[mine]
    units = x / far[:, None]
    for first in range(0, len(q) if len(x) else 0, STEP):
        with np.errstate(all="ignore"):
            found = (q[first : first + STEP] / wide[first : first + STEP, None]) @ units.T
        least = np.partition(found, len(x) - k, axis=1)[:, len(x) - k] if len(x) > k else np.full(len(found), -np.inf)
        for i, own in enumerate(found, first):
            near = np.flatnonzero(own >= max(threshold, least[i - first]) - ROUNDING)
            if len(near):
                with np.errstate(all="ignore"):
                    cosine = np.cumsum(x[near] * q[i], axis=1)[:, -1] / (far[near] * wide[i])
                hit = np.flatnonzero(cosine > threshold)
                hit = hit[np.argsort(-cosine[hit], kind="stable")[:k]]
                yield i, mine[near[hit]], cosine[hit]


def _best(k: int, threshold: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    """For ``applyInArrow``: the k best chunks of a block for each query of a block, ties by id."""

    def best(chunks: pa.Table, asked: pa.Table) -> pa.Table:
        at, of, s = [], [], []
        if chunks.num_rows and asked.num_rows:
            chunks = chunks.take(pc.sort_indices(chunks, sort_keys=[("id", "ascending")], null_placement="at_start"))
            for i, hit, cosine in nearest(_vectors(chunks["embeddings"]), _vectors(asked["vector"]), k, threshold):
                at.append(hit)
                of.append(np.full(len(hit), i))
                s.append(cosine)
        whole = lambda parts, kind: pa.array(np.concatenate([np.empty(0, kind), *parts]))
        return pa.table({"query_id": asked["query_id"].take(whole(of, np.int64)), "id": chunks["id"].take(whole(at, np.int64)), "similarity": whole(s, np.float64)})

    return best


def _each(n: str) -> Column:
    return F.explode(F.sequence(F.lit(0), F.col(n) - 1))


def _dealt(c: str, n: str) -> Column:
    return F.pmod(F.xxhash64(c), F.col(n)).cast("int")


def _compared(left: DataFrame, right: DataFrame, key: list[str], k: int, threshold: float) -> DataFrame:
    """query_id, id, similarity: the k best of ``left`` (``key``, id, embeddings) for each of ``right`` (``key``, query_id, vector) where ``key`` is the same."""
    left, right = left.toDF(*left.columns), right.toDF(*right.columns)  # both may come from the same scan
    kinds = {**dict(left.dtypes), **dict(right.dtypes)}
    return left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(_best(k, threshold), f"query_id {kinds['query_id']}, id {kinds['id']}, similarity double")


def _met(pairs: DataFrame, queries: DataFrame, index: Index, k: int, threshold: float) -> DataFrame:
    """query_id, id, similarity: the k best of each query in each block of the cells it meets.

    A cell is dealt into blocks of about ``BLOCK`` chunks and its queries into blocks of about as many, so no group is large.
    """
    loads = pairs.groupBy(*_CELL).agg(F.ceil(F.max("members") / BLOCK).cast("int").alias("parts"), F.ceil(F.count("*") / BLOCK).cast("int").alias("turns"))
    left = index.members.join(loads, _CELL).withColumn("part", _dealt("id", "parts")).withColumn("turn", _each("turns")).drop("parts", "turns")
    right = pairs.select("query_id", *_CELL).join(loads, _CELL).withColumn("turn", _dealt("query_id", "turns")).withColumn("part", _each("parts")).drop("parts", "turns").join(queries.select("query_id", "vector"), "query_id")
    return _compared(left, right, [*_CELL, "part", "turn"], k, threshold)


def in_blocks(queries: DataFrame, chunks: DataFrame, k: int, threshold: float) -> DataFrame:
    """query_id, id, similarity: the k best of each query in each block of its tenant's chunks, without an index.

    Tenants of more than ``BLOCK`` chunks or queries are dealt into blocks of about as many; they are few, and broadcast.
    Rows that no index would hold are left out; unlike lengths in a tenant are an error.
    """
    left, right = (usable(df, v).drop("size") for df, v in ((chunks.select("id", "user_id", "embeddings"), "embeddings"), (queries.select("query_id", "user_id", "vector"), "vector")))
    own, asked = (df.groupBy("user_id").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias(n)) for df, n in ((left, "parts"), (right, "turns")))
    large = F.broadcast(own.join(asked, "user_id", "full").fillna(0, ["parts", "turns"]).filter("parts > 1 OR turns > 1"))
    one = {n: F.coalesce(n, F.lit(1)) for n in ("parts", "turns")}
    left, right = (df.join(large, "user_id", "left").withColumns(one).filter("parts > 0 AND turns > 0") for df in (left, right))
    left = left.withColumn("part", _dealt("id", "parts")).withColumn("turn", _each("turns")).drop("parts", "turns")
    right = right.withColumn("turn", _dealt("query_id", "turns")).withColumn("part", _each("parts")).drop("parts", "turns")
    return _compared(left, right, ["user_id", "part", "turn"], k, threshold)


def _plans(queries: DataFrame, index: Index, k: int, threshold: float) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The pairs of the first turn, its hits, and the pairs of the second."""
    bounds = _bounds(queries, index, threshold)
    first = bounds.filter(F.col("before") < k)
    hits = _met(first, queries, index, k, threshold)
    least = hits.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list("similarity"), asc=False), 1, k).alias("best")).filter(F.size("best") == k).select("query_id", F.acos(F.least(F.lit(1.0), F.array_min("best"))).alias("enough"))
    second = bounds.filter(F.col("before") >= k).join(least, "query_id", "left").filter(F.col("enough").isNull() | (F.col("near") <= F.col("enough") + SLACK)).drop("enough")
    return first, hits, second


def search(queries: DataFrame, index: Index, k: int = 10, threshold: float = 0.3) -> DataFrame:
    """query_id, id, similarity, rank: the rows of ``search.search_many``, ties by id.

    ``queries``: query_id (unique; null ones have no hits), user_id, vector. Queries are a
    table of Spark throughout; cells without one aren't read from a written index.
    """
    asked = usable(queries.filter("query_id is not null").select("query_id", "user_id", "vector"), "vector")
    if not index.centres:
        return index.members.select("id").join(asked.select("query_id"), F.lit(False)).select("query_id", "id", F.lit(0.0).alias("similarity"), F.lit(1).alias("rank"))
    _, hits, second = _plans(asked, index, k, threshold)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return hits.unionByName(_met(second, asked, index, k, threshold)).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def compared(queries: DataFrame, index: Index, k: int = 10, threshold: float = 0.3) -> DataFrame:
    """query_id, cells, vectors, of_all: how much each query meets of its tenant's vectors of its length."""
    asked = usable(queries.filter("query_id is not null").select("query_id", "user_id", "vector"), "vector")
    first, _, second = _plans(asked, index, k, threshold)
    met = first.unionByName(second).groupBy("query_id").agg(F.count("*").alias("cells"), F.sum("members").alias("vectors"))
    whole = asked.select("query_id", "user_id", "size").join(index.cells.groupBy("user_id", "size").agg(F.sum("members").alias("of_all")), ["user_id", "size"])
    return whole.join(met, "query_id", "left").select("query_id", F.coalesce("cells", F.lit(0)).alias("cells"), F.coalesce("vectors", F.lit(0)).alias("vectors"), "of_all")
