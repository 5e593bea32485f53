"""Clusters of integer vectors around centroids, exact in every step.

Vectors become integers and are stored in blocks. A block is compared with all centroids
through |x|^2 - 2 x.c + |c|^2, a matrix product in doubles, where no number in it can reach
2^53; then all of it is exact. Blocks with larger numbers are compared in 64-bit integers,
and those beyond in integers without a bound. Sums of a cluster are integers without a
bound, added block by block in an RDD's tree aggregation.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.shared import stored, trimmed

#: Rows that are compared at once.
ROWS = 4096
#: Doubles hold every integer up to the first bound, and 64-bit sums stay right up to the second.
EXACT, LONG = 1 << 53, 1 << 62
BLOCKS = "vec_ids array<long>, bytes int, data binary"


def integers(x: float, scale: int) -> int:
    """floor(scale * x), exactly."""
    n, d = x.as_integer_ratio()
    return n * scale // d


def quantised(batches: Iterator[pa.RecordBatch], dim: int, scale: int) -> Iterator[pa.RecordBatch]:
    """Blocks of (vec_id, vector): as 2, 4 or 8 byte integers, or as decimal text (0)."""
    for batch in batches:
        ids, rows = batch.column(0), batch.column(1)
        values = rows.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        with np.errstate(over="ignore"):
            scaled = np.floor(values * scale)  # a power of two: nothing is rounded
        most = np.abs(scaled).max(axis=1, initial=0.0)
        for low, high, size in ((0.0, 2.0**15, 2), (2.0**15, 2.0**31, 4), (2.0**31, 2.0**62, 8), (2.0**62, math.inf, 0)):
            some = np.flatnonzero((most >= low) & ((most < high) | (size == 0)))
            if len(some):
                data = scaled[some].astype(f"<i{size}").tobytes() if size else "\n".join(" ".join(str(integers(x, scale)) for x in v) for v in values[some].tolist()).encode()
                own = ids.take(pa.array(some))
                lists = pa.ListArray.from_arrays(pa.array([0, len(own)], pa.int32()), own)
                yield pa.RecordBatch.from_arrays([lists, pa.array([size], pa.int32()), pa.array([data], pa.binary())], ["vec_ids", "bytes", "data"])


def rows_of(size: int, data: bytes, dim: int) -> np.ndarray:
    if size:
        return np.frombuffer(data, f"<i{size}").reshape(-1, dim)
    return np.array([[int(x) for x in line.split()] for line in bytes(data).decode().split("\n")], dtype=object).reshape(-1, dim)


def _most(x: np.ndarray) -> int:
    return max(abs(int(x.max())), abs(int(x.min()))) if x.size else 0


def nearest(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The number of the nearest of ``centroids`` (the smaller of equals) and the squared distance to it.

    ``centroids`` holds Python integers.
    """
    worst = x.shape[1] * (_most(x) + _most(centroids)) ** 2
    if worst < EXACT:
        a, c = x.astype(np.float64), centroids.astype(np.float64)
        squares = (a * a).sum(axis=1)[:, None] - 2 * (a @ c.T) + (c * c).sum(axis=1)
    else:
        kind = np.int64 if worst < LONG else object
        a, c = x.astype(kind), centroids.astype(kind)
        squares = np.stack([((a - own) ** 2).sum(axis=1) for own in c], axis=1)
    best = squares.argmin(axis=1)
    found = squares[np.arange(len(x)), best]
    return best, found.astype(np.int64) if worst < LONG else found


def sums_of(x: np.ndarray, best: np.ndarray, k: int) -> np.ndarray:
    """For each centroid the sum of its vectors, as Python integers."""
    most = _most(x) * max(len(x), 1)
    kind = np.int64 if most < LONG else object
    if most < EXACT:
        member = (best == np.arange(k)[:, None]).astype(np.float64)
        return (member @ x.astype(np.float64)).astype(np.int64).astype(object)
    return np.stack([x[best == j].astype(kind).sum(axis=0) for j in range(k)]).astype(object)


def blocks_of(vectors: DataFrame, dim: int = 64, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """(kept, blocks): the usable rows as (vec_id, v), and their stored integer blocks."""
    if scale & (scale - 1):
        raise ValueError("scale must be a power of two")
    v = F.col(vector_col).cast("array<double>")
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    kept = rows.filter((F.size("v") == dim) & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))))
    return kept, stored(kept.mapInArrow(trimmed(lambda batches: quantised(batches, dim, scale)), BLOCKS), "centroid-blocks")


def round_of(blocks: DataFrame, centroids: np.ndarray, dim: int) -> tuple[np.ndarray, list[int]]:
    """Sums and numbers of the vectors of each centroid."""
    k = len(centroids)

    def add(total: tuple, row: tuple) -> tuple:
        sums, counts = total
        x = rows_of(row[0], row[1], dim)
        for i in range(0, len(x), ROWS):
            best, _ = nearest(x[i : i + ROWS], centroids)
            sums = sums + sums_of(x[i : i + ROWS], best, k)
            counts = [a + b for a, b in zip(counts, np.bincount(best, minlength=k).tolist(), strict=True)]
        return sums, counts

    def merge(a: tuple, b: tuple) -> tuple:
        return a[0] + b[0], [x + y for x, y in zip(a[1], b[1], strict=True)]

    return blocks.select("bytes", "data").rdd.treeAggregate((np.zeros((k, dim), dtype=object), [0] * k), add, merge)


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256 for each kept vector.

    Kept are vectors of exactly ``dim`` components, none null or not finite; each component
    x becomes floor(``scale`` * x). The first centroids are the kept vectors with the ``k``
    smallest SHA-256 of ``seed:vec_id``, as hexadecimal text, all kept ones if they are fewer.
    A round puts each vector to the nearest centroid (squared distance, then the smaller
    number) and moves each centroid that has vectors to the floor of their mean; then vectors
    are put once more. Rows that repeat an id are vectors of their own; a null id is never a
    first centroid, and where all ids are null nothing is returned. Distances and sums of
    them that 64 bits can't hold are null. Without kept vectors the result is empty; other
    columns are ignored.
    """
    spark = vectors.sparkSession
    kept, blocks = blocks_of(vectors, dim, scale, id_col, vector_col)
    named = kept.filter("vec_id is not null").withColumn("h", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256))
    first = named.orderBy("h", "v").limit(k).collect()  # k vectors
    out = "vec_id long, cluster int, distance long"
    if not first:
        return spark.createDataFrame([], f"{out}, cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = np.array([[integers(x, scale) for x in r["v"]] for r in first], dtype=object)
    for _ in range(rounds):
        sums, counts = round_of(blocks, centroids, dim)
        centroids = np.array([[s // n for s in own] if n else old for own, n, old in zip(sums.tolist(), counts, centroids.tolist(), strict=True)], dtype=object)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, size, data in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                x = rows_of(size.as_py(), data.as_py(), dim)
                for i in range(0, len(x), ROWS):
                    best, squares = nearest(x[i : i + ROWS], centroids)
                    if squares.dtype == object:
                        squares = [d if d < 1 << 63 else None for d in squares.tolist()]
                    yield pa.RecordBatch.from_arrays([ids.values.slice(i, len(best)), pa.array(best, pa.int32()), pa.array(squares, pa.int64())], ["vec_id", "cluster", "distance"])

    assigned = stored(blocks.mapInArrow(trimmed(put), out), "centroid-assigned")
    exact = F.sum(F.col("distance").cast("decimal(38,0)"))
    per = {r["cluster"]: int(r["own"]) if not r["lost"] else None for r in assigned.groupBy("cluster").agg(exact.alias("own"), F.count_if(F.col("distance").isNull()).alias("lost")).collect()}  # k rows
    total = None if None in per.values() else sum(per.values())
    fits = lambda n: n if n is not None and n < 1 << 63 else None
    rows = [(j, fits(own), fits(total), hashlib.sha256(",".join(map(str, centroids[j])).encode()).hexdigest()) for j, own in per.items()]
    return assigned.join(F.broadcast(spark.createDataFrame(rows, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
