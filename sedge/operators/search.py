"""Exact cosine search within a tenant: the k best above a threshold."""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.functions import columns as C
from sedge.operators import cells

#: Most queries that are broadcast; more are joined to the chunks.
QUERY_BLOCK = 4096


def search(vector: list[float], chunks: DataFrame, files: DataFrame, user_id: str, k: int = 10, threshold: float = 0.3) -> DataFrame:
    """id, content, metadata, file, similarity for one vector, best first.

    Similarity in double precision; strictly above the threshold; ties by chunk id;
    zero vectors are never hits. ``chunks`` may carry the owner in ``user_id``, which
    then cuts the scan; else the owner's files do.
    """
    own = files.filter(F.col("user_id") == user_id).select(F.col("id").alias("file_id"), F.struct("id", "name", "type").alias("file"))
    mine = chunks.filter(F.col("user_id") == user_id).drop("user_id") if "user_id" in chunks.columns else chunks
    query = F.array(*[F.lit(float(x)) for x in vector])
    hits = mine.join(own, "file_id").withColumn("similarity", C.cosine("embeddings", query)).filter(F.col("similarity") > threshold)
    return hits.select("id", "content", "metadata", "file", "similarity").orderBy(F.col("similarity").desc(), "id").limit(k)


def search_many(queries: DataFrame, chunks: DataFrame, k: int = 10, threshold: float = 0.3) -> DataFrame:
    """query_id, id, similarity, rank for many queries at once.

    ``queries``: query_id, user_id, vector; ``chunks``: id, user_id, embeddings. Up to
    ``QUERY_BLOCK`` queries are broadcast; every task keeps its k best for each query, so
    what is shuffled doesn't grow with the chunks of a task. More stay a table and are
    joined as by ``search_joined``, so no task holds more than blocks of both.
    """
    spark = chunks.sparkSession
    block = cells.usable(queries.select("query_id", "user_id", "vector"), "vector").select("query_id", "user_id", "vector").limit(QUERY_BLOCK + 1).collect()
    if len(block) > QUERY_BLOCK:
        return search_joined(queries, chunks, k, threshold)
    kinds = f"query_id {dict(queries.dtypes)['query_id']}, id long, similarity double"
    if not block:
        return spark.createDataFrame([], f"{kinds}, rank int")
    ids, users, q = [r["query_id"] for r in block], np.array([r["user_id"] for r in block], dtype=object), [np.array(r["vector"]) for r in block]
    shared = spark.sparkContext.broadcast((ids, users, q))

    def best(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids, users, q = shared.value
        held: dict[int, list[tuple[float, int]]] = {}
        for batch in batches:
            for user, some in batch.groupby("user_id"):
                mine = np.flatnonzero(users == user)
                if not len(mine):
                    continue
                some = some.sort_values("id")
                own, asked = some["id"].to_numpy(), np.stack([q[i] for i in mine])
                for first in range(0, len(own), cells.BLOCK):
                    x = np.stack(some["embeddings"].iloc[first : first + cells.BLOCK])
                    for i, hit, cosine in cells.nearest(x, asked, k, threshold):
                        if len(hit):
                            held[mine[i]] = heapq.nsmallest(k, [*held.get(mine[i], []), *zip(-cosine, own[first + hit], strict=True)])
        out = [(ids[i], int(own_id), -float(s)) for i, some in held.items() for s, own_id in some]
        yield pd.DataFrame(out, columns=["query_id", "id", "similarity"])

    found = cells.usable(chunks.select("id", "user_id", "embeddings"), "embeddings").drop("size").mapInPandas(best, kinds)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def search_joined(queries: DataFrame, chunks: DataFrame, k: int = 10, threshold: float = 0.3) -> DataFrame:
    """The same as ``search_many`` for any number of queries, joined by tenant.

    A tenant's chunks and queries meet in blocks of some thousands, each of which keeps
    its k best for each query, so neither a tenant nor the pairs lie in one task.
    """
    found = cells.in_blocks(queries, chunks, k, threshold)
    order = Window.partitionBy("query_id").orderBy(F.col("similarity").desc(), "id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
