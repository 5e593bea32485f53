"""Near-duplicate vectors through a pivot-permutation index.

Every vector is described by its ordered nearest reference points. Two vectors are
candidates if they share two pivots or more among those. For each pivot there is an
inverted list of the vectors that have it; long lists are parted by the other pivots
that a pair may share, so their length stays about the same as the table grows. Lists are
worked through in blocks of bounded size; shared pivots are counted there, a pair is
verified in double precision in the one list that its two first shared pivots name, and only
sums and a spanning forest leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from sedge.llm.shared import components, looked_up, stored, trimmed

#: Reference points of a small table (four for each root of the rows of a larger one, up to
#: MOST), how many nearest ones describe a vector, and rows of a block.
PIVOTS, MOST, NEAREST, BLOCK = 128, 8192, 8, 1024
#: Vectors for each pivot from which pivots are picked.
SAMPLE = 4


def unit(rows: list) -> np.ndarray:
    """Rows of length 1. Each is scaled by a power of two first, which is exact and keeps
    squares of huge and tiny numbers within doubles."""
    x = np.array([np.asarray(r, dtype=np.float64) for r in rows])
    x = np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def spread(sample: np.ndarray, n: int) -> np.ndarray:
    """``n`` rows of ``sample``, each the least similar to those before it."""
    chosen, most = [0], sample @ sample[0]
    while len(chosen) < min(n, len(sample)):
        chosen.append(int(most.argmin()))
        most = np.maximum(most, sample @ sample[chosen[-1]])
    return sample[chosen]


def nearest(x: np.ndarray, pivots: np.ndarray, k: int) -> np.ndarray:
    """For each row the numbers of its ``k`` nearest pivots, nearest first."""
    far = -(x @ pivots.T)
    if k < far.shape[1]:
        some = np.sort(np.argpartition(far, k - 1, axis=1)[:, :k], axis=1)
        order = np.argsort(np.take_along_axis(far, some, axis=1), axis=1, kind="stable")
        return np.take_along_axis(some, order, axis=1)
    return np.argsort(far, axis=1, kind="stable")


def lists_of(order: np.ndarray, parts: int) -> list[int]:
    """The lists that a vector enters: its pivot p, and the part of a pivot q > p that a
    partner may share too, as p * parts + part."""
    own = sorted(order)
    return sorted({int(p) * parts + int(q) % parts for i, p in enumerate(own) for q in own[i + 1 :]})


def linked_in(x: np.ndarray, order: np.ndarray, name: int, parts: int, cosine: float, side: np.ndarray) -> np.ndarray:
    """The boolean matrix of verified pairs that list ``name`` owns.

    It owns a pair if the first two pivots that both have say so. ``side``: the block of
    each row; with two blocks only pairs between them count.
    """
    linked = np.triu(x @ x.T >= cosine, 1)
    if len(np.unique(side)) > 1:
        linked &= side[:, None] != side[None, :]
    own = np.sort(order, axis=1)
    one, two = np.nonzero(linked)
    for at in range(0, len(one), 1 << 17):
        i, j = one[at : at + (1 << 17)], two[at : at + (1 << 17)]
        shared = (own[i][:, :, None] == own[j][:, None, :]).any(axis=2)
        first = shared.argmax(axis=1)
        rest = shared.copy()
        rest[np.arange(len(i)), first] = False
        second = rest.argmax(axis=1)
        p, q = own[i, first], own[i, second]
        linked[i, j] = rest.any(axis=1) & (p * parts + q % parts == name)
    return linked | linked.T


def forest(linked: np.ndarray) -> np.ndarray:
    """A parent for each row, -1 for roots: a spanning forest."""
    parent, seen = np.full(len(linked), -1), np.zeros(len(linked), dtype=bool)
    for root in np.flatnonzero(linked.any(axis=1)):
        if seen[root]:
            continue
        seen[root], stack = True, [root]
        while stack:
            at = stack.pop()
            new = np.flatnonzero(linked[at] & ~seen)
            seen[new], parent[new] = True, at
            stack += new.tolist()
    return parent


def near_duplicates(vectors: DataFrame, cosine: float = 0.9, id_col: str = "vec_id", vector_col: str = "embedding", pivots: int | None = None, k: int = NEAREST) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of ``vectors``.

    Vectors link at a cosine of ``cosine`` or more in double precision, if they
    share two of their ``k`` nearest pivots (measured recall: see the tests and
    the README; equal vectors always link). Vectors of unlike length never link;
    null, empty, zero and non-finite ones, or with a null inside, link with
    nothing. n_links counts the other rows linked directly, component_id is the
    smallest vec_id reachable (null after all others), kept marks that row. Rows that
    repeat a vec_id are vectors of their own, each counted as a link of the other if
    they link. Empty tables give empty results; other columns are ignored. Equal
    vectors are told apart from others by 96 bits of hash.

    The index is fitted on a bounded sample: ``SAMPLE`` vectors for each of ``pivots``
    (by default 4 times the root of the number of different vectors, from ``PIVOTS`` to
    ``MOST``) of all lengths together, chosen by hash; every vector is indexed. A
    length without a vector in the sample has one pivot only, at the origin, and its
    vectors, few beside the others, meet all in one list.
    """
    spark = vectors.sparkSession
    kind = "float" if vectors.schema[vector_col].dataType == ArrayType(FloatType()) else "double"
    value = F.transform(F.col(vector_col), lambda v: v.cast(kind) + F.lit(0.0).cast(kind))
    good = F.col(vector_col).isNotNull() & ~F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists("v", lambda x: x != 0)
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col), value.alias("v")).withColumn("good", F.coalesce(good, F.lit(False)))
    keyed = rows.select("vec_id", "good", "v", F.xxhash64("v").alias("h1"), F.hash("v").alias("h2"))
    ids = stored(keyed.select("vec_id", "good", F.when(F.col("good"), F.col("h1")).alias("h1"), F.when(F.col("good"), F.col("h2")).alias("h2")), "pivot-ids")
    grouped = keyed.filter("good").groupBy("h1", "h2").agg(F.min("vec_id").alias("least_id"), F.count("*").alias("copies"), F.first("v").alias("v"))
    # an id may repeat, so classes have numbers, fixed when they are written
    classes = stored(grouped.withColumn("class_id", F.monotonically_increasing_id()), "pivot-classes")

    total = classes.count()
    many = pivots or int(min(MOST, max(PIVOTS, 4 * total**0.5)))
    parts = max(1, -(-k * (k - 1) // 2 * total // (many * BLOCK)))
    position = F.pmod(F.xxhash64("h1", "h2"), F.lit(1 << 30)) / float(1 << 30)
    # half as many again, so that there are enough; then the least
    sample = classes.filter(position < 1.5 * SAMPLE * many / max(1, total)).orderBy(position, "class_id").limit(SAMPLE * many).select("v").collect()
    by_length: dict[int, list] = {}
    for r in sample:
        by_length.setdefault(len(r["v"]), []).append(r["v"])
    shared = spark.sparkContext.broadcast({n: spread(unit(own), max(2, many * len(own) // len(sample))) for n, own in by_length.items()})  # ``many`` vectors

    def index(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for n, some in batch.groupby(batch["v"].map(len)):
                own = shared.value.get(n)
                order = nearest(unit(list(some["v"])), own, k) if own is not None and len(own) > 1 else None
                for i, class_id in enumerate(some["class_id"]):
                    near = order[i].tolist() if order is not None else [0, 1]
                    out.append((class_id, n, near, lists_of(near, parts)))
            yield pd.DataFrame(out, columns=["class_id", "size", "near", "lists"])

    indexed = stored(classes.select("class_id", "v").mapInPandas(trimmed(index), "class_id long, size int, near array<int>, lists array<long>"), "pivot-index")
    entries = stored(indexed.select("class_id", "size", F.explode("lists").alias("list")), "pivot-entries")
    lengths = stored(entries.groupBy("size", "list").agg(F.count("*").alias("members")).filter("members > 1"), "pivot-lengths")
    met = looked_up(entries, lengths, ["size", "list"], "members").filter("members is not null").withColumn("blocks", F.ceil(F.col("members") / BLOCK).cast("int"))
    dealt = met.withColumn("side", F.pmod(F.xxhash64("class_id"), F.col("blocks")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("class_id", "size", "list", "side", F.least("side", "other").alias("one"), F.greatest("side", "other").alias("two"))
    described = dealt.join(indexed.select("class_id", "near"), "class_id").join(classes.select("class_id", "copies", "v"), "class_id")

    def verify(group: pd.DataFrame) -> pd.DataFrame:
        x = unit(list(group["v"]))
        linked = linked_in(x, np.stack(group["near"]), int(group["list"].iloc[0]), parts, cosine, group["side"].to_numpy())
        parent, ids_, n = forest(linked), group["class_id"].to_numpy(), linked @ group["copies"].to_numpy(dtype=np.int64)
        some = np.flatnonzero(n)
        return pd.DataFrame({"class_id": ids_[some], "links": n[some], "parent": pd.array([int(ids_[parent[i]]) if parent[i] >= 0 else None for i in some], dtype="Int64")})

    found = stored(described.groupBy("size", "list", "one", "two").applyInPandas(verify, "class_id long, links long, parent long"), "pivot-links")
    linked = found.groupBy("class_id").agg(F.sum("links").alias("links"))
    comps = components(found.filter("parent is not null").select(F.col("class_id").alias("a"), F.col("parent").alias("b"))).withColumnRenamed("node", "class_id")
    table = classes.drop("v").join(linked, "class_id", "left").join(comps, "class_id", "left").withColumn("component", F.coalesce("component", "class_id"))
    least = table.groupBy("component").agg(F.min("least_id").alias("component_id"))
    table = stored(table.join(least, "component").select("h1", "h2", "copies", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), "component_id"), "pivot-table")
    joined = looked_up(ids.filter("good"), table, ["h1", "h2"], "copies").select("vec_id", "n_links", "component_id")
    alone = ids.filter("not good").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return joined.unionByName(alone).withColumn("kept", F.col("vec_id") == F.col("component_id"))
