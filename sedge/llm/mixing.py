"""Mixing sources to target weights by subset-sum budget fitting.

Each source gets a budget in words. Whole repeats of the source come first; the
rest of the budget is fitted from counts of documents by exact length: every
length gives the same share, then a bounded-knapsack dynamic programme over a
small remaining budget fixes how many more documents of each length are taken.
Which documents of a length are taken follows a seeded order.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.shared import WORD, ranked, stored, trimmed_group

#: Weights by rank of the source, repeating.
WEIGHTS = (5, 2, 1)


def knapsack(sizes: list[int], spare: list[int], budget: int) -> list[int]:
    """How many of each size to take, at most ``spare`` of each, so that their
    sum is the largest possible that does not exceed ``budget``.

    Reachable sums are the bits of an integer; counts are split into powers of two.
    """
    full = (1 << (budget + 1)) - 1
    reach, steps = 1, []
    for i, (size, have) in enumerate(zip(sizes, spare, strict=True)):
        left = min(have, budget // size)
        power = 1
        while left > 0 and not reach >> budget & 1:
            n = min(power, left)
            steps.append((i, n, reach))
            reach |= (reach << (size * n)) & full
            left -= n
            power *= 2
    at, taken = reach.bit_length() - 1, [0] * len(sizes)
    for i, n, before in reversed(steps):
        if not before >> at & 1:
            at -= sizes[i] * n
            taken[i] += n
    return taken


def fit(sizes: np.ndarray, counts: np.ndarray, budget: int, reserve: int) -> np.ndarray:
    """Documents to take of each size (positive, distinct) for ``budget`` words.

    An equal share of each count, then single documents from the longest on
    while at least ``reserve`` words stay open, then ``knapsack`` on what is open.
    """
    total = int((sizes * counts).sum())
    if budget >= total:
        return counts.copy()
    share = np.array([int(c) * budget // total for c in counts], dtype=np.int64)
    left = budget - int((sizes * share).sum())
    order = np.argsort(-sizes)
    for i in order:
        n = int(min(counts[i] - share[i], max(0, left - reserve) // sizes[i]))
        share[i] += n
        left -= n * int(sizes[i])
    open_ = [i for i in order if share[i] < counts[i] and sizes[i] <= left]
    for i, n in zip(open_, knapsack([int(sizes[i]) for i in open_], [int(counts[i] - share[i]) for i in open_], left), strict=True):
        share[i] += n
    return share


def targets(sources: DataFrame, factor: float, cap: float) -> DataFrame:
    """``sources`` (source_key, source, source_size) with ``target``.

    Water filling: the total is shared by weight; a source whose share exceeds
    ``cap`` times its size gets that, and the rest is shared again. One row for
    each source, so the windows over all sources are small.
    """
    position = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weights = F.array(*[F.lit(float(w)) for w in WEIGHTS])
    rows = (
        sources.withColumn("_w", F.element_at(weights, (F.pmod(position, F.lit(len(WEIGHTS))) + 1).cast("int")))
        .withColumn("_cap", F.lit(cap) * F.col("source_size"))
        .withColumn("_total", F.lit(factor) * F.sum("source_size").over(Window.partitionBy()))
    )
    by_ratio = Window.orderBy(F.col("_cap") / F.col("_w"), F.col("source").asc_nulls_last())
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    rows = rows.withColumn("_level", (F.col("_total") - F.coalesce(F.sum("_cap").over(before), F.lit(0.0))) / F.sum("_w").over(after))
    level = F.max(F.when(F.col("_cap") / F.col("_w") >= F.col("_level"), F.col("_level"))).over(Window.partitionBy())
    return rows.withColumn("target", F.least("_cap", F.coalesce(level, F.lit(float("inf"))) * F.col("_w"))).drop("_w", "_cap", "_total", "_level")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", factor: float = 1.5, cap: float = 2.0, reserve: int = 4096, seed: int = 17, row_col: str | None = None) -> DataFrame:
    """Decide how often the mix takes each document.

    Returns doc_id, size, source, source_size, target, taken, copies: a document
    is taken 0, 1 or 2 times (``cap`` bounds whole repeats), ``taken`` = copies x
    size. Sizes are words; a null or empty text has size 0 and taken 0. A null
    source is a source of its own, last in order. Equal rows may be taken
    differently often, but the same set results in every run. An empty table
    gives an empty result. Other columns of ``docs`` are ignored, but ``row_col``, a
    key of rows, is returned with each.
    """
    if cap != int(cap):
        raise ValueError("cap counts whole repeats")
    rows = [row_col] if row_col else []
    sizes = stored(
        docs.select(
            *rows,
            F.col(id_col).alias("doc_id"),
            F.col(source_col).alias("source"),
            F.coalesce(F.concat(F.lit("="), F.col(source_col)), F.lit("")).alias("source_key"),
            F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        ),
        "mix-sizes",
    )
    lengths = stored(sizes.groupBy("source_key", "source", "size").agg(F.count("*").alias("docs")), "mix-lengths")
    goal = targets(lengths.groupBy("source_key", "source").agg(F.sum(F.col("size") * F.col("docs")).alias("source_size")), factor, cap)

    def choose(group: pd.DataFrame) -> pd.DataFrame:
        size, count = group["size"].to_numpy(np.int64), group["docs"].to_numpy(np.int64)
        whole, target = int(group["source_size"].iloc[0]), int(group["target"].iloc[0])
        repeats, more = (min(target // whole, int(cap)) if whole else 0), np.zeros(len(size), dtype=np.int64)
        if whole and repeats < cap:
            some = size > 0
            more[some] = fit(size[some], count[some], target - repeats * whole, reserve)
        return group.assign(repeats=repeats, more=more)[["source_key", "size", "source_size", "target", "repeats", "more"]]

    plan = (
        lengths.select("source_key", "size", "docs")
        .join(goal.select("source_key", "source_size", "target"), "source_key")
        .groupBy("source_key")
        .applyInPandas(trimmed_group(choose), "source_key string, size long, source_size long, target double, repeats long, more long")
    )
    plan = stored(plan, "mix-plan")
    chosen = ranked(sizes.withColumn("_order", F.xxhash64(F.lit(seed), "doc_id")), ["source_key", "size"], ["_order", "doc_id"], per_key=plan, ties=rows)
    copies = F.col("repeats") + F.when(F.col("rank") < F.col("more"), 1).otherwise(0)
    return chosen.select(*rows, "doc_id", "size", "source", "source_size", "target", (copies * F.col("size")).cast("long").alias("taken"), F.when(F.col("size") > 0, copies).otherwise(0).cast("int").alias("copies"))
