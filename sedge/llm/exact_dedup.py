"""Exact deduplication through an extendible-hash index on shared files.

The directory is grown from byte counts of key prefixes: a bucket over capacity
splits on the next bit, and the directory doubles when that bucket already uses
all its bits. Every bucket is a range of keys. Owner tasks each take whole
buckets, chain the texts of a key and compare their bytes, and write the index
to the shared folder; documents then look themselves up.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.shared import SPACE, looked_up, shuffle_partitions, stored, trimmed

#: Key bits that a directory may use at most.
MAX_DEPTH = 16
#: Bytes of text after which a task passes on what it has combined.
COMBINE_BYTES = 16 << 20


def directory(cells: dict[int, int], capacity: int, max_depth: int = MAX_DEPTH) -> list[int]:
    """Bucket number for each value of the first g key bits, len = 2**g.

    ``cells``: bytes for each value of the first ``max_depth`` bits. Buckets are
    numbered in key order.
    """
    prefix = [0]
    for v in range(1 << max_depth):
        prefix.append(prefix[-1] + cells.get(v, 0))
    size = lambda depth, at: prefix[(at + 1) << (max_depth - depth)] - prefix[at << (max_depth - depth)]
    depth, pointers = 0, [(0, 0)]  # a bucket is its local depth and its prefix
    work = [(0, 0)]
    while work:
        local, at = work.pop()
        if size(local, at) <= capacity or local == max_depth:
            continue
        if local == depth:
            pointers = [p for p in pointers for _ in range(2)]
            depth += 1
        halves = [(local + 1, 2 * at), (local + 1, 2 * at + 1)]
        width = 1 << (depth - local - 1)
        for h, half in enumerate(halves):
            first = half[1] << (depth - local - 1)
            pointers[first : first + width] = [half] * width
        work += halves
    number: dict[tuple[int, int], int] = {}
    return [number.setdefault(p, len(number)) for p in pointers]


def _least(a: int | None, b: int | None) -> int | None:
    """The smaller id; null only if both are."""
    if pd.isna(a):
        return None if pd.isna(b) else b
    return a if pd.isna(b) else min(a, b)


def _combine(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """One row for each text and flush instead of one for each copy."""
    held: dict[str, list] = {}
    size = 0

    def flush() -> pd.DataFrame:
        return pd.DataFrame([[b, k, t, i, n] for t, (b, k, i, n) in held.items()], columns=["bucket", "key", "norm", "doc_id", "copies"])

    for batch in batches:
        for bucket, key, norm, doc_id in zip(batch["bucket"], batch["key"], batch["norm"], batch["doc_id"], strict=True):
            if (got := held.get(norm)) is None:
                held[norm] = [bucket, key, _least(doc_id, None), 1]
                size += len(norm)
            else:
                got[2] = _least(got[2], doc_id)
                got[3] += 1
        if size > COMBINE_BYTES:
            yield flush()
            held, size = {}, 0
    if held:
        yield flush()


def _own(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Chain the texts of each key, in key order; one row for each text."""
    key, chain = None, []

    def entries() -> list:
        return [[b, key, slot, hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest(), i, n] for slot, (t, b, i, n) in enumerate(chain)]

    for batch in batches:
        out: list = []
        for bucket, k, norm, doc_id, copies in zip(batch["bucket"], batch["key"], batch["norm"], batch["doc_id"], batch["copies"], strict=True):
            if k != key:
                out += entries()
                key, chain = k, []
            for link in chain:
                if link[0] == norm:
                    link[2] = _least(link[2], doc_id)
                    link[3] += copies
                    break
            else:
                chain.append([norm, bucket, _least(doc_id, None), copies])
        yield pd.DataFrame(out, columns=["bucket", "key", "slot", "text_sha256", "keep_id", "group_size"])
    yield pd.DataFrame(entries(), columns=["bucket", "key", "slot", "text_sha256", "keep_id", "group_size"])


def build_index(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents, index), both stored in the shared folder.

    documents: doc_id, key, text_sha256. index: bucket, key, slot in the key's
    chain, text_sha256, keep_id, group_size; one row for each different text.
    ``capacity``: bytes of text in a bucket; by default what gives each shuffle
    partition eight buckets, 64 MB at most. A bucket that ``MAX_DEPTH`` bits
    can't split further is still read as a sorted stream.
    """
    spark = docs.sparkSession
    text = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.regexp_replace(F.coalesce(F.col(text_col), F.lit("")), f"[{SPACE}]+", " ").alias("norm")).withColumn("key", F.xxhash64("norm"))
    documents = stored(text.select("doc_id", "key", F.sha2("norm", 256).alias("text_sha256"), F.octet_length("norm").cast("long").alias("bytes")), "dedup-documents")
    cell = F.shiftrightunsigned("key", 64 - MAX_DEPTH).cast("int")
    cells = {r["cell"]: r["bytes"] for r in documents.groupBy("key").agg(F.max("bytes").alias("bytes")).groupBy(cell.alias("cell")).agg(F.sum("bytes").alias("bytes")).collect()}  # 2**MAX_DEPTH rows at most
    parts = shuffle_partitions(spark)
    pointers = directory(cells, capacity or min(64 << 20, max(1, sum(cells.values()) // (8 * parts))))
    depth = len(pointers).bit_length() - 1
    slots = spark.sparkContext.broadcast(pointers)  # 2**MAX_DEPTH numbers at most

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        to = slots.value

        def with_bucket() -> Iterator[pd.DataFrame]:
            for b in batches:
                yield b.assign(bucket=[to[(k & 0xFFFFFFFFFFFFFFFF) >> (64 - depth)] if depth else 0 for k in b["key"].tolist()])

        yield from _combine(with_bucket())

    entries = (
        # decimals, since pandas makes 64-bit integers beside a null doubles
        text.withColumn("doc_id", F.col("doc_id").cast("decimal(20,0)"))
        .mapInPandas(trimmed(place), "bucket int, key long, norm string, doc_id decimal(20,0), copies long")
        .repartition(parts, "bucket")
        .sortWithinPartitions("bucket", "key", "doc_id")
        .mapInPandas(trimmed(_own), "bucket int, key long, slot int, text_sha256 string, keep_id decimal(20,0), group_size long")
        .withColumn("keep_id", F.col("keep_id").cast("long"))
    )
    return documents, stored(entries, "dedup-index")


def probe(documents: DataFrame, index: DataFrame) -> DataFrame:
    """Each document with its index entry; only entries with copies are joined."""
    entry = index.select("key", "text_sha256", "keep_id", "group_size").filter("group_size > 1")
    keep = F.coalesce("keep_id", "doc_id")
    return looked_up(documents, entry, ["key", "text_sha256"], "group_size").select(
        "doc_id", keep.alias("keep_id"), F.coalesce("group_size", F.lit(1)).cast("long").alias("group_size"), (F.col("doc_id") == keep).alias("kept"), "text_sha256"
    )


def dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 for every row of ``docs``.

    Texts are equal when identical after each run of ASCII white space became
    one space; null counts as empty. The smallest doc_id of equal texts stays;
    rows that repeat a doc_id with its text all count and are all marked alike.
    A null doc_id comes after all others: keep_id is the smallest that isn't null,
    or null if none is, and kept is null where doc_id or keep_id is. Empty tables give empty results; other columns
    are ignored.
    """
    return probe(*build_index(docs, id_col, text_col, capacity))
