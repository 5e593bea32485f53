"""Target-distribution importance resampling over a persisted count matrix.

Documents are rows and hashed features columns of a sparse count matrix, written to the
shared folder in blocks of compressed sparse rows (CSR). The sums of its columns give the
distribution of the corpus, those of a second matrix that of the target; the matrix times
the gains of the buckets gives each document's weight. Weights with a seeded Gumbel noise
are scores, and the highest scores are the sample, drawn without replacement.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.shared import shuffle_partitions, stored, trimmed

#: Documents and counts of a block at most; one document with more is a block of its own.
BLOCK_ROWS, BLOCK_COUNTS = 8192, 1_000_000
#: Bytes of a text whose words are made at once.
SLICE = 1 << 20
BLOCKS = "doc_ids array<long>, features array<long>, words array<long>, starts binary, buckets binary, counts binary"
#: What isn't an ASCII letter or digit, or a byte of another character, parts words; A-Z are lower-cased.
_TO_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


def slices(raw: bytes) -> Iterator[list[bytes]]:
    """The words of ``raw``, whose words are parted by spaces, some at a time."""
    at = 0
    while at < len(raw):
        end = raw.find(b" ", at + SLICE)
        end = len(raw) if end < 0 else end
        yield raw[at:end].split()
        at = end


def counted(text: bytes | None, n: int, buckets: int) -> tuple[int, int, np.ndarray, np.ndarray]:
    """Words and features of a text, and its buckets in order with their counts.

    Features are the runs of one to ``n`` words; a feature's bucket is the CRC-32 of its
    words, joined by one space, modulo ``buckets``.
    """
    words, before, parts = 0, [], []
    for some in slices((text or b"").translate(_TO_WORDS)):
        words += len(some)
        codes = list(map(crc32, some))
        if n > 1:
            run = before + some
            codes += [crc32(b" ".join(run[i - m + 1 : i + 1])) for i in range(len(before), len(run)) for m in range(2, min(n, i + 1) + 1)]
            before = run[1 - n :]
        if codes:
            parts.append(np.unique(np.array(codes, dtype=np.uint32) % np.uint32(buckets), return_counts=True))
    if not parts:
        return 0, 0, np.empty(0, dtype=np.uint32), np.empty(0, dtype=np.int64)
    own, counts = parts[0]
    if len(parts) > 1:
        own, at = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.zeros(len(own), dtype=np.int64)
        np.add.at(counts, at, np.concatenate([p[1] for p in parts]))
    return words, int(counts.sum()), own, counts


def _one_list(values: pa.Array) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def count_matrix(docs: DataFrame, n: int = 1, buckets: int = 10000, id_col: str = "doc_id", text_col: str = "text", label: str = "importance-counts") -> DataFrame:
    """The count matrix of ``docs``, stored: a row of ``BLOCKS`` for each block.

    doc_ids, features and words have an entry for each document of the block. Those of
    document i are entries starts[i] to starts[i + 1] (int64) of buckets (uint32) and
    counts (int64), all little-endian. A null or empty text is a row without entries.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[pa.Array] = []
        rows: list[tuple] = []
        held = 0

        def block() -> pa.RecordBatch:
            words, features, own, counts = zip(*rows, strict=True)
            starts = np.concatenate([[0], np.cumsum([len(x) for x in own])]).astype("<i8")
            data = [np.concatenate(own).astype("<u4").tobytes(), np.concatenate(counts).astype("<i8").tobytes()]
            numbers = [_one_list(pa.array(x, pa.int64())) for x in (features, words)]
            return pa.RecordBatch.from_arrays([_one_list(pa.concat_arrays(ids)), *numbers, *(pa.array([x], pa.binary()) for x in (starts.tobytes(), *data))], ["doc_ids", "features", "words", "starts", "buckets", "counts"])

        for batch in batches:
            own_ids, texts = batch.column(0), batch.column(1)
            for i in range(len(texts)):
                ids.append(own_ids.slice(i, 1))
                rows.append(counted(texts[i].as_py(), n, buckets))
                held += len(rows[-1][2])
                if len(rows) >= BLOCK_ROWS or held >= BLOCK_COUNTS:
                    yield block()
                    ids, rows, held = [], [], 0
        if rows:
            yield block()

    kept = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    return stored(kept.mapInArrow(trimmed(scan), BLOCKS), label)


def column_sums(matrix: DataFrame, buckets: int) -> np.ndarray:
    """The sum of each column: a number for each bucket, whatever the number of documents."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(buckets, dtype=np.int64)
        for batch in batches:
            for own, counts in zip(batch.column(0), batch.column(1), strict=True):
                np.add.at(sums, np.frombuffer(own.as_py(), "<u4"), np.frombuffer(counts.as_py(), "<i8"))
        some = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(sums[some], pa.int64())], ["bucket", "n"])

    sums = np.zeros(buckets, dtype=np.int64)
    for r in matrix.select("buckets", "counts").mapInArrow(trimmed(add), "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        sums[r["bucket"]] = r["n"]
    return sums


def gains(target: np.ndarray, corpus: np.ndarray, scale: int = 1000) -> np.ndarray:
    """For each bucket ``scale`` times the log of its share in the target against that in
    the corpus, both with one added to each bucket, rounded down."""
    buckets, s, t = len(corpus), float(corpus.sum()), float(target.sum())
    return np.array([math.floor(scale * math.log((a + 1.0) * (s + buckets) / ((b + 1.0) * (t + buckets)))) for a, b in zip(target.tolist(), corpus.tolist(), strict=True)], dtype=np.int64)


def weighed(matrix: DataFrame, gain: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features and weight of each document: the matrix times ``gain``."""
    shared = matrix.sparkSession.sparkContext.broadcast(gain)  # a number for each bucket

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                starts, at, counts = (np.frombuffer(batch.column(c)[i].as_py(), kind) for c, kind in ((3, "<i8"), (4, "<u4"), (5, "<i8")))
                sums = np.concatenate([[0], np.cumsum(own[at] * counts)])
                yield pa.RecordBatch.from_arrays([*(batch.column(c)[i].values for c in (0, 2, 1)), pa.array(sums[starts[1:]] - sums[starts[:-1]], pa.int64())], ["doc_id", "n_words", "n_features", "weight"])

    return matrix.mapInArrow(trimmed(multiply), "doc_id long, n_words long, n_features long, weight long")


def drawn(scored: DataFrame, number: int) -> DataFrame:
    """``scored`` with rank: 1, 2, ... to ``number`` by falling score, then doc_id (null last).

    Rows are dealt by ranges of that order, so no task holds more than its range; only a
    count for each range goes through the driver. ``scored`` must be stored.
    """
    numbered = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "importance-rows")  # rows equal in all else are parted by it
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last(), F.col("_row")]
    dealt = stored(numbered.repartitionByRange(shuffle_partitions(scored.sparkSession), *order).withColumn("_part", F.spark_partition_id()), "importance-ranges")
    base, rows = 0, []
    for r in sorted(dealt.groupBy("_part").count().collect()):
        rows.append((r["_part"], base))
        base += r["count"]
    before = scored.sparkSession.createDataFrame(rows, "_part int, _base long")  # a row for each range
    at = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) + F.col("_base")
    return dealt.join(F.broadcast(before), "_part").withColumn("rank", at.cast("long")).withColumn("rank", F.when(F.col("rank") <= number, F.col("rank"))).drop("_part", "_base", "_row")


def resample(docs: DataFrame, target: DataFrame, percent: int = 10, n: int = 1, buckets: int = 10000, least_words: int = 20, seed: int = 2024, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """doc_id, n_features, weight, score, rank for every row of ``docs``.

    Words are runs of ASCII letters and digits and characters outside ASCII, A-Z in lower
    case; features are all runs of one to ``n`` words. Of the N documents with at least
    ``least_words`` words ``percent`` * N / 100, rounded down, are drawn: those with the
    highest scores, ties by doc_id; the rank of others is null. The noise of a document
    depends on its id and ``seed`` alone, so reruns agree. Null and empty texts have no
    features and weight 0. A null id has the noise of an empty one and comes last among
    ties; rows that repeat an id are documents of their own. An empty target has equal
    shares; an empty table gives an empty result; other columns are ignored.
    """
    matrix = count_matrix(docs, n, buckets, id_col, text_col)
    wanted = count_matrix(target.withColumn("_none", F.lit(None).cast("long")), n, buckets, "_none", target_text_col, "importance-target")
    gain = gains(column_sums(wanted, buckets), column_sums(matrix, buckets))
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    share = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 0.5) / 4294967296.0
    scored = stored(weighed(matrix, gain).withColumn("score", F.col("weight") + F.floor(-1000 * F.log(-F.log(share)))), "importance-scores")
    long_enough = F.col("n_words") >= least_words
    number = percent * scored.filter(long_enough).count() // 100
    names = ["doc_id", "n_features", "weight", "score", "rank"]
    return drawn(scored.filter(long_enough), number).select(*names).unionByName(scored.filter(~long_enough).withColumn("rank", F.lit(None).cast("long")).select(*names))
