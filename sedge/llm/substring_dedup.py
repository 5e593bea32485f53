"""Substring deduplication by fixed-block anchors.

Blocks are half a window long, so every window holds exactly one whole block
that starts at a multiple of the block length. Those reference blocks are the
index; every rolling block of every document probes it. A window can repeat
only if its reference block is met by another rolling block, so only windows
around such blocks are extended: they are compared whole with all others of
their kind, and the words under repeated windows, the maximal repeats, go.

Rolling blocks travel packed: one row for each task, flush and hash class with
four bytes of hash and two of position for each block. Within a class equal
hashes are counted, never paired, so passages shared by thousands of documents
cost no more than others. Whole windows travel with fifteen bytes of two independent
hashes, besides their class: among 10**14 windows two different ones are equal in
these with a chance of under 10**-8.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.llm.hashing import SECOND, as_number, may_hold, membership, mixed, text_hashes, top_bytes, windows, words_of
from sedge.llm.shared import COARSE, as_text, resplit, shuffle_partitions, stored, trimmed

#: Rolling blocks that a task holds before it passes them on, and in a class.
FLUSH, CLASS = 1_000_000, 2_000_000
#: Bytes of hash of a block, and of the two hashes of a window.
BLOCK_BYTES, WINDOW_BYTES = (4, 0), (7, 8)
PACKED = "part int, docs binary, counts binary, hashes binary, positions binary"


class Packer:
    """Gathers (document, positions, hashes) and deals them into classes.

    ``width`` and ``second``: how many bytes of a hash, whose class is known, and of a
    second one travel.
    """

    def __init__(self, classes: int, width: int, second: int = 0):
        self.classes, self.width, self.second = min(classes, COARSE), width, second
        self.clear()

    def clear(self) -> None:
        self.docs, self.positions, self.hashes, self.seconds, self.held = [], [], [], [], 0

    def add(self, doc: int, positions: np.ndarray, hashes: np.ndarray, seconds: np.ndarray | None = None) -> None:
        if len(positions):
            self.docs.append(doc)
            self.positions.append(positions.astype(np.uint32))
            self.hashes.append(hashes)
            if seconds is not None:
                self.seconds.append(seconds)
            self.held += len(positions)

    def flush(self) -> pd.DataFrame:
        rows = []
        if self.held:
            hashes, positions = np.concatenate(self.hashes), np.concatenate(self.positions)
            carried = top_bytes(hashes, self.width)
            if self.second:
                carried = np.concatenate([carried, top_bytes(np.concatenate(self.seconds), self.second)], axis=1)
            owner = np.repeat(np.arange(len(self.docs), dtype=np.uint32), [len(p) for p in self.positions])
            docs = np.array(self.docs, dtype=np.int64)
            part = (hashes % np.uint64(self.classes)).astype(np.uint16 if self.classes < 1 << 16 else np.uint32)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(self.classes + 1))
            for c in range(self.classes):
                at = order[ends[c] : ends[c + 1]]
                if len(at):
                    own, counts = np.unique(owner[at], return_counts=True)
                    where = positions[at]
                    short = where.max() < 1 << 16
                    rows.append((c, docs[own].tobytes(), counts.astype("<u4").tobytes(), carried[at].tobytes(), where.astype("<u2" if short else "<u4").tobytes()))
        self.clear()
        return pd.DataFrame(rows, columns=["part", "docs", "counts", "hashes", "positions"])


def carried_by(group: pd.DataFrame, wide: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, positions and carried bytes of all packed rows of a class."""
    docs, positions, carried = [], [], []
    for d, c, h, p in zip(group["docs"], group["counts"], group["hashes"], group["positions"], strict=True):
        docs.append(np.repeat(np.frombuffer(d, np.int64), np.frombuffer(c, "<u4")))
        carried.append(np.frombuffer(h, np.uint8).reshape(-1, wide))
        positions.append(np.frombuffer(p, "<u2" if len(p) * wide == 2 * len(h) else "<u4").astype(np.uint32))
    return np.concatenate(docs), np.concatenate(positions), np.concatenate(carried)


def unpacked(group: pd.DataFrame, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents, positions and hashes of all packed rows of a class."""
    docs, positions, carried = carried_by(group, width)
    return docs, positions, as_number(carried)


def by_document(packed: DataFrame, width: tuple[int, int], chosen: Callable[[np.ndarray, np.ndarray], np.ndarray], classes: int) -> DataFrame:
    """(key, positions): for each document the positions that ``chosen(positions,
    runs)`` marks in some class, as an array of ints. Equal hashes have equal runs."""

    def mark(group: pd.DataFrame) -> pd.DataFrame:
        docs, positions, carried = carried_by(group, sum(width))
        first, second = as_number(carried[:, : width[0]]), as_number(carried[:, width[0] :])
        order = np.lexsort((second, first)) if width[1] else np.argsort(first, kind="stable")
        docs, positions, first, second = docs[order], positions[order], first[order], second[order]
        some = chosen(positions, runs(first, second))
        docs, positions = docs[some], positions[some]
        order = np.argsort(docs, kind="stable")
        packer = Packer(classes, 1)
        docs, positions = docs[order], positions[order]
        starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]]) if len(docs) else np.empty(0, int)
        for a, b in zip(starts, np.r_[starts, len(docs)][1:], strict=True):
            # dealt by document: each of its positions has the document as its hash
            packer.add(int(docs[a]), positions[a:b], np.full(b - a, docs[a]).astype(np.int64).view(np.uint64))
        return packer.flush()

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        docs, positions, _ = carried_by(group, 1)
        order = np.lexsort((positions, docs))
        docs, positions = docs[order], positions[order]
        starts = np.flatnonzero(np.r_[True, docs[1:] != docs[:-1]])
        return pd.DataFrame([(int(docs[a]), np.unique(positions[a:b]).astype(np.int32)) for a, b in zip(starts, np.r_[starts[1:], len(docs)], strict=True)], columns=["key", "positions"])

    def finer(by: Callable[[np.ndarray, np.ndarray], np.ndarray], width: tuple[int, int]) -> Callable[[pd.DataFrame], pd.DataFrame]:
        """A packed row dealt into the finer classes of its class."""

        def split(row: pd.DataFrame) -> pd.DataFrame:
            docs, positions, carried = carried_by(row, sum(width))
            fine = by(docs, carried)
            out = []
            for f in np.unique(fine):
                at = np.flatnonzero(fine == f)
                starts = np.flatnonzero(np.r_[True, docs[at][1:] != docs[at][:-1]])
                where = positions[at]
                short = where.max() < 1 << 16
                out.append((int(row["part"].iloc[0]), int(f), docs[at][starts].tobytes(), np.diff(np.r_[starts, len(at)]).astype("<u4").tobytes(), carried[at].tobytes(), where.astype("<u2" if short else "<u4").tobytes()))
            return pd.DataFrame(out, columns=["part", "fine", "docs", "counts", "hashes", "positions"])

        return split

    def grouped(rows: DataFrame, by: Callable[[np.ndarray, np.ndarray], np.ndarray], width: tuple[int, int]):
        if classes <= COARSE:
            return rows.groupBy("part")
        return resplit(rows, PACKED, finer(by, width), FLUSH // 8).groupBy("part", "fine")

    n = -(-classes // COARSE)
    by_hash = lambda docs, carried: as_number(carried[:, : width[0]]) % np.uint64(n)
    by_doc = lambda docs, carried: mixed(docs.view(np.uint64)) % np.uint64(n)
    marked = grouped(packed, by_hash, width).applyInPandas(mark, PACKED)
    return grouped(marked, by_doc, (1, 0)).applyInPandas(merge, "key long, positions array<int>")


def runs(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The number of each pair's run in sorted pairs."""
    return np.cumsum(np.r_[False, (first[1:] != first[:-1]) | (second[1:] != second[:-1])]) if len(first) else np.empty(0, int)


def candidates(n_words: int, blocks: np.ndarray, window: int, block: int) -> np.ndarray:
    """Starts of the windows whose reference block is one of ``blocks``."""
    # the reference block of window i starts at the first multiple of block from i on
    starts = (np.asarray(blocks, dtype=np.int64)[:, None] - np.arange(block - 1, -1, -1)).ravel()
    return starts[(starts >= 0) & (starts <= n_words - window)]


def remove_repeats(docs: DataFrame, window: int = 35, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """doc_id, n_words, n_removed, kept_sha256[, kept_text] for every row of ``docs``.

    A word goes if some ``window`` consecutive words that cover it start a second
    time anywhere, in the same document too. Words are runs without ASCII white
    space and count unchanged; null, empty and short texts lose nothing. Rows that
    repeat an id and a text are repeats of each other. Empty tables give empty
    results; other columns are ignored. ``window`` must be odd: a block has
    (window + 1) / 2 words. Whole windows are told apart by 120 hash bits.
    """
    if window % 2 == 0:
        raise ValueError("window must be odd")
    block = (window + 1) // 2
    text = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).withColumn("key", F.xxhash64("doc_id", "text"))
    total = text.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    classes = max(shuffle_partitions(docs.sparkSession), int(total / 6 / CLASS) + 1)

    def roll(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(classes, *BLOCK_BYTES)
        for batch in batches:
            for key, own in zip(batch["key"].tolist(), batch["text"], strict=True):
                hashes = windows(text_hashes(own.encode("utf-8", "surrogatepass")), block)
                if len(hashes) >= block:  # else the document has no window
                    packer.add(key, np.arange(len(hashes)), hashes)
                if packer.held >= FLUSH:
                    yield packer.flush()
        yield packer.flush()

    def met(positions: np.ndarray, run: np.ndarray) -> np.ndarray:
        return (positions % block == 0) & (np.bincount(run)[run] > 1) if len(run) else np.empty(0, bool)

    blocks = stored(by_document(text.select("key", "text").mapInPandas(trimmed(roll), PACKED), BLOCK_BYTES, met, classes), "anchors-blocks")
    found = blocks.select("key", F.col("positions").alias("blocks"))
    near = may_hold(text, "key", membership(blocks, "key"), "near")

    def extend(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        packer = Packer(classes, *WINDOW_BYTES)
        for batch in batches:
            for key, own, at in zip(batch["key"].tolist(), batch["text"], batch["blocks"], strict=True):
                words = text_hashes(own.encode("utf-8", "surrogatepass"))
                starts = candidates(len(words), at, window, block)
                packer.add(key, starts, windows(words, window)[starts], windows(mixed(words ^ SECOND), window)[starts])
                if packer.held >= FLUSH:
                    yield packer.flush()
        yield packer.flush()

    def single(positions: np.ndarray, run: np.ndarray) -> np.ndarray:
        return np.bincount(run)[run] == 1 if len(run) else np.empty(0, bool)

    # what comes back is the windows that did not repeat, far fewer than those that did
    alone = stored(by_document(near.filter("near").select("key", "text").join(found, "key").mapInPandas(trimmed(extend), PACKED), WINDOW_BYTES, single, classes), "anchors-alone")

    def finish(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for doc_id, own, at, not_ in zip(batch["doc_id"].tolist(), batch["text"], batch["blocks"], batch["alone"], strict=True):
                words = words_of(own)
                keep = words
                if at is not None:
                    starts = np.zeros(len(words) + 1, dtype=np.int64)
                    own_starts = candidates(len(words), at, window, block)
                    if not_ is not None:
                        own_starts = np.setdiff1d(own_starts, not_)
                    np.add.at(starts, own_starts, 1)
                    np.add.at(starts, own_starts + window, -1)
                    gone = np.cumsum(starts[:-1]) > 0
                    keep = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                kept = b" ".join(keep)
                out.append((doc_id, len(words), len(words) - len(keep), hashlib.sha256(kept).hexdigest(), *[kept.decode("utf-8", "surrogatepass")] * with_text))
            yield pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept_sha256", *["kept_text"] * with_text])

    no_list = F.lit(None).cast("array<int>")
    marked = near.filter("near").select("doc_id", "text", "key").join(found, "key", "left").join(alone.select("key", F.col("positions").alias("alone")), "key", "left")
    every = near.filter("not near").select("doc_id", "text", no_list.alias("blocks"), no_list.alias("alone")).unionByName(marked.select("doc_id", "text", "blocks", "alone"))
    kind = dict(text.dtypes)["doc_id"]
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    found = (as_text(every, "doc_id") if whole else every).mapInPandas(trimmed(finish), f"doc_id {'string' if whole else kind}, n_words long, n_removed long, kept_sha256 string" + ", kept_text string" * with_text)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind)) if whole else found
