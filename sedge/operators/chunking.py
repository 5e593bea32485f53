"""Recursive splitting of texts into overlapping chunks with their places."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge import schema
from sedge.functions import columns as C

SEPARATORS = ("\n\n", "\n", " ", "")


def _pieces(text: str, separator: str) -> list[str]:
    """Parts of ``text``, each but the first starting with the separator."""
    if not separator:
        return list(text)
    out, start, at = [], 0, text.find(separator)
    while at >= 0:
        if at > start:
            out.append(text[start:at])
            start = at
        at = text.find(separator, at + 1)
    return [p for p in [*out, text[start:]] if p]


def _merged(pieces: list[str], size: int, overlap: int) -> list[str]:
    out, held, total = [], deque(), 0
    for piece in pieces:
        if held and total + len(piece) > size:
            if whole := "".join(held).strip():
                out.append(whole)
            while total > overlap or (total + len(piece) > size and total > 0):
                total -= len(held.popleft())
        held.append(piece)
        total += len(piece)
    whole = "".join(held).strip()
    return [*out, whole] if whole else out


def split(text: str, size: int = 4000, overlap: int = 400, separators: tuple[str, ...] = SEPARATORS) -> list[str]:
    """Chunks of at most ``size`` characters. A text is parted at the first separator
    that it has, parts are put together while they fit, and longer ones are parted
    at the next separators."""
    at = next(i for i, s in enumerate(separators) if s in text)
    out, fit = [], []
    for piece in _pieces(text, separators[at]):
        if len(piece) < size:
            fit.append(piece)
            continue
        out += _merged(fit, size, overlap)
        fit = []
        out += split(piece, size, overlap, separators[at + 1 :]) if at + 1 < len(separators) else [piece]
    return out + _merged(fit, size, overlap)


def _placed(text: str, chunks: list[str]) -> list[dict]:
    """Chunks with their first place in ``text`` and its section: one more than the blank
    lines before it."""
    ends = [m.end() for m in re.finditer("\n\n", text)]
    starts = [text.find(c) for c in chunks]
    return [{"content": c, "start": at, "section": bisect_right(ends, max(at, 0)) + 1} for c, at in zip(chunks, starts, strict=True)]


def chunk(files: DataFrame, text_col: str = "text", name_col: str | None = "name", pages_col: str | None = None, size: int = 4000, overlap: int = 400) -> DataFrame:
    """``files`` without its text, one row for each chunk: chunk_index, content, metadata.

    A blank or null text has no chunk. Places are those of a chunk's first occurrence
    in the text; percentages and pages relate it to the trimmed length.
    """
    if overlap >= size:
        raise ValueError("overlap must be smaller than size")

    # rows come a hundred at a time, each with its text once: a worker never holds an Arrow batch of texts
    @F.udf("array<struct<content: string, start: int, section: int>>", useArrow=False)
    def parts(text: str | None, lead: int | None, n: int | None) -> list[dict]:
        return _placed(text, split(text[lead : lead + n], size, overlap)) if n else []

    # the text goes before its chunks become rows, so that these don't carry it
    placed = files.withColumns({"_lead": F.length(text_col) - F.length(C.trim_start(text_col)), "_total": F.length(C.trim_all(text_col))})
    rows = placed.withColumn("_parts", parts(text_col, "_lead", "_total")).withColumn("_n", F.size("_parts")).drop("_lead", text_col)
    each = rows.select("*", F.posexplode("_parts").alias("chunk_index", "_part")).drop("_parts")
    start, pages = F.col("_part.start"), F.col(pages_col) if pages_col else F.lit(None).cast("int")
    place = F.greatest(start, F.lit(0))
    metadata = F.struct(
        F.col("chunk_index").alias("chunkIndex"),
        F.col("_n").alias("totalChunks"),
        (F.col(name_col) if name_col else F.lit(None).cast("string")).alias("fileName"),
        C.page_estimate(place, F.col("_total"), pages).alias("estimatedPage"),
        pages.alias("totalPages"),
        C.position_percent(place, F.col("_total")).alias("positionPercent"),
        F.col("_part.section").alias("section"),
        F.when(start >= 0, start).alias("charOffset"),
        F.length("_part.content").alias("charLength"),
    ).cast(schema.METADATA)
    return each.withColumns({"content": F.col("_part.content"), "metadata": metadata}).drop("_part", "_total", "_n")


def register(spark) -> None:
    """The table function ``chunk_text(text, size, overlap)`` for SQL: chunk_index, content."""

    @F.udtf(returnType="chunk_index int, content string")
    class ChunkText:
        def eval(self, text: str, size: int, overlap: int):
            yield from enumerate(split(text.strip(), size, overlap) if text and text.strip() else [])

    spark.udtf.register("chunk_text", ChunkText)
