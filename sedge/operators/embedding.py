"""Vectors for texts through a provider that can be exchanged."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions import columns as C


class Embedder(Protocol):
    dimensions: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


@dataclass
class HashingEmbedder:
    """Signed counts of hashed words and word pairs, of length 1: the same anywhere."""

    dimensions: int = 256

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), dtype=np.float64)
        for row, text in zip(out, texts, strict=True):
            words = text.lower().split()
            for gram in [*words, *map(" ".join, zip(words, words[1:], strict=False))]:
                h = xxhash.xxh3_64_intdigest(gram.encode("utf-8", "surrogatepass"))
                row[h % self.dimensions] += 1 if h >> 63 else -1
        norms = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(norms == 0, 1, norms)).astype(np.float32)


class RateLimited(Exception):
    """Raised by a remote provider; ``message`` may say how long to wait."""


@dataclass
class RemoteEmbedder:
    """Batches for a service that limits its rate. ``call`` takes texts and returns
    vectors in their order; only a RateLimited call is made again."""

    call: Callable[[list[str]], np.ndarray]
    dimensions: int
    batch: int = 14
    pause: float = 61.0
    retries: int = 5
    sleep: Callable[[float], None] = field(default=time.sleep)

    def wait(self, message: str, attempt: int) -> float:
        import re

        said = re.search(r"retryDelay.*?(\d+)s", message, re.DOTALL)
        return int(said[1]) + 2 if said else (attempt + 1) * 15

    def embed(self, texts: list[str]) -> np.ndarray:
        out = []
        for at in range(0, len(texts), self.batch):
            if at:
                self.sleep(self.pause)
            for attempt in range(self.retries + 1):
                try:
                    out.append(np.asarray(self.call(texts[at : at + self.batch]), dtype=np.float32))
                    break
                except RateLimited as e:
                    if attempt == self.retries:
                        raise
                    self.sleep(self.wait(str(e), attempt))
        return np.concatenate(out) if out else np.empty((0, self.dimensions), dtype=np.float32)


def embed(df: DataFrame, text_col: str, embedder: Embedder, out_col: str = "embeddings", lanes: int | None = None) -> DataFrame:
    """``df`` with a vector for each text (white space collapsed first); null for null.

    ``lanes``: tasks that call the provider at once, for one that limits its rate.
    """

    @F.pandas_udf("array<float>")
    def vectors(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in batches:
            out = pd.Series([None] * len(s), dtype=object)
            some = np.flatnonzero(s.notna().to_numpy())
            for i, v in zip(some, embedder.embed(s.iloc[some].tolist()) if len(some) else [], strict=True):
                if len(v) != embedder.dimensions:
                    raise ValueError(f"a vector has {len(v)} numbers, not {embedder.dimensions}")
                out.iloc[i] = v
            yield out

    rows = df.repartition(lanes) if lanes else df
    return rows.withColumn(out_col, vectors(C.collapse_space(text_col)))
