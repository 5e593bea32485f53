"""Hashes of words and word windows, and a bounded membership filter."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
#: Makes a second, independent hash of a first one of words or shingles.
SECOND = np.uint64(0xA0761D6478BD642F)


_powers = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]


def words_of(text: str) -> list[bytes]:
    """The maximal runs without ASCII white space; bytes.split() parts at exactly that."""
    return text.encode("utf-8", "surrogatepass").split()


def word_hashes(words: list[bytes]) -> np.ndarray:
    return text_hashes(b" ".join(words))


_SPACES = np.zeros(256, dtype=bool)
_SPACES[[0x20, *range(0x09, 0x0E)]] = True
#: Bytes of a text that are hashed at once.
SLICE = 1 << 18


def text_hashes(text: bytes) -> np.ndarray:
    """A 64-bit hash for each word of ``text``, in order, without making the words.

    Slices end between words, so memory is bounded unless a single word is longer
    than a slice.
    """
    if len(text) <= SLICE:
        return _sliced(text)
    out, at = [], 0
    while at < len(text):
        end = at + SLICE
        while end < len(text) and not _SPACES[text[end]]:
            end += 1
        out.append(_sliced(text[at:end]))
        at = end
    return np.concatenate(out)


def _sliced(text: bytes) -> np.ndarray:
    """The sum over a word's bytes of a random number of the byte times one of its place.

    Multilinear hashing: as each place has a number of its own, and not the power of one
    base, no two words are bound to collide, however long they are or what they repeat.
    """
    b = np.frombuffer(text, dtype=np.uint8)
    inside = np.zeros(len(b) + 2, dtype=bool)
    np.logical_not(_SPACES[b], out=inside[1:-1])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    lengths = edges[1::2] - edges[::2]
    if not len(lengths):
        return np.empty(0, dtype=np.uint64)
    firsts = np.cumsum(lengths) - lengths
    place = np.arange(int(lengths.sum())) - np.repeat(firsts, lengths)
    terms = _BYTES[b[inside[1:-1]]] * places(int(lengths.max()))[place]
    with np.errstate(over="ignore"):
        return mixed(np.add.reduceat(terms, firsts) + mixed(lengths.astype(np.uint64)))


def places(n: int) -> np.ndarray:
    """A random number for each place of a word, the same in every process."""
    global _places
    if len(_places) < n:
        with np.errstate(over="ignore"):
            _places = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * BASE)
    return _places[:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def top_bytes(hashes: np.ndarray, width: int) -> np.ndarray:
    """The ``width`` highest bytes of each hash, a row for each."""
    return (hashes >> np.uint64(64 - 8 * width)).astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]


def as_number(carried: np.ndarray) -> np.ndarray:
    """What ``top_bytes`` gave, as numbers."""
    raw = np.zeros((len(carried), 8), dtype=np.uint8)
    raw[:, : carried.shape[1]] = carried
    return raw.view("<u8").ravel()


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n."""
    if len(_powers[0]) < n:
        for k, b in enumerate((BASE, BASE_INVERSE)):
            with np.errstate(over="ignore"):
                factors = np.full(2 * n, b, dtype=np.uint64)
                factors[0] = 1
                _powers[k] = np.multiply.accumulate(factors)
    return _powers[0][:n], _powers[1][:n]


def windows(hashes: np.ndarray, size: int) -> np.ndarray:
    """A hash for each ``size`` consecutive words; none if there are fewer."""
    n = len(hashes) - size + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    up, down = powers(len(hashes))
    with np.errstate(over="ignore"):
        sums = np.concatenate([np.zeros(1, dtype=np.uint64), np.cumsum(hashes * up, dtype=np.uint64)])
        return mixed((sums[size:] - sums[:-size]) * down[:n])


with np.errstate(over="ignore"):
    _BYTES = mixed(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93))
_places = np.empty(0, dtype=np.uint64)


#: Bits of a membership filter: 4 MB for any input, 8.4 MB as a broadcast table holds them.
FILTER_BITS = 1 << 25


def membership(keys: DataFrame, key: str) -> DataFrame:
    """(bucket, bits): a bitmap over hashes of ``key``, at most 1,024 rows of 4 KB.

    Its size doesn't depend on the data, so it may be broadcast; with more keys
    it lets more other rows pass, and what passes is joined exactly.
    """
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    return keys.groupBy(F.bitmap_bucket_number(at).alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("_bits"))


def may_hold(df: DataFrame, key: str, filter_: DataFrame, flag: str) -> DataFrame:
    """``df`` with the boolean ``flag``: false only where ``filter_`` lacks ``key``."""
    at = F.pmod(F.xxhash64(key), F.lit(FILTER_BITS))
    position = F.bitmap_bit_position(at)
    byte: Column = F.conv(F.hex(F.substring(F.col("_bits"), (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    bit = byte.bitwiseAND(F.element_at(F.array(*[F.lit(1 << i) for i in range(8)]), (F.pmod(position, F.lit(8)) + 1).cast("int"))) != 0
    return df.withColumn("_bucket", F.bitmap_bucket_number(at)).join(F.broadcast(filter_), "_bucket", "left").withColumn(flag, F.coalesce(bit, F.lit(False))).drop("_bucket", "_bits")


def without(df: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """``df`` without the rows whose ``key`` is in ``gone``; only rows that pass the
    membership filter are shuffled."""
    flagged = may_hold(df, key, membership(gone, key), "_near")
    return flagged.filter("not _near").drop("_near").unionByName(flagged.filter("_near").drop("_near").join(gone.select(key).distinct(), key, "left_anti")).select(*df.columns)
