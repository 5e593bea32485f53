"""Packing documents into sequences by non-negative least squares.

Documents are cut into full windows and a remainder. The histogram of remainder
lengths, at most one count for each length below the window, is all the planner
sees: it enumerates shallow combinations of length classes that fill a window,
solves for non-negative repeat counts against the histogram, rounds them down,
and packs what is left greedily by exact length. The plan says for each length
which ranks of its pieces go to which sequences.
"""

from __future__ import annotations

import json
import re
import string
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sedge.llm.shared import as_text, ranked, small_table, stored, trim, trimmed

#: Bytes of words and ids that a worker remembers: of the words seen last, and as many of
#: those before them. LEAN_BYTES where executors hold much else; then nothing is kept from task to task.
CACHE_BYTES, LEAN_BYTES = 128 << 20, 8 << 20
#: Bytes of text whose new words are encoded together: what the tokenizer makes of them is many
#: times as large. A text isn't cut, so one that is longer is a group.
GROUP_BYTES, LEAN_GROUP = 1 << 20, 256 << 10
_MARKS = string.punctuation.encode()
_ALNUM = frozenset(string.ascii_letters.encode() + string.digits.encode())
#: Latin letters in UTF-8, but U+0130, which lower-cases to a letter and a mark: what stands
#: after one of these, an ASCII letter or a digit is a unit of its own if it is punctuation.
_LATIN = frozenset(chr(c).encode() for c in range(0xC0, 0x250) if c not in (0xD7, 0xF7, 0x130))
#: A run of lower-case ASCII and Latin-1 letters (U+00DF to U+00FF but the division sign) in UTF-8,
#: then punctuation: such letters are one unit, and normalising leaves them as they are.
_PLAIN = re.compile(rb"((?:[a-z]|\xc3[\x9f-\xb6\xb8-\xbf])+)([" + re.escape(_MARKS) + rb"]*)")
#: Plain words encoded in one call.
CALL_WORDS = 1000
_codecs: dict[tuple[str, bool], WordCodec] = {}


class WordCodec:
    """Token ids of whole texts, with the ids of seen words remembered.

    Exact for tokenizers that part texts at ASCII white space in any case and drop it,
    compose (NFC) and lower-case character by character, and then part runs of letters
    from punctuation: what stands between white space is encoded apart, as the tokenizer
    itself does. Only what can't change ids is done here: ASCII letters are lower-cased
    unless a combining accent or what may be a special token is in the text (an accent
    composes with some capitals only), and punctuation is parted from a letter or digit.
    """

    def __init__(self, path: str, lean: bool = False):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        #: A special token parts what is encoded at once: no word's ids hold it.
        self.parting = next((t.content for _, t in sorted(self.whole.get_added_tokens_decoder().items()) if t.special and not t.normalized), None)
        self.bare, self.last = (None, None) if lean else self._bare(path)
        self.group_bytes = LEAN_GROUP if lean else GROUP_BYTES
        if lean and (resize := getattr(self.whole.model, "_resize_cache", None)):
            resize(0)  # words are remembered here; the model's own memory of them outlives its task in part
        self.known: dict[bytes, bytes] = {}
        self.before: dict[bytes, bytes] = {}
        self.held = 0

    @staticmethod
    def _bare(path: str) -> tuple:
        """The model alone, for units between spaces that need no normalising, and for each id whether
        it ends a unit; nothing where the tokenizer isn't a word-ending byte-level BPE."""
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers") or [{}]
        suffix = spec["model"].get("end_of_word_suffix")
        if not suffix or len(steps) != 2 or steps[0].get("type") != "Split" or steps[1].get("type") != "ByteLevel" or steps[1].get("add_prefix_space") or steps[1].get("use_regex"):
            return None, None
        spec["normalizer"], spec["added_tokens"], steps[0] = None, [], {"type": "WhitespaceSplit"}
        vocab = spec["model"]["vocab"]
        last = np.zeros(max(vocab.values()) + 1, dtype=bool)
        last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        return Tokenizer.from_str(json.dumps(spec)), last

    def unit_ids(self, words: list[bytes]) -> list[bytes]:
        """The ids of each of ``words``, which are runs of lower-case Latin letters."""
        out: list[bytes] = []
        for i in range(0, len(words), CALL_WORDS):
            some = b" ".join(words[i : i + CALL_WORDS]).decode()
            got = np.array(self.bare.encode_batch_fast([some], add_special_tokens=False)[0].ids, dtype="<u4")
            raw, ends = got.tobytes(), (4 * np.flatnonzero(self.last[got]) + 4).tolist()
            out.extend([raw[a:b] for a, b in zip([0, *ends], ends)])  # noqa: B905
        return out

    def ids(self, words: list[str]) -> list[bytes]:
        """The ids of each word, encoded apart."""
        if self.parting is None or any("<" in w for w in words):
            return [np.array(e.ids, dtype="<u4").tobytes() for e in self.whole.encode_batch_fast(words, add_special_tokens=False)]
        got = np.array(self.whole.encode_batch_fast([self.parting.join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = np.flatnonzero(got == self.whole.token_to_id(self.parting))
        raw, starts = got.tobytes(), [0, *(4 * ends + 4).tolist()]
        return [raw[a:b] for a, b in zip(starts, [*(4 * ends).tolist(), len(raw)], strict=True)]

    def learn(self, new: set[bytes]) -> None:
        known, before = self.known, self.before
        bare = self.bare is not None
        # what may hold a special token is encoded in a call of its own
        units, plain, odd = [], [], []
        parted, heads, tails = [], [], []
        for w in new:
            if (got := before.get(w)) is not None:
                known[w] = got
            elif bare and (m := _PLAIN.fullmatch(w)) and b"<|" not in w:
                if m.end(1) == len(w):
                    units.append(w)
                else:
                    parted.append(w)
                    heads.append(m[1])
                    tails.append(m[2])
            elif w[-1] in _MARKS and b"<|" not in w and (head := w.rstrip(_MARKS)) and (head[-1] in _ALNUM or head[-2:] in _LATIN):
                parted.append(w)
                heads.append(head)
                tails.append(w[len(head) :])
            elif b"<" in w:
                odd.append(w)
            else:
                plain.append(w)
        for x in {*heads, *tails}.difference(known, units, plain, odd):
            (odd if b"<" in x else units if bare and _PLAIN.fullmatch(x) else plain).append(x)
        if units:
            known.update(zip(units, self.unit_ids(units), strict=True))
        for some in (plain, odd):
            if some:
                known.update(zip(some, self.ids([w.decode() for w in some]), strict=True))
        for w, head, tail in zip(parted, heads, tails, strict=True):
            known[w] = known[head] + known[tail]

    def encode_all(self, texts: list[str | None], most: int | None = None) -> Iterator[bytes]:
        """Little-endian unsigned 32-bit ids of each text, nothing of a null one."""
        group: list[list[bytes]] = []
        size = 0
        for text in texts:
            raw = (text or "").encode()
            # U+0300 to U+036F, all that compose with an ASCII letter, begin with these bytes
            if b"<|" not in raw and b"\xcc" not in raw and b"\xcd" not in raw:
                raw = raw.lower()
            group.append(raw.split())
            size += len(raw)
            if size >= self.group_bytes:
                yield from self._group(group, most)
                group, size = [], 0
        yield from self._group(group, most)

    def _group(self, group: list[list[bytes]], most: int | None) -> Iterator[bytes]:
        if self.held > (CACHE_BYTES if most is None else most):
            self.known, self.before, self.held = {}, self.known, 0
        known, new = self.known, set()
        found = []
        for words in group:
            got = list(map(known.get, words))
            if None in got:
                new.update([w for w, ids in zip(words, got, strict=True) if ids is None])
            found.append(got)
        if new:
            self.learn(new)
            self.held += 200 * len(new) + 2 * sum(map(len, new))
        for words, got in zip(group, found, strict=True):
            if None in got:
                got = [known[w] if ids is None else ids for w, ids in zip(words, got, strict=True)]
            yield b"".join(got)

    def forget(self) -> None:
        self.known, self.before, self.held = {}, {}, 0

    def encode(self, text: str | None) -> bytes:
        return next(self.encode_all([text]))


def codec(path: str, lean: bool = False) -> WordCodec:
    """The codec of a worker; a lean one does without the second, bare model, and goes with its task."""
    if (path, lean) not in _codecs:
        _codecs[path, lean] = WordCodec(path, lean)
    return _codecs[path, lean]


def cut(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, lean: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens[, ids] for each piece.

    A document's ids are those of its text (null: none) and ``end_id``. Pieces
    are full windows and a remainder, so each id lies in exactly one.
    """
    fields = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words, end = codec(tokenizer, lean), np.array([end_id], dtype="<u4").tobytes()
        encode, most = words.encode_all, LEAN_BYTES if lean else CACHE_BYTES
        for batch in batches:
            out = []
            for doc_id, ids in zip(batch["doc_id"].tolist(), encode(batch["text"].tolist(), most), strict=True):
                ids += end
                total = len(ids) // 4
                for start in range(0, total, window):
                    piece = ids[4 * start : 4 * (start + window)]
                    out.append((doc_id, start, len(piece) // 4, zlib.crc32(piece), total, *[piece] * with_ids))
            yield pd.DataFrame(out, columns=fields)
            if lean:
                trim()  # what encoding has freed adds up over a task
        if lean:
            words.forget()
            _codecs.pop((tokenizer, lean), None)

    kept = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    kind = dict(kept.dtypes)["doc_id"]
    whole = kind in ("bigint", "int", "smallint", "tinyint")
    found = (as_text(kept, "doc_id") if whole else kept).mapInPandas(trimmed(pieces), f"doc_id {'string' if whole else kind}, start long, length long, ids_crc32 long, doc_tokens long" + ", ids binary" * with_ids)
    return found.withColumn("doc_id", F.col("doc_id").cast(kind)) if whole else found


def combinations(units: int, present: set[int]) -> list[tuple[int, ...]]:
    """Ways to fill ``units`` with one, two or three of the ``present`` classes."""
    found = [(units,)] if units in present else []
    for a in sorted(present, reverse=True):
        if a < units and units - a <= a and units - a in present:
            found.append((a, units - a))
        for b in range(min(a, units - a - 1), (units - a - 1) // 2, -1):
            if b in present and units - a - b in present and units - a - b <= b:
                found.append((a, b, units - a - b))
    return found


def nnls(columns: np.ndarray, h: np.ndarray, rounds: int = 3000) -> np.ndarray:
    """min |A x - h| over x >= 0 by active sets. columns: rows of A that each
    column counts, -1 where it has fewer than three."""
    n, x, passive = len(columns), np.zeros(len(columns)), np.zeros(len(columns), dtype=bool)
    pad = np.where(columns < 0, len(h), columns)

    def dense(which: np.ndarray) -> np.ndarray:
        a = np.zeros((len(h) + 1, len(which)))
        for k in range(pad.shape[1]):
            np.add.at(a, (pad[which, k], np.arange(len(which))), 1.0)
        return a[:-1]

    scale = 1e-9 * max(1.0, float(np.abs(h).max(initial=0)))
    for _ in range(min(rounds, 3 * n)):
        which = np.flatnonzero(passive)
        r = np.append(h - dense(which) @ x[which], 0.0)
        slope = np.where(passive, -np.inf, r[pad].sum(axis=1))
        if n == 0 or slope.max() <= scale:
            break
        passive[int(slope.argmax())] = True
        while True:
            which = np.flatnonzero(passive)
            s = np.linalg.lstsq(dense(which), h, rcond=None)[0]
            if (s > 0).all():
                x[:] = 0
                x[which] = s
                break
            back = s <= 0
            step = (x[which][back] / np.maximum(x[which][back] - s[back], 1e-300)).min()
            x[which] += step * (s - x[which])
            passive[which[x[which] <= 1e-12]] = False
            x[~passive] = 0
    return x


def plan(counts: dict[int, int], window: int, classes: int = 256) -> tuple[list[tuple[int, int, int, int, int]], int]:
    """Rows (length, from rank, to rank, pieces for each sequence, first sequence)
    and the number of sequences. ``counts``: pieces of each length up to ``window``."""
    rows, used, sequences = [], dict.fromkeys(counts, 0), 0
    step = -(-window // classes)
    unit = lambda n: -(-n // step)

    def take(length: int, n: int, each: int, first: int) -> None:
        rows.append((length, used[length], used[length] + n, each, first))
        used[length] += n

    if n := counts.get(window, 0):
        take(window, n, 1, 0)
        sequences = n
    by_unit: dict[int, list[int]] = {}
    for length in sorted(counts, reverse=True):
        if length < window:
            by_unit.setdefault(unit(length), []).append(length)
    stock = {u: sum(counts[x] for x in own) for u, own in by_unit.items()}
    names = sorted(stock)
    where = {u: i for i, u in enumerate(names)}
    ways = combinations(-(-window // step), set(names))
    if ways:
        columns = np.array([[where[u] for u in w] + [-1] * (3 - len(w)) for w in ways])
        repeats = nnls(columns, np.array([stock[u] for u in names], dtype=float))
        for i in np.argsort(-repeats, kind="stable"):
            if repeats[i] < 1:
                break
            way = ways[i]
            n = min([int(repeats[i] + 1e-6), *(stock[u] // way.count(u) for u in set(way))])
            for u in way:
                stock[u] -= n
                first, left = sequences, n
                while left:
                    length = by_unit[u][0]
                    if got := min(left, counts[length] - used[length]):
                        take(length, got, 1, first)
                        first, left = first + got, left - got
                    if used[length] == counts[length]:
                        by_unit[u].pop(0)
            sequences += n
    left = {x: counts[x] - used[x] for x in sorted(counts, reverse=True) if counts[x] > used[x]}
    while left:
        room, way = window, {}
        for length in left:  # longest first
            if n := min(left[length], room // length):
                way[length] = n
                room -= n * length
            if not room:
                break
        n = min(left[x] // k for x, k in way.items())
        for length, k in way.items():
            take(length, n * k, k, sequences)
            left[length] -= n * k
        sequences += n
        left = {x: k for x, k in left.items() if k}
    return rows, sequences


def pack(pieces: DataFrame, window: int = 4096, classes: int = 256) -> DataFrame:
    """``pieces`` (doc_id, start, length, ...) with sequence_id and offset.

    No sequence is longer than ``window``; offsets in it run from 0 without gaps,
    longer pieces first. Pieces of equal length are taken in a hashed order that
    is the same in every run. ``pieces`` should be stored: it is read twice.
    """
    spark = pieces.sparkSession
    counts = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # one row for each length up to window
    rows, _ = plan(counts, window, classes)
    # bounded by the window: a few rows for each length and combination
    table = F.broadcast(small_table(spark, rows, "length long, low long, high long, each long, first long"))
    at = ranked(pieces, ["length"], ["doc_id", "start"])
    placed = at.join(table, [at["length"] == table["length"], at["rank"] >= table["low"], at["rank"] < table["high"]]).select(
        *[at[c] for c in pieces.columns], (F.col("first") + F.floor((F.col("rank") - F.col("low")) / F.col("each"))).cast("long").alias("sequence_id")
    )
    before = Window.partitionBy("sequence_id").orderBy(F.col("length").desc(), "doc_id", "start").rowsBetween(Window.unboundedPreceding, -1)
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0)).cast("long"))


def pack_documents(docs: DataFrame, tokenizer: str, window: int = 4096, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False, lean: bool = False) -> DataFrame:
    """Cut and pack ``docs``; one row for each piece.

    A null or empty text is a document of one id, ``end_id``. Rows that repeat a
    doc_id, and those of a null one, are documents of their own. Empty tables give empty results; other
    columns of ``docs`` are ignored. Pieces, with their ids only if asked for,
    are stored in the shared folder between the two passes. ``lean``: workers remember
    fewer words, and none from task to task; that costs time and changes no result.
    """
    return pack(stored(cut(docs, tokenizer, window, end_id, id_col, text_col, with_ids, lean), "pack-pieces"), window)
