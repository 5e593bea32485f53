"""Toxicity by a bidirectional gated recurrent network with attention, in numpy.

A text is read in overlapping windows of words. A word enters as vectors of its hash and of
its character triples; a gated recurrent layer reads the window in each direction, attention
pools what both say at each word, and a linear unit gives the window's odds. A text is as
toxic as its worst window, in learning too: each text teaches by the window that the
network finds worst so far. All windows of all texts are scored.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge.llm.hashing import text_hashes
from sedge.llm.shared import trimmed

#: Words of a window, and between the starts of two.
WINDOW, STRIDE = 32, 24
#: Rows and lengths of the vectors of words and of character triples.
WORD_ROWS, CHAR_ROWS, WORD_DIM, CHAR_DIM = 1 << 14, 1 << 12, 12, 12
#: Units of each direction and of the attention.
HIDDEN, ATTEND = 16, 8
#: Labelled texts that a fit uses at most, of each label, and bytes of each such text.
TOXIC, CLEAN, SAMPLE_BYTES = 1000, 2000, 1 << 16
#: Texts of a step, passes over the sample at least and at most, and steps wanted.
BATCH, LEAST_PASSES, MOST_PASSES, STEPS = 64, 10, 30, 500
RATE, DECAY, DROPPED, SEED = 4e-3, 1e-5, 0.3, 11
#: Windows that are computed at once, and bytes of the texts whose words are numbered together.
ROWS, GROUP_BYTES = 1024, 1 << 20
#: What makes the gate keep its state where a window has no word.
_KEEP = 1e7

_TO_WORDS = bytes(c if c >= 0x80 or chr(c).isalnum() else 0x20 for c in range(256)).lower()


@dataclass
class Windows:
    """Windows of some texts over the table of their different words.

    ``chars``: rows of the character triples of all words, of word i from ``starts[i]`` to
    ``starts[i + 1]``. ``at``: words of each window, the number of words where it has none.
    ``text``: the text of each window, in order.
    """

    words: np.ndarray
    chars: np.ndarray
    starts: np.ndarray
    at: np.ndarray
    text: np.ndarray


def windows(texts: list[bytes]) -> Windows:
    """Words are runs of ASCII letters and digits and bytes of other characters."""
    parts = [t.translate(_TO_WORDS) for t in texts]
    raw = b" " + b" ".join(parts) + b" "
    b = np.frombuffer(raw, dtype=np.uint8)
    edges = np.flatnonzero((b[1:] != 0x20) != (b[:-1] != 0x20)) + 1
    first, end = edges[::2], edges[1::2]
    known, where, word = np.unique(text_hashes(raw), return_index=True, return_inverse=True)
    lengths = end[where] - first[where]
    starts = np.concatenate([[0], np.cumsum(lengths)])
    # a word's triples are those around each of its bytes, with a space at either side
    at = np.arange(starts[-1]) + np.repeat(first[where] - 1 - starts[:-1], lengths)
    wide = b.astype(np.uint32)
    code = wide[at] * np.uint32(0x01000193) + wide[at + 1] * np.uint32(0x85EBCA6B) + wide[at + 2] * np.uint32(0xC2B2AE35)
    chars = (code ^ code >> np.uint32(15)) * np.uint32(0x9E3779B1) >> np.uint32(32 - CHAR_ROWS.bit_length() + 1)
    hashed = np.stack([known % np.uint64(WORD_ROWS), (known >> np.uint64(32)) % np.uint64(WORD_ROWS)], axis=1).astype(np.int64)

    begins = np.cumsum([0] + [len(p) + 1 for p in parts[:-1]]) + 1
    low = np.searchsorted(first, begins)
    n = np.diff(np.append(low, len(first)))
    many = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    text = np.repeat(np.arange(len(texts)), many)
    start = low[text] + STRIDE * (np.arange(len(text)) - np.repeat(np.cumsum(many) - many, many))
    place = start[:, None] + np.arange(WINDOW)
    inside = place < (low + n)[text][:, None]
    return Windows(hashed, chars.astype(np.int64), starts, np.where(inside, word[np.where(inside, place, 0)] if len(word) else 0, len(known)).astype(np.int32), text)


def pieces(text: bytes) -> list[bytes]:
    """``text``, its words parted by spaces, in parts of about ``GROUP_BYTES``, each but the first with a window's words of the one before."""
    if len(text) <= 2 * GROUP_BYTES:
        return [text]
    out, at = [], 0
    while at < len(text):
        end = at + GROUP_BYTES
        cut = text.find(b" ", end) if end < len(text) else -1
        cut = cut if 0 <= cut < end + GROUP_BYTES else min(end, len(text))  # a longer word is cut
        tail = out[-1].split()[-WINDOW:] if out else []
        kept = b" ".join(tail) + b" " if tail and sum(map(len, tail)) < GROUP_BYTES else b""
        out.append(kept + text[at:cut])
        at = cut
    return out


def squash(x: np.ndarray) -> None:
    """x / (1 + |x|) in place: it bends like a hyperbolic tangent and takes a fifth of its time."""
    size = np.abs(x)
    size += 1
    x /= size


def add_rows(to: np.ndarray, at: np.ndarray, rows: np.ndarray) -> None:
    """Add ``rows`` to rows ``at`` of ``to``, which may repeat."""
    order = np.argsort(at, kind="stable")
    own = at[order]
    first = np.flatnonzero(np.r_[True, own[1:] != own[:-1]])
    to[own[first]] += np.add.reduceat(rows[order], first, axis=0)


def slope(y: np.ndarray) -> np.ndarray:
    """The derivative of ``squash`` where it gave ``y``."""
    return (1 - np.abs(y)) ** 2


class Network:
    """Weights by name, as float32: inputs e, c; for both directions (first axis) w, b, u;
    attention a, d, v; output o, p."""

    def __init__(self, weights: dict[str, np.ndarray]):
        self.weights = weights

    @classmethod
    def new(cls, seed: int = SEED) -> Network:
        rng, d = np.random.default_rng(seed), WORD_DIM + CHAR_DIM
        normal = lambda scale, *shape: (rng.standard_normal(shape) * scale).astype(np.float32)
        return cls({
            "e": normal(0.02, WORD_ROWS, WORD_DIM), "c": normal(0.1, CHAR_ROWS, CHAR_DIM),
            "w": normal(d**-0.5, 2, d, 3 * HIDDEN), "b": normal(0.0, 2, 3 * HIDDEN), "u": normal(HIDDEN**-0.5, 2, HIDDEN, 3 * HIDDEN),
            "a": normal((2 * HIDDEN) ** -0.5, 2 * HIDDEN, ATTEND), "d": normal(0.0, ATTEND), "v": normal(ATTEND**-0.5, ATTEND),
            "o": normal((2 * HIDDEN) ** -0.5, 2 * HIDDEN), "p": np.full(1, -2.0, dtype=np.float32),
        })

    def inputs(self, words: np.ndarray, chars: np.ndarray, starts: np.ndarray) -> np.ndarray:
        """Each word's vector: the sum of two of its hash, and the mean of its triples'."""
        e, c = self.weights["e"], self.weights["c"]
        out = np.empty((len(words), WORD_DIM + CHAR_DIM), dtype=e.dtype)
        out[:, :WORD_DIM] = e[words[:, 0]] + e[words[:, 1]]
        lengths = np.diff(starts)
        long = np.flatnonzero(lengths > CHAR_ROWS)
        for i in long:
            out[i, WORD_DIM:] = np.bincount(chars[starts[i] : starts[i + 1]], minlength=CHAR_ROWS).astype(e.dtype) @ c
        edges = np.concatenate([[-1], long, [len(words)]])
        for a, z in zip(edges[:-1] + 1, edges[1:], strict=True):
            for i in range(a, z, 16384):
                j = min(z, i + 16384)
                out[i:j, WORD_DIM:] = np.add.reduceat(c[chars[starts[i] : starts[j]]], starts[i:j] - starts[i], axis=0)
        out[:, WORD_DIM:] /= np.maximum(lengths, 1)[:, None]
        return out

    def projected(self, x: np.ndarray) -> list[np.ndarray]:
        """For each direction what each word adds to its gates; a last row for no word."""
        w, out = self.weights, []
        for k in range(2):
            table = np.zeros((len(x) + 1, 3 * HIDDEN), dtype=x.dtype)
            table[:-1] = x @ w["w"][k] + w["b"][k]
            table[-1, :HIDDEN] = _KEEP
            out.append(table)
        return out

    def states(self, tables: list[np.ndarray], at: np.ndarray, keep: list | None = None) -> np.ndarray:
        """(place, 2 * HIDDEN, window) what both directions say at each place."""
        out = np.empty((WINDOW, 2 * HIDDEN, len(at)), dtype=tables[0].dtype)
        by_place = np.ascontiguousarray(at.T)
        for k in range(2):
            u = np.ascontiguousarray(self.weights["u"][k].T)
            h = np.zeros((HIDDEN, len(at)), dtype=out.dtype)
            for t in range(WINDOW) if k == 0 else range(WINDOW - 1, -1, -1):
                x, g = tables[k].take(by_place[t], axis=0).T, u @ h
                gates = x[: 2 * HIDDEN] + g[: 2 * HIDDEN]
                squash(gates)
                gates += 1
                gates *= 0.5
                z, r = gates[:HIDDEN], gates[HIDDEN:]
                new = r * g[2 * HIDDEN :]
                new += x[2 * HIDDEN :]
                squash(new)
                if keep is not None:
                    keep.append((k, t, h, z, r, new, g[2 * HIDDEN :]))
                h = h - new
                h *= z
                h += new
                out[t, k * HIDDEN : (k + 1) * HIDDEN] = h
        return out

    def pooled(self, states: np.ndarray, none: np.ndarray) -> tuple[np.ndarray, ...]:
        """Odds of each window, and what they come from."""
        w = self.weights
        said = np.ascontiguousarray(w["a"].T) @ states
        said += w["d"][:, None]
        squash(said)
        score = w["v"] @ said
        score[none] = -np.inf
        share = np.exp(score - score.max(axis=0))
        share /= share.sum(axis=0)
        context = np.einsum("tn,tkn->kn", share, states)
        return w["o"] @ context + w["p"][0], context, share, said

    def odds(self, w: Windows) -> np.ndarray:
        """Of each window."""
        tables = self.projected(self.inputs(w.words, w.chars, w.starts))
        out = np.empty(len(w.at), dtype=tables[0].dtype)
        for i in range(0, len(out), ROWS):
            at = w.at[i : i + ROWS]
            out[i : i + ROWS] = self.pooled(self.states(tables, at), (at == len(w.words)).T)[0]
        return out

    def gradients(self, words: np.ndarray, chars: np.ndarray, starts: np.ndarray, at: np.ndarray, label: np.ndarray, weight: np.ndarray, kept: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Weighted log loss of windows ``at``, and its gradients. ``kept``: 0 for words
        whose vector by hash is left out."""
        w = self.weights
        x = self.inputs(words, chars, starts)
        x[:, :WORD_DIM] *= kept[:, None]
        keep: list = []
        states = self.states(self.projected(x), at, keep)
        odds, context, share, said = self.pooled(states, (at == len(words)).T)
        p = 1 / (1 + np.exp(-np.clip(odds, -60, 60)))
        loss = float((weight * (np.logaddexp(0, odds) - label * odds)).sum())
        g = {k: np.zeros_like(v) for k, v in w.items()}
        d_odds = (weight * (p - label)).astype(x.dtype)
        g["o"], g["p"] = context @ d_odds, d_odds.sum(keepdims=True)
        d_context = w["o"][:, None] * d_odds
        d_states = share[:, None] * d_context
        d_share = np.einsum("kn,tkn->tn", d_context, states)
        d_score = share * (d_share - (share * d_share).sum(axis=0))
        g["v"] = np.einsum("tn,tkn->k", d_score, said)
        d_said = d_score[:, None] * w["v"][:, None] * slope(said)
        g["a"], g["d"] = np.einsum("tin,tjn->ij", states, d_said), d_said.sum(axis=(0, 2))
        d_states += w["a"] @ d_said
        d_tables = np.zeros((2, len(words) + 1, 3 * HIDDEN), dtype=x.dtype)
        sums: list = []
        d_h, direction = np.zeros((HIDDEN, len(at)), dtype=x.dtype), 1
        for k, t, h, z, r, new, held in reversed(keep):
            if k != direction:
                d_h, direction = np.zeros_like(d_h), k
            d_h = d_h + d_states[t, k * HIDDEN : (k + 1) * HIDDEN]
            d_new = d_h * (1 - z) * slope(new)
            d_gates = np.concatenate([d_h * (h - new) * slope(2 * z - 1) / 2, d_new * held * slope(2 * r - 1) / 2, d_new])
            sums.append((k, at[:, t], d_gates.T))
            d_gates = np.concatenate([d_gates[: 2 * HIDDEN], d_new * r])
            g["u"][k] += h @ d_gates.T
            d_h = d_h * z + w["u"][k] @ d_gates
        d_x = np.zeros_like(x)
        for k in range(2):
            own = [y for y in sums if y[0] == k]
            add_rows(d_tables[k], np.concatenate([y[1] for y in own]), np.concatenate([y[2] for y in own]))
            g["w"][k], g["b"][k] = x.T @ d_tables[k, :-1], d_tables[k, :-1].sum(axis=0)
            d_x += d_tables[k, :-1] @ w["w"][k].T
        d_word = d_x[:, :WORD_DIM] * kept[:, None]
        add_rows(g["e"], words.T.ravel(), np.concatenate([d_word, d_word]))
        lengths = np.diff(starts)
        add_rows(g["c"], chars, np.repeat(d_x[:, WORD_DIM:] / lengths[:, None], lengths, axis=0))
        return loss, g

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, **self.weights)
        return out.getvalue()

    @classmethod
    def unpacked(cls, data: bytes) -> Network:
        with np.load(io.BytesIO(data)) as found:
            return cls({k: found[k] for k in found.files})


def worst(odds: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """For each text the number of its window with the highest odds, -1 without one."""
    order = np.lexsort((-odds, text))
    first = np.r_[True, text[order][1:] != text[order][:-1]] if len(order) else np.empty(0, bool)
    out = np.full(n, -1)
    out[text[order][first]] = order[first]
    return out


def train(texts: list[bytes], labels: np.ndarray, weights: np.ndarray, seed: int = SEED) -> Network:
    """Learn from whole ``texts``, by Adam with falling steps. In the first two passes texts
    teach by windows chosen at random, then by the worst. The same in every run."""
    net, rng = Network.new(seed), np.random.default_rng(seed)
    groups = list(grouped(texts))
    found = [(g[0], windows(g[1])) for g in groups]
    each = [(k, i, labels[at], weights[at]) for k, (rows, _) in enumerate(found) for i, at in enumerate(rows) if (found[k][1].text == i).any()]
    if not each:
        return net
    passes = int(np.clip(-(-STEPS * BATCH // len(each)), LEAST_PASSES, MOST_PASSES))
    total = passes * -(-len(each) // BATCH)
    first, second = ({k: np.zeros_like(v) for k, v in net.weights.items()} for _ in range(2))
    step = 0
    mean = float(np.mean([x[3] for x in each])) or 1.0
    for turn in range(passes):
        top = []
        for rows, w in found:
            by = rng.random(len(w.at)) if turn < 2 else net.odds(w)
            top.append(worst(by, w.text, len(rows)))
        order = rng.permutation(len(each))
        for i in range(0, len(each), BATCH):
            chosen = [each[j] for j in order[i : i + BATCH]]
            words, chars, at = [], [], []
            seen: dict[tuple[int, int], int] = {}
            for k, text, _, _ in chosen:
                w = found[k][1]
                row = []
                for word in w.at[top[k][text]].tolist():
                    if word == len(w.words):
                        row.append(-1)
                    elif (k, word) in seen:
                        row.append(seen[k, word])
                    else:
                        row.append(seen.setdefault((k, word), len(seen)))
                        words.append(w.words[word])
                        chars.append(w.chars[w.starts[word] : w.starts[word + 1]])
                at.append(row)
            at_ = np.array(at)
            at_[at_ < 0] = len(words)
            kept = (rng.random(len(words)) >= DROPPED).astype(np.float32)
            weight = np.array([x[3] for x in chosen]) / (mean * len(chosen))
            _, g = net.gradients(np.array(words), np.concatenate(chars), np.concatenate([[0], np.cumsum([len(c) for c in chars])]), at_, np.array([x[2] for x in chosen]), weight, kept)
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            step += 1
            rate = RATE * min(1.0, 1.5 * (1 - (step - 1) / total))
            for name, v in net.weights.items():
                d = g[name] * min(1.0, 5.0 / max(norm, 1e-9)) + DECAY * v
                first[name] = 0.9 * first[name] + 0.1 * d
                second[name] = 0.99 * second[name] + 0.01 * d * d
                v -= (rate * first[name] / (1 - 0.9**step) / (np.sqrt(second[name] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return net


def grouped(texts: list[bytes]) -> Iterator[tuple[list[int], list[bytes]]]:
    """Numbers and texts, of ``GROUP_BYTES`` or a little more at once; a long text in pieces."""
    rows: list[int] = []
    held: list[bytes] = []
    size = 0
    for i, text in enumerate(texts):
        for part in pieces(text.translate(_TO_WORDS)):
            rows.append(i)
            held.append(part)
            size += len(part)
            if size >= GROUP_BYTES:
                yield rows, held
                rows, held, size = [], [], 0
    if rows:
        yield rows, held


def scores(net: Network | None, share: float, texts: list[bytes]) -> np.ndarray:
    """Of each text the highest probability of its windows; ``share`` without a word."""
    out = np.full(len(texts), -np.inf)
    if net is not None:
        for rows, held in grouped(texts):
            w = windows(held)
            if len(w.at):
                np.maximum.at(out, np.array(rows)[w.text], net.odds(w).astype(np.float64))
    return np.where(np.isneginf(out), share, 1 / (1 + np.exp(-np.clip(out, -60, 60))))


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TOXIC, clean: int = CLEAN) -> tuple[bytes | None, float]:
    """The network, packed, and the share of label 1; (None, share) if no labelled text is found.

    Learns from documents that are not held out: at most ``toxic`` and ``clean`` texts with
    label 1 and 0, chosen by a hash of the id, of at most ``SAMPLE_BYTES`` each; the loss
    weighs them as the labels have them. These are the only bounds of this module.
    """
    known = labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("label")).filter("doc_id is not null and label in (0, 1)").filter(~held_out())
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if not counts:
        return None, 0.0
    share = counts.get(1, 0) / sum(counts.values())
    most = {1: toxic, 0: clean}
    place = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).filter(F.octet_length("text") <= SAMPLE_BYTES)
    parts = []
    for label, n in most.items():
        # bounded twice: ids may lack a text, and rows may repeat an id
        ids = known.filter(F.col("label") == label).orderBy(place, "doc_id").limit(n)
        parts.append(texts.join(F.broadcast(ids), "doc_id").withColumn("place", place).orderBy("place", "doc_id", F.xxhash64("text")).limit(n))
    sample = parts[0].unionByName(parts[1]).coalesce(1)

    def learn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows = sorted((p, y, t) for b in batches for p, y, t in zip(b["place"].tolist(), b["label"].tolist(), b["text"].tolist(), strict=True))
        if rows:
            y = np.array([r[1] for r in rows])
            weights = np.where(y == 1, share / max(1, (y == 1).sum()), (1 - share) / max(1, (y == 0).sum()))
            net = train([r[2].encode("utf-8", "surrogatepass") for r in rows], y, weights)
            yield pd.DataFrame({"net": [net.packed()]})

    found = sample.select("place", "label", "text").mapInPandas(trimmed(learn), "net binary").first()  # one network
    return (bytes(found["net"]) if found else None), share


def score(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", toxic: int = TOXIC, clean: int = CLEAN) -> DataFrame:
    """doc_id, held_out, score, predicted for every row of ``docs``.

    ``labels`` (doc_id, label) name texts with label 1 or 0; other and null labels and ids
    teach nothing, of several labels of an id the highest counts. score is between 0 and 1,
    higher where label 1 is likelier; predicted is 1 from 0.5 on. A text without a word, null
    and empty ones too, has the share of label 1 among the labels, as every text has if
    nothing could be learned. A null id is held out as its hash says; rows that repeat
    an id are scored by their own texts. Whole texts are read; those over 2 MB in pieces that
    overlap by a window. Empty tables give empty results; other columns are ignored.
    """
    packed, share = fit(docs, labels, id_col, text_col, label_col, toxic, clean)
    shared = docs.sparkSession.sparkContext.broadcast(packed)  # the network's weights, a megabyte

    @F.pandas_udf("double")
    def judge(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        yield from trimmed(judged)(batches)

    def judged(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        net = Network.unpacked(shared.value) if shared.value else None
        for texts in batches:
            yield pd.Series(scores(net, share, [(t or "").encode("utf-8", "surrogatepass") for t in texts.tolist()]))

    rows = docs.select(F.col(id_col).alias("doc_id"), held_out(id_col).alias("held_out"), judge.asNondeterministic()(F.col(text_col)).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
