import random
import re
import zlib

import numpy as np
from fixtures import SCHEMA, documents, prose

from sedge.llm import toxicity


def words(text):
    return re.findall(rb"[a-z0-9\x80-\xff]+", text.lower())


def test_windows_cover_every_word():
    texts = [b"", b"one", b"Two, words!", b" ".join(b"w%d" % (i % 70) for i in range(200)), "ÄÖ été".encode(), b"x" * 500]
    w = toxicity.windows(texts)
    names = {}
    for k, text in enumerate(texts):
        own, n = words(text), len(words(text))
        starts = [0] if n else []
        while starts and starts[-1] + toxicity.WINDOW < n:
            starts.append(starts[-1] + toxicity.STRIDE)
        rows = np.flatnonzero(w.text == k)
        assert len(rows) == len(starts)
        for row, start in zip(rows, starts, strict=True):
            want = own[start : start + toxicity.WINDOW]
            got = w.at[row].tolist()
            assert got[len(want) :] == [len(w.words)] * (toxicity.WINDOW - len(want))
            for i, word in zip(got, want, strict=False):
                assert names.setdefault(i, word) == word and w.starts[i + 1] - w.starts[i] == len(word)
    assert len(set(names.values())) == len(names) == len(w.words)


def test_gradients_are_the_slopes_of_the_loss():
    net = toxicity.Network({k: v.astype(np.float64) for k, v in toxicity.Network.new().weights.items()})
    w = toxicity.windows([b"alpha beta gamma delta epsilon", b" ".join(b"w%d" % i for i in range(60))])
    args = (w.words, w.chars, w.starts, w.at, np.arange(len(w.at)) % 2, np.linspace(0.5, 1, len(w.at)), (np.arange(len(w.words)) % 3 > 0).astype(float))
    _, g = net.gradients(*args)
    rng = np.random.default_rng(1)
    for name, v in net.weights.items():
        for at in [np.unravel_index(np.abs(g[name]).argmax(), v.shape), *(tuple(rng.integers(0, n) for n in v.shape) for _ in range(3))]:
            old, near = v[at], []
            for step in (1e-5, -1e-5):
                v[at] = old + step
                near.append(net.gradients(*args)[0])
            v[at] = old
            assert abs((near[0] - near[1]) / 2e-5 - g[name][at]) < 1e-6 + 1e-4 * abs(g[name][at]), name


def test_plain_loops_give_the_same_odds():
    net = toxicity.Network.new()
    p = {k: v.astype(np.float64) for k, v in net.weights.items()}
    text = b"some words of a text, which is longer than one window " * 6
    w, h = toxicity.windows([text]), toxicity.HIDDEN
    bend = lambda x: x / (1 + np.abs(x))
    x = net.inputs(w.words, w.chars, w.starts).astype(np.float64)
    want = []
    for row in w.at:
        row = [i for i in row.tolist() if i < len(w.words)]
        said = []
        for k in range(2):
            s, out = np.zeros(h), []
            for i in row if k == 0 else row[::-1]:
                a, b = x[i] @ p["w"][k] + p["b"][k], s @ p["u"][k]
                z, r = (1 + bend(a[:h] + b[:h])) / 2, (1 + bend(a[h : 2 * h] + b[h : 2 * h])) / 2
                s = (1 - z) * bend(a[2 * h :] + r * b[2 * h :]) + z * s
                out.append(s)
            said.append(out if k == 0 else out[::-1])
        both = np.concatenate([np.array(said[0]), np.array(said[1])], axis=1)
        score = np.exp(bend(both @ p["a"] + p["d"]) @ p["v"])
        want.append((score / score.sum()) @ both @ p["o"] + p["p"][0])
    assert np.allclose(net.odds(w), want, atol=1e-4)


def test_long_texts_in_pieces(monkeypatch):
    net, rng = toxicity.Network.new(), random.Random(3)
    text = prose(rng, 2000).encode()
    whole = set(words(text))
    monkeypatch.setattr(toxicity, "GROUP_BYTES", 500)
    parts = toxicity.pieces(text)
    assert len(parts) > 5 and {x for p in parts for x in words(p)} == whole
    for a, b in zip(parts, parts[1:], strict=False):
        assert words(b)[: toxicity.WINDOW] == words(a)[-toxicity.WINDOW :]
    assert all(len(p) < 2000 for p in toxicity.pieces(b"x" * 10000))
    each = max(float(net.odds(toxicity.windows([p])).max()) for p in parts)
    got = toxicity.scores(net, 0.5, [text, b"", text[:50]])
    assert abs(got[0] - 1 / (1 + np.exp(-each))) < 1e-6 and got[1] == 0.5


def labelled(n=2400):
    """Texts of which those with one of a few words are toxic, one word of it in a long text too."""
    rng, bad = random.Random(2), ["vile", "rotten", "nasty"]
    rows, labels = [], []
    for i in range(n):
        own, toxic = prose(rng, rng.choice([5, 40, 100])).split(), i % 4 == 0
        if toxic:
            for _ in range(2):
                own.insert(rng.randrange(len(own) + 1), rng.choice(bad))
        rows.append((i, " ".join(own)))
        labels.append((i, int(toxic)))
    return rows, labels


def test_held_out_texts(spark):
    rows, labels = labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = {r.doc_id: r for r in toxicity.score(docs, spark.createDataFrame(labels, "doc_id long, toxic int")).collect()}
    assert len(got) == len(rows) and all(got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, _ in rows)
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got.values())
    held = [(y, got[i].predicted) for i, y in labels if got[i].held_out]
    assert len(held) > 400 and sum(y == p for y, p in held) >= 0.95 * len(held)


def test_awkward_rows(spark):
    rows = [*documents(), (None, "vile rotten", None, None, None, "k", 1, 2, 3), (2**60 + 1, "vile rotten", None, None, None, "k", 1, 2, 3), (2**60 + 3, "x", None, None, None, "k", 1, 2, 3)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1).withColumnsRenamed({"key": "label", "rank": "held_out", "copies": "score"})
    labels = spark.createDataFrame([(1, None), (None, 1), (2, 7), (3, 0), (5, 1), (5, 0), (9, 1), (12, 0), (13, 0), (5, 1)], "doc_id long, toxic int")
    first, again = (sorted(map(tuple, toxicity.score(docs, labels).collect()), key=repr) for _ in range(2))
    assert first == again and len(first) == len(rows)
    assert sorted((r[0] is None, r[0] or 0) for r in first) == sorted((r[0] is None, r[0] or 0) for r in rows)
    share = next(r[2] for r in first if r[0] == 0)
    assert 0 < share < 1 and all(r[2] == share for r in first if r[0] in (0, 1, 2))


def test_nothing_to_learn(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert sorted(tuple(r) for r in toxicity.score(docs, none).select("doc_id", "score", "predicted").collect()) == [(1, 0.0, 0), (2, 0.0, 0)]
    assert toxicity.score(docs.limit(0), none).collect() == []
    far = spark.createDataFrame([(77, 1), (78, 0)], "doc_id long, toxic int")
    assert toxicity.score(docs, far).count() == 2
