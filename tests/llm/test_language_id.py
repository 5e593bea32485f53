import math
import unicodedata
import zlib
from itertools import combinations

import numpy as np
from fixtures import SCHEMA, documents

from sedge.llm import language_id


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(got) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got)
    held = [r for r in got if r.held_out and r.lang_pred != "und"]
    assert len(held) > 100 and np.mean([r.lang == r.lang_pred for r in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_awkward_rows(spark):
    df = spark.createDataFrame(documents(), SCHEMA)
    got = {r.doc_id: r for r in language_id.identify(df).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und"
    assert {r.lang_pred for r in got.values()} <= {"und", "en", "de"}
    assert language_id.identify(df.limit(0)).collect() == []
    none = language_id.identify(df.withColumn("lang", df["lang"].substr(9, 1)).filter("false")).collect()
    assert none == []


def test_nothing_or_one_language_learned(spark):
    rows = [(i, "some words here", None, None, None, None, 1, 1, 1) for i in range(20)]
    assert {(r.lang_pred, r.score) for r in language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()} == {("und", 0.0)}
    rows = [(i, "some words here", "xx", None, None, None, 1, 1, 1) for i in range(20)]
    assert {r.lang_pred for r in language_id.identify(spark.createDataFrame(rows, SCHEMA)).collect()} == {"xx"}


def test_votes():
    vote = language_id.Vote(["a", "b", "c"], np.array([[1.0, 0], [1, 0], [0, 1]]), np.zeros(3))
    best, score = vote.decide(np.array([[5.0, 0], [-5, 5], [-5, -5]]))
    assert best.tolist() == [0, 1, 2] and (score > 0.9).all()


def brute_features(text):
    """Letter pairs and triples counted one by one."""
    letters = " ".join("".join(c if unicodedata.category(c)[0] == "L" else " " for c in (text or "").lower()).split())
    if not letters:
        return None
    data, m = f" {letters} ".encode(), 1 << 32
    counts = [0] * language_id.DIMENSIONS
    pair = lambda i: (data[i] * 0x01000193 + data[i + 1] * 0x85EBCA6B) % m
    codes = [pair(i) for i in range(len(data) - 1)] + [(pair(i) * 0xC2B2AE35 + data[i + 2] * 0x27D4EB2F) % m for i in range(len(data) - 2)]
    for c in codes:
        c ^= c >> 15
        counts[(c * 0x9E3779B1 % m) * language_id.DIMENSIONS // m] += 1
    return [math.sqrt(n / len(codes)) for n in counts]


def brute_vote(vote, x):
    """Every pair of classes plays once; most wins, then the sum of probabilities."""
    wins, least = {c: 0.0 for c in vote.classes}, {c: 1.0 for c in vote.classes}
    for k, (one, two) in enumerate(combinations(vote.classes, 2)):
        margin = sum(float(w) * v for w, v in zip(vote.weights[k], x, strict=True)) + float(vote.bias[k])
        p = 1 / (1 + math.exp(-3 * max(-20, min(20, margin))))
        for c, q in ((one, p), (two, 1 - p)):
            wins[c] += (q > 0.5) + q / (2 * len(vote.classes))
            least[c] = min(least[c], q)
    best = max(vote.classes, key=lambda c: wins[c])
    return best, least[best]


def test_predictions_by_plain_loops(spark):
    """Family first, then language within it, counted and voted one by one."""
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    model = language_id.fit(docs.select(docs["doc_id"].alias("order"), "text", "lang"))
    assert len(model.within) > 1
    for r in language_id.predict(docs, model).collect():
        x = brute_features(r.text)
        if x is None:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        family, p = brute_vote(model.family, x)
        lang, q = brute_vote(model.within[model.family.classes.index(family)], x)
        assert r.lang_pred == lang and abs(r.score - p * q) < 1e-3


def test_letters_are_letters(spark):
    """Numbers and marks of any kind are none; null or no letter: und."""
    texts = ["\u00bd", "\u00b2 \u00b3", "\u2460", "12 \u0301 _ !", "", None, "\u2160", "\u00aa", "\u4e2d", "\u00bd x"]
    rows = [(i, "some words here", ["xx", "yy"][i % 2], "old", 2.0) for i in range(20)] + [(100 + i, t, None, "old", 2.0) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, lang_pred string, score double")
    got = {r.doc_id - 100: r.lang_pred for r in language_id.identify(df).collect() if r.doc_id >= 100}
    assert [i for i, p in sorted(got.items()) if p != "und"] == [7, 8, 9]
    model = language_id.fit(df.select(df["doc_id"].alias("order"), "text", "lang"))
    again = language_id.predict(df, model)
    assert again.columns == ["doc_id", "text", "lang", "lang_pred", "score"] and "old" not in {r.lang_pred for r in again.collect()}
    assert language_id.features("\u00bd") is None and language_id.features("a\u00bdb") is not None


def test_families_hold_each_code_once():
    codes = [c for own in language_id.FAMILIES.values() for c in own]
    assert len(codes) == len(set(codes)) == len(language_id.FAMILY) > 90


def test_hinge_is_least():
    """No small step from the solution makes the objective smaller."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(200, 5))
    y = np.where(x @ [1, -2, 0.5, 0, 0] + rng.normal(size=200) > 0, 1.0, -1.0)
    w = language_id.hinge(x, y, ridge=0.01, passes=500, enough=1e-5)
    loss = lambda w: np.maximum(0, 1 - y * (x @ w[:-1] + w[-1])).mean() + 0.005 * w @ w
    assert all(loss(w + rng.normal(size=6) * 0.02) >= loss(w) - 1e-6 for _ in range(300))
    assert (language_id.hinge(x, y, ridge=0.01) == language_id.hinge(x, y, ridge=0.01)).all()
