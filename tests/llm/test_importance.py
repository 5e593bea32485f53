import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
from fixtures import SCHEMA, documents

from sedge.llm import importance

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, target, percent, n, buckets, least):
    def grams(text):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        return len(words), [zlib.crc32(" ".join(words[i : i + m]).encode()) % buckets for m in range(1, n + 1) for i in range(len(words) - m + 1)]

    s, t = Counter(), Counter()
    for r in rows:
        s.update(grams(r[1])[1])
    for text in target:
        t.update(grams(text)[1])
    gain = [math.floor(1000 * math.log((t[b] + 1) * (s.total() + buckets) / ((s[b] + 1) * (t.total() + buckets)))) for b in range(buckets)]
    out = []
    for i, text, *_ in rows:
        words, own = grams(text)
        h = int(hashlib.sha256(f"2024:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        weight = sum(gain[b] for b in own)
        out.append((i, words, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((x for x in out if x[1] >= least), key=lambda x: (-x[4], x[0] is None, x[0] or 0))
    chosen = Counter((x[0], x[2], x[3], x[4], k) for k, x in enumerate(able[: percent * len(able) // 100], 1))
    return Counter((x[0], x[2], x[3], x[4]) for x in out), chosen


def check(spark, rows, schema, target, percent=10, n=1, buckets=10000, least=20):
    docs = spark.createDataFrame(rows, schema).repartition(5)
    goal = spark.createDataFrame([(i, t) for i, t in enumerate(target)], "item_id long, text string")
    got = [tuple(r) for r in importance.resample(docs, goal, percent=percent, n=n, buckets=buckets, least_words=least).collect()]
    every, chosen = brute(rows, target, percent, n, buckets, least)
    assert Counter(r[:4] for r in got) == every
    assert Counter(r for r in got if r[4] is not None) == chosen


def test_matches_brute_force(spark):
    rows = documents()
    target = [None, "", rows[5][1], "A-Z äÖ 007 x\x00y", rows[14][1]]
    check(spark, rows, SCHEMA, target, percent=40)
    check(spark, rows, SCHEMA, target, percent=100, n=3, buckets=977, least=0)


def test_large_ids_nulls_and_ties(spark):
    ids = [None, 2**60 + 1, 2**60 + 3, 2**60 + 5, 2**60 + 1, None, -(2**63)]
    text = " ".join(f"word{i}" for i in range(30))
    check(spark, [(i, text) for i in ids], "doc_id long, text string", [text], percent=90)


def test_empty(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    some = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    assert importance.resample(empty, some).collect() == []
    assert [tuple(r)[:2] for r in importance.resample(some, empty).collect()] == [(1, 2)]


def test_long_texts_in_slices(spark, monkeypatch):
    text = " ".join(f"w{i % 50}" for i in range(3000))
    whole = importance.counted(text.encode(), 3, 1000)
    monkeypatch.setattr(importance, "SLICE", 64)
    cut = importance.counted(text.encode(), 3, 1000)
    assert whole[:2] == cut[:2] and np.array_equal(whole[2], cut[2]) and np.array_equal(whole[3], cut[3])


def test_blocks(spark, monkeypatch):
    rows = [(i, f"a b{i} c{i % 7}") for i in range(50)]
    matrix = importance.count_matrix(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), 1, 100)
    r = matrix.first()
    starts, at, counts = np.frombuffer(r["starts"], "<i8"), np.frombuffer(r["buckets"], "<u4"), np.frombuffer(r["counts"], "<i8")
    for i, own in enumerate(r["doc_ids"]):
        assert dict(zip(at[starts[i] : starts[i + 1]].tolist(), counts[starts[i] : starts[i + 1]].tolist(), strict=True)) == Counter(zlib.crc32(w.encode()) % 100 for w in rows[own][1].split())
    assert importance.column_sums(matrix, 100).sum() == 150
