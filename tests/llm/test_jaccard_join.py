import random
import re

import numpy as np
import pytest
from fixtures import SCHEMA, documents, prose

from sedge.llm import jaccard_join


def brute(rows, n, percent):
    def shingle(t):
        w = re.sub("[A-Z]", lambda m: m.group().lower(), t or "").encode().split()
        return frozenset([tuple(w)] if 0 < len(w) < n else [tuple(w[i : i + n]) for i in range(len(w) - n + 1)])

    sets = [shingle(r[1]) for r in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, r in enumerate(rows):
        least[find(i)] = min(least.get(find(i), r[0]), r[0])
    return sorted((r[0], len(sets[i]), least[find(i)]) for i, r in enumerate(rows))


def edited(rng, words, k):
    words = words.copy()
    for _ in range(k):
        words[rng.randrange(len(words))] = prose(rng, 1)
    return " ".join(words)


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_matches_brute_force(spark, n, percent):
    rng = random.Random(n)
    rows = [r[:2] for r in documents()]
    for length in (7, 12, 30, 80, 200, 900):
        for g in range(4):
            words = prose(rng, length).split()
            rows += [(1000 * length + 10 * g + k, edited(rng, words, k * max(1, length // 60))) for k in range(6)]
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, copies int, set_id int").repartition(5)
    assert sorted(tuple(r) for r in jaccard_join.join(df, n, percent).collect()) == brute(rows, n, percent)


def test_large_group_of_near_copies(spark):
    """Around the threshold: chains of links, few to any one member."""
    rng = random.Random(9)
    base = prose(rng, 120).split()
    rows = [(i, edited(rng, base, rng.randint(1, 4))) for i in range(300)] + [(1000 + i, prose(rng, 100)) for i in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in jaccard_join.join(df, 4, 85).collect()) == brute(rows, 4, 85)


def test_empty(spark):
    assert jaccard_join.join(spark.createDataFrame([], SCHEMA)).collect() == []


def test_linked_pairs_meet():
    """The pigeonhole: whatever the sets, a linked pair shares a word, and in some band as
    many as both sets need."""
    rng = np.random.default_rng(2)
    for percent in (85, 80, 50):
        bands = jaccard_join.Bands(percent)
        for _ in range(400):
            size = int(rng.integers(bands.edges[0], 400))
            a = rng.integers(0, 2**64, size, dtype=np.uint64)
            drop = int(rng.integers(0, size * (100 - percent) // 100 + 1))
            b = np.concatenate([a[drop:], rng.integers(0, 2**64, int(rng.integers(0, 1 + drop // 2)), dtype=np.uint64)])
            if not len(b) or 100 * (size - drop) < percent * len(set(a.tolist()) | set(b.tolist())) or jaccard_join.signature(a) == jaccard_join.signature(b):
                continue
            met = [{x: bands.words(np.unique(s), x) for x in bands.of(len(np.unique(s)))} for s in (a, b)]
            both = {x: len(set(met[0][x][0].tolist()) & set(met[1][x][0].tolist())) for x in met[0].keys() & met[1].keys()}
            assert any(n >= max(met[0][x][1], met[1][x][1]) >= 1 for x, n in both.items())


def test_long_words_differ(spark):
    letters = "".join("ab"[bin(i).count("1") % 2] for i in range(1024))
    other = letters.translate(str.maketrans("ab", "ba"))
    rows = [(1, letters), (2, other), (3, f"x y z {letters}"), (4, f"x y z {other}"), (5, other.upper())]
    assert sorted(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()) == brute(rows, 4, 85)


def test_equal_signatures_are_noticed(spark, monkeypatch):
    """Where sets share a signature all is done again under another seed."""
    scan = jaccard_join._scan
    monkeypatch.setattr(jaccard_join, "SEEDS", 2)

    def poor(n, percent, classes, seed, batches):
        for rows in scan(n, percent, classes, seed, batches):
            yield rows.assign(set_id=rows["n_shingles"]) if seed == 0 and rows["part"].isna().all() else rows

    monkeypatch.setattr(jaccard_join, "_scan", poor)
    rows = [r[:2] for r in documents()]
    assert sorted(tuple(r) for r in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()) == brute(rows, 4, 85)


def test_classes_dealt_twice(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "COARSE", 3)
    monkeypatch.setattr(jaccard_join, "FLUSH", 2000)
    rng = random.Random(2)
    base = prose(rng, 90).split()
    rows = [r[:2] for r in documents()] + [(500 + i, edited(rng, base, i % 4)) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(tuple(r) for r in jaccard_join.join(df, 4, 85).collect()) == brute(rows, 4, 85)


@pytest.mark.parametrize("bits", [10, 16])
def test_few_bits_of_a_signature(spark, bits):
    """With so few most sets share their number with others, under each seed some."""
    rng = random.Random(4)
    base = prose(rng, 90).split()
    rows = [r[:2] for r in documents()] + [(500 + i, edited(rng, base, i % 5)) for i in range(30)] + [(None, prose(rng, 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = jaccard_join.join(df, 4, 85, bits=bits).collect()
    assert sorted((tuple(r) for r in got if r[0] is not None)) == brute(rows[:-1], 4, 85) and len(got) == len(rows)
