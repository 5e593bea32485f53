import itertools
from collections import Counter, defaultdict

import numpy as np
import pytest
from fixtures import SCHEMA, documents

from sedge.llm import mixing


def water(sizes, factor=1.5, cap=2.0):
    """sizes in order of source -> targets, by repeated sharing."""
    weights = [mixing.WEIGHTS[i % 3] for i in range(len(sizes))]
    full, total = set(), factor * sum(sizes)
    while True:
        rest = total - sum(cap * sizes[i] for i in full)
        free = sum(w for i, w in enumerate(weights) if i not in full)
        over = {i for i in range(len(sizes)) if i not in full and rest * weights[i] / free > cap * sizes[i]}
        if not over:
            return [cap * s if i in full else rest * weights[i] / free for i, s in enumerate(sizes)]
        full |= over


def test_mix(spark):
    rows = [r for r in documents() if len(r[1] or "") < 50_000]  # a source's longest document must fit its budget
    df = spark.createDataFrame(rows, SCHEMA)
    got = mixing.mix(df).collect()
    again = mixing.mix(df.repartition(5)).collect()
    assert Counter(map(tuple, got)) == Counter(map(tuple, again))
    assert len(got) == len(rows)
    size = {r[0]: len((r[1] or "").split(None)) for r in rows if "\x1c" not in (r[1] or "") and " " not in (r[1] or "")}
    by = defaultdict(list)
    for r in got:
        by[r.source].append(r)
        assert r.doc_id not in size or r["size"] == size[r.doc_id]
        assert r.taken in (0, r["size"], 2 * r["size"])
    names = sorted((s for s in by if s is not None), key=lambda s: [ord(c) for c in s]) + [None]
    expected = water([sum(r["size"] for r in by[s]) for s in names])
    for s, t in zip(names, expected, strict=True):
        assert {r.source_size for r in by[s]} == {sum(r["size"] for r in by[s])}
        assert all(r.target == pytest.approx(t) for r in by[s])
        assert sum(r.taken for r in by[s]) <= t and t - sum(r.taken for r in by[s]) < 25
    assert mixing.mix(df.limit(0)).collect() == []


def test_knapsack_is_exact():
    rng = np.random.default_rng(1)
    for _ in range(60):
        sizes = [int(x) for x in rng.choice(np.arange(1, 30), 4, replace=False)]
        spare = [int(x) for x in rng.integers(0, 4, 4)]
        budget = int(rng.integers(0, 80))
        best = max(sum(a * b for a, b in zip(sizes, n, strict=True)) for n in itertools.product(*[range(s + 1) for s in spare]) if sum(a * b for a, b in zip(sizes, n, strict=True)) <= budget)
        got = mixing.knapsack(sizes, spare, budget)
        assert sum(a * b for a, b in zip(sizes, got, strict=True)) == best and all(0 <= g <= s for g, s in zip(got, spare, strict=True))


def test_fit_hits_budget():
    sizes, counts = np.array([900, 350, 77, 13, 2]), np.array([40, 100, 300, 50, 9])
    for budget in (0, 1, 5000, 40000, int((sizes * counts).sum())):
        n = mixing.fit(sizes, counts, budget, 2000)
        assert (n >= 0).all() and (n <= counts).all() and 0 <= budget - int((n * sizes).sum()) <= 1
