import math

import numpy as np
import pytest

from sedge.llm import embedding_dedup

SCHEMA = "vec_id long, embedding array<float>, label int, size int, p int"


def brute(rows, cosine=0.9):
    good = [(i, np.asarray(v, dtype=np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and np.any(v)]
    links, root = {i: 0 for i, _ in rows}, {i: i for i, _ in rows}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                links[i] += 1
                links[j] += 1
                a_, b_ = find(i), find(j)
                root[max(a_, b_)] = min(a_, b_)
    return sorted((i, links[i], find(i), find(i) == i) for i, _ in rows)


def vectors(n=300, seed=0):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n, 16)).astype(np.float32)
    near = np.repeat(base[:20], 5, axis=0) + rng.normal(scale=0.1, size=(100, 16)).astype(np.float32)
    x = np.concatenate([base, near, np.repeat(base[:3], 40, axis=0)])
    return [(i, [float(f) for f in v]) for i, v in enumerate(x)]


def test_matches_brute_force(spark):
    rows = vectors()
    rows += [(1000, None), (1001, []), (1002, [0.0] * 16), (1003, [float("nan")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, [float("inf")] * 16), (1006, [1.0, 2.0]), (1007, [2.0, 4.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(df, pivots=32).collect()) == brute(rows)


def test_huge_and_tiny_numbers(spark):
    """Cosines whose squares leave the doubles."""
    big, tiny = [1.7e308, 1e307], 5e-324
    rows = [(1, [1e200, 0.0]), (2, [2e200, 1e199]), (3, [1e-200, 0.0]), (4, [3e-200, 0.0]), (5, [0.0, tiny]), (6, [-0.0, 1.0]), (7, big), (8, [-1e200, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_duplicates(df, pivots=2).collect()}
    assert got == {1: (4, 1), 2: (4, 1), 3: (4, 1), 4: (4, 1), 7: (4, 1), 5: (1, 5), 6: (1, 5), 8: (0, 8)}


def test_blocks_of_a_hot_list(spark, monkeypatch):
    monkeypatch.setattr(embedding_dedup, "BLOCK", 30)
    rng = np.random.default_rng(1)
    centre = rng.normal(size=12)
    rows = [(i, [float(f) for f in (centre + rng.normal(scale=0.12, size=12)).astype(np.float32)]) for i in range(200)] + [(500 + i, [float(f) for f in rng.normal(size=12).astype(np.float32)]) for i in range(60)]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA)
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(df, pivots=8, k=8).collect()) == brute(rows)


def test_recall_on_noisy_copies():
    """Pairs at the threshold among many others share two pivots nearly always."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 64))
    y = x + rng.normal(size=x.shape) * 0.48
    x, y = (v / np.linalg.norm(v, axis=1, keepdims=True) for v in (x, y))
    pivots = embedding_dedup.spread(x[:2048], embedding_dedup.PIVOTS)
    a, b = (embedding_dedup.nearest(v, pivots, embedding_dedup.NEAREST) for v in (x, y))
    some = (x * y).sum(axis=1) >= 0.9
    met = [len(set(i) & set(j)) >= 2 for i, j in zip(a[some].tolist(), b[some].tolist(), strict=True)]
    assert some.sum() > 1000 and np.mean(met) > 0.97


@pytest.mark.parametrize("n", [0, 1])
def test_few(spark, n):
    df = spark.createDataFrame([(7, [1.0, 2.0], 1, 2, 3)][:n], SCHEMA)
    assert [tuple(r) for r in embedding_dedup.near_duplicates(df).collect()] == [(7, 0, 7, True)][:n]


@pytest.mark.parametrize("n", [1500, 6000])
def test_recall_through_the_operator(spark, n):
    """Noisy copies at the threshold among many others: found by the operator itself."""
    rng = np.random.default_rng(n)
    x = rng.normal(size=(n, 64))
    x = np.concatenate([x, x[: n // 2] + rng.normal(size=(n // 2, 64)) * 0.47]).astype(np.float32)
    unit = x.astype(np.float64) / np.linalg.norm(x.astype(np.float64), axis=1, keepdims=True)
    true = np.sum(unit @ unit.T >= 0.9, axis=1) - 1
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_duplicates(df).collect()}
    assert all(got[i] <= true[i] for i in got) and true.sum() > n // 2
    assert sum(got.values()) >= 0.97 * true.sum()


def test_repeated_and_null_ids(spark):
    """Rows of one id are vectors of their own; a null id is never the smallest."""
    a, b = [1.0, 0.1, 0.0], [0.0, 1.0, 0.2]
    rows = [(5, a), (5, b), (None, a), (7, b), (7, b), (None, [0.3, -1.0, 4.0])]
    got = embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    want = [(5, 1, 5, True), (5, 2, 5, True), (None, 1, 5, None), (7, 2, 5, False), (7, 2, 5, False), (None, 0, None, None)]
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)


def test_parted_lists(spark, monkeypatch):
    """Lists parted by the second pivot, and lengths that the sample misses."""
    monkeypatch.setattr(embedding_dedup, "BLOCK", 12)
    rows = vectors(200, 3) + [(9000, [1.0, 2.0]), (9001, [2.0, 4.1]), (9002, [-2.0, 4.0])]
    df = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(4)
    assert sorted(tuple(r) for r in embedding_dedup.near_duplicates(df, pivots=16).collect()) == brute(rows)
