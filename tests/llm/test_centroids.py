import hashlib
import math
import random
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest

from sedge.llm import centroids


def brute(rows, k=8, rounds=10, dim=64, seed=3):
    kept = [(i, [math.floor(Fraction(x) * 1024) for x in v]) for i, v, *_ in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    first = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)[:k]
    c = [v for _, v in first]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    put = lambda: [min((far(v, own), j) for j, own in enumerate(c)) for _, v in kept]
    for _ in range(rounds):
        at = put()
        for j in range(len(c)):
            own = [v for (_, v), (_, b) in zip(kept, at, strict=True) if b == j]
            if own:
                c[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    at = put()
    per = Counter()
    for d, j in at:
        per[j] += d
    fits = lambda n: n if n < 2**63 else None
    lost = {j for d, j in at if fits(d) is None}
    return Counter((i, j, fits(d), None if j in lost else fits(per[j]), None if lost else fits(sum(per.values())), hashlib.sha256(",".join(map(str, c[j])).encode()).hexdigest()) for (i, _), (d, j) in zip(kept, at, strict=True))


SCHEMA = "vec_id long, embedding array<double>, label int, cluster string, distance string"


def vectors(n=300, dim=64, seed=1, size=1.0):
    rng = random.Random(seed)
    at = [[rng.gauss(0, size) for _ in range(dim)] for _ in range(10)]
    return [(i, [x + rng.gauss(0, 0.3 * size) for x in rng.choice(at)], 1, "c", "d") for i in range(n)]


def got(spark, rows, **kw):
    return Counter(tuple(r) for r in centroids.cluster(spark.createDataFrame(rows, SCHEMA).repartition(4), **kw).collect())


def test_matches_brute_force(spark):
    rows = vectors()
    odd = [(900, None), (901, []), (902, [1.0] * 63), (903, [float("nan")] * 64), (904, [1.0] * 63 + [None]), (905, [float("-inf")] * 64)]
    rows += [(i, v, 0, "", "") for i, v in odd] + [rows[0], rows[0], (None, rows[3][1], 1, "", ""), (2**60 + 1, rows[4][1], 1, "", ""), (2**60 + 3, rows[4][1], 1, "", "")]
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("size", [1e3, 1e7, 1e13, 1e17, 1e300])
def test_large_numbers(spark, size):
    rows = vectors(60, 5, 2, size) + vectors(20, 5, 3)
    assert got(spark, rows, k=4, rounds=3, dim=5) == brute(rows, k=4, rounds=3, dim=5)


def test_ties_few_and_none(spark):
    rows = [(i, [0.5, -0.25], 1, "", "") for i in range(7)] + [(9, [float(2**1000), 0.0], 1, "", "")]
    assert got(spark, rows, k=3, rounds=2, dim=2) == brute(rows, k=3, rounds=2, dim=2)
    assert got(spark, rows[:2], k=8, rounds=2, dim=2) == brute(rows[:2], k=8, rounds=2, dim=2)
    assert not got(spark, [(1, None, 1, "", "")]) and not got(spark, [(None, [1.0, 1.0], 1, "", "")], dim=2)


def test_paths_agree():
    rng = np.random.default_rng(0)
    x, c = rng.integers(-1000, 1000, (500, 64)), rng.integers(-1000, 1000, (8, 64)).astype(object)
    best, far = centroids.nearest(x, c)
    # numbers added to all vectors and centroids change no distance, but the path
    for more in (10**8, 10**25):
        y, d = x.astype(object) + more, c + more
        b, f = centroids.nearest(y if more > 10**20 else y.astype(np.int64), d)
        assert b.tolist() == best.tolist() and f.tolist() == far.tolist()
    sums = centroids.sums_of(x, best, 8)
    assert sums.tolist() == [x[best == j].sum(axis=0).tolist() for j in range(8)]
    assert centroids.sums_of(x.astype(object) * 10**20, best, 8).tolist() == (sums * 10**20).tolist()
