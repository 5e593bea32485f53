"""Pruned search against all pairs."""

import numpy as np
import pytest

from sedge.operators import cells, search

BIG = 2**60
CHUNKS = "id long, user_id string, embeddings array<float>, cell string, angle int"


def brute(queries, chunks, k, threshold):
    out = []
    fine = lambda v: bool(v) and None not in v and np.isfinite(v).all() and np.any(v)
    for q, u, v in queries:
        hits = []
        for i, user, w, *_ in chunks:
            if q is not None and u is not None and user == u and fine(v) and fine(w) and len(v) == len(w):
                a, b = np.array(v, dtype=np.float64), np.array(w, dtype=np.float64)
                if (s := a @ b / np.linalg.norm(a) / np.linalg.norm(b)) > threshold:
                    hits.append((-round(float(s), 9), i))
        out += [(q, i, r + 1) for r, (_, i) in enumerate(sorted(hits)[:k])]
    return sorted(out)


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    centre = rng.normal(size=(12, 8))
    x = (centre[rng.integers(0, 12, 600)] + rng.normal(scale=0.15, size=(600, 8))).astype(np.float32).astype(float)
    chunks = [(BIG + i, "hot" if i % 3 else "abc"[i % 9 // 3], v.tolist(), "c", 1) for i, v in enumerate(x)]
    chunks += [(BIG + 700 + i, "hot", x[1].tolist(), "c", 1) for i in range(30)]
    chunks += [(1, "hot", None, "c", 1), (2, "hot", [], "c", 1), (3, "hot", [0.0] * 8, "c", 1), (4, None, [1.0] * 8, "c", 1), (5, "hot", [float("nan")] * 8, "c", 1), (6, "hot", [None] * 8, "c", 1), (7, "hot", [1.0, 2.0], "c", 1)]
    queries = [(BIG + 3 * i + 1, c[1], c[2]) for i, c in enumerate(chunks[:90])] + [(1, "hot", None), (2, None, [1.0] * 8), (None, "hot", [1.0] * 8), (3, "nobody", [1.0] * 8), (4, "hot", [2.0, 4.0]), (5, "hot", [0.0] * 8), (6, "hot", [1.0] * 3), (8, "a", (-centre[0]).tolist())]
    return queries, chunks


@pytest.mark.parametrize(("k", "threshold", "block"), [(10, 0.3, 4096), (3, -0.5, 16)])
def test_same_rows_as_all_pairs(spark, tmp_path, rows, monkeypatch, k, threshold, block):
    monkeypatch.setattr(cells, "BLOCK", block)
    queries, chunks = rows
    asked = spark.createDataFrame(queries, "query_id long, user_id string, vector array<double>")
    cells.write(cells.build(spark.createDataFrame(chunks, CHUNKS).repartition(3)), str(tmp_path / "index"))
    index = cells.read(spark, str(tmp_path / "index"))
    got = cells.search(asked, index, k, threshold).collect()
    assert sorted((r.query_id, r.id, r.rank) for r in got) == brute(queries, chunks, k, threshold)
    share = cells.compared(asked, index, k, threshold).selectExpr("sum(vectors) / sum(of_all) AS share").first().share
    assert 0 < share < 0.6  # vectors near twelve points: others are left out


def test_nothing(spark, rows):
    queries, chunks = rows
    none, asked = spark.createDataFrame([], CHUNKS), spark.createDataFrame(queries[:3], "query_id long, user_id string, vector array<double>")
    assert cells.search(asked, cells.build(none)).isEmpty()
    assert cells.search(asked.limit(0), cells.build(spark.createDataFrame(chunks[:20], CHUNKS))).isEmpty()


def test_many_queries_stay_a_table(spark, rows, monkeypatch):
    queries, chunks = rows
    asked = spark.createDataFrame(queries[:60], "query_id long, user_id string, vector array<double>")
    table = spark.createDataFrame([c for c in chunks if c[0] >= BIG], CHUNKS)
    key = lambda df: sorted((r.query_id, r.id, round(r.similarity, 9), r["rank"]) for r in df.collect())
    want = key(search.search_many(asked, table))
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    assert key(search.search_many(asked, table)) == want


def test_joined_in_blocks(spark, rows, monkeypatch):
    queries, chunks = rows
    queries, chunks = ([r for r in some if r[2] is None or len(r[2]) in (0, 8)] for some in (queries, chunks))
    chunks += [(BIG + 2000 + i, "unasked", [1.0] * 8, "c", 1) for i in range(40)]
    asked, table = spark.createDataFrame(queries, "query_id long, user_id string, vector array<double>").filter("query_id is not null"), spark.createDataFrame(chunks, CHUNKS).repartition(3)
    monkeypatch.setattr(cells, "BLOCK", 16)
    monkeypatch.setattr(cells, "STEP", 5)
    for k, threshold in [(10, 0.3), (3, -0.5)]:
        got = search.search_joined(asked, table, k, threshold).collect()
        assert sorted((r.query_id, r.id, r["rank"]) for r in got) == brute(queries, chunks, k, threshold)
    pairs = sum(1 for q in queries if q[0] for c in chunks if q[1] == c[1])
    assert cells.in_blocks(asked, table, 1, 0.3).count() < pairs / 8  # a row for each query and block, not for each pair
    with pytest.raises(Exception, match="unlike length"):
        search.search_joined(asked, spark.createDataFrame([(1, "hot", [1.0, 2.0], "c", 1)], CHUNKS)).collect()


def test_copies_in_the_order_of_their_ids(spark, monkeypatch):
    rng = np.random.default_rng(5)
    monkeypatch.setattr(cells, "BLOCK", 37)
    x = rng.normal(size=(3, 61))
    table = spark.createDataFrame([(BIG + i, "u", x[i % 3].tolist(), "c", 1) for i in range(200)], "id long, user_id string, embeddings array<double>, cell string, angle int")
    asked = spark.createDataFrame([(i, "u", (v + rng.normal(scale=0.2, size=61)).tolist()) for i, v in enumerate(x) for i in range(3 * i, 3 * i + 3)], "query_id long, user_id string, vector array<double>")
    want = sorted((q, BIG + q // 3 + 3 * r, r + 1) for q in range(9) for r in range(5))
    for got in (search.search_joined(asked, table, 5), search.search_many(asked, table, 5), cells.search(asked, cells.build(table), 5)):
        assert sorted((r.query_id, r.id, r["rank"]) for r in got.collect()) == want


def test_angles_in_slices(spark, monkeypatch):
    monkeypatch.setattr(cells, "STEP", 7)
    x = np.random.default_rng(6).normal(size=(100, 4))
    rows = spark.createDataFrame([(i, "u", v.tolist()) for i, v in enumerate(x)], "id long, user_id string, embeddings array<double>").coalesce(1)
    centres = {4: np.eye(4)}
    rows = cells.usable(rows, "embeddings")
    want = np.arccos(x / np.linalg.norm(x, axis=1, keepdims=True))
    got = sorted(cells._angles(rows, "embeddings", centres, True).collect())
    assert np.allclose([r.angles for r in got], want) and [r.id for r in got] == list(range(100))
    assert [r.cell for r in sorted(cells._angles(rows, "embeddings", centres, False).collect())] == want.argmin(axis=1).tolist()


def test_more_queries_than_a_broadcast_meet_blocks(spark, rows, monkeypatch):
    queries, chunks = rows
    asked, table = spark.createDataFrame(queries[:60], "query_id long, user_id string, vector array<double>"), spark.createDataFrame([c for c in chunks if c[0] >= BIG], CHUNKS)
    monkeypatch.setattr(search, "QUERY_BLOCK", 7)
    monkeypatch.setattr(cells, "build", lambda *_: pytest.fail("an index of all pairs of queries and cells"))
    got = search.search_many(asked, table).collect()
    assert sorted((r.query_id, r.id, r["rank"]) for r in got) == brute(queries[:60], chunks, 10, 0.3)
