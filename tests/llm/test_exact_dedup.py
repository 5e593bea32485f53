import hashlib
import re
from collections import defaultdict

from fixtures import SCHEMA, documents

from sedge.llm import exact_dedup


def brute(rows):
    norm = [(r[0], re.sub(r"[\x20\x09-\x0D]+", " ", r[1] or "")) for r in rows]
    groups = defaultdict(list)
    for i, t in norm:
        groups[t].append(i)
    return sorted((i, min(groups[t]), len(groups[t]), i == min(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in norm)


def test_matches_brute_force(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    for capacity in (None, 1, 10_000_000):
        got = sorted(tuple(r) for r in exact_dedup.dedup(df, capacity=capacity).collect())
        assert got == brute(rows)


def test_hot_group_and_empty(spark):
    rows = [(i, "same text" if i % 3 else f"text {i}") for i in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert sorted(tuple(r) for r in exact_dedup.dedup(df).collect()) == brute(rows)
    assert exact_dedup.dedup(df.limit(0)).collect() == []


def test_directory_doubles_only_where_needed():
    cells = {0: 10, 1: 10, 2: 10, 3: 10, 9: 5}
    slots = exact_dedup.directory(cells, 20, max_depth=4)
    assert len(slots) == 8 and slots[0] != slots[1] and len(set(slots[4:])) == 1 and slots == sorted(slots)
    assert exact_dedup.directory({7: 100}, 1, max_depth=4)[7] != exact_dedup.directory({7: 100}, 1, max_depth=4)[6]
    assert exact_dedup.directory({}, 1) == [0]


def test_collisions_are_chained():
    import pandas as pd

    rows = pd.DataFrame([[0, 5, "a", 3, 1], [0, 5, "b", 4, 2], [0, 5, "a", 1, 1], [0, 6, "c", 9, 1]], columns=["bucket", "key", "norm", "doc_id", "copies"])
    out = pd.concat(exact_dedup._own(iter([rows.iloc[:2], rows.iloc[2:]])))
    assert out[["key", "slot", "keep_id", "group_size"]].values.tolist() == [[5, 0, 1, 2], [5, 1, 4, 2], [6, 0, 9, 1]]


def test_null_ids(spark):
    rows = [(None, "a"), (4, "a"), (2, "a"), (None, "b"), (None, "b"), (9, "c"), (None, "d")]
    got = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    assert got == {(None, 2, 3, None), (4, 2, 3, False), (2, 2, 3, True), (None, None, 2, None), (9, 9, 1, True), (None, None, 1, None)}
