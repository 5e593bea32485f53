"""Versions of a table under several writers and readers."""

import threading

import pytest
from pyspark.sql import functions as F

from sedge.sources import versions

SCHEMA = "file_id long, content string"


def table(spark, path, version=None):
    return sorted((tuple(r) for r in versions.read(spark, path, version).select("file_id", "content").collect()), key=repr)


def frame(spark, rows, schema=SCHEMA):
    return spark.createDataFrame(rows, schema)


def test_versions_stay(spark, tmp_path):
    path = str(tmp_path / "t")
    assert versions.latest(spark, path) == 0
    with pytest.raises(FileNotFoundError):
        versions.read(spark, path)
    assert versions.replace(frame(spark, [(1, "a"), (1, "b"), (2, "c"), (None, "n")]), path, buckets=3) == 1
    pinned = versions.read(spark, path)
    assert versions.replace(frame(spark, [(1, "z"), (5, "e"), (None, "m")]), path) == 2
    assert versions.replace(frame(spark, []), path, keys=frame(spark, [(2, "")])) == 3
    assert sorted(r.content for r in pinned.collect()) == ["a", "b", "c", "n"]
    assert table(spark, path, 2) == sorted([(1, "z"), (2, "c"), (5, "e"), (None, "m"), (None, "n")], key=repr)
    assert table(spark, path) == sorted([(1, "z"), (5, "e"), (None, "m"), (None, "n")], key=repr)
    assert versions.replace(frame(spark, [(9, "x", 7)], "file_id long, content string, pages int"), path) == 4
    assert {(r.file_id, r.pages) for r in versions.read(spark, path).filter("file_id > 4").collect()} == {(5, None), (9, 7)}


def test_all_rows_may_go(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(frame(spark, [(1, "a")]), path)
    versions.replace(frame(spark, []), path, keys=frame(spark, [(1, "")]))
    assert table(spark, path) == [] and versions.read(spark, path).columns == ["file_id", "content"]


def test_a_run_that_breaks_off_changes_nothing(spark, tmp_path):
    path = str(tmp_path / "t")
    versions.replace(frame(spark, [(1, "a"), (2, "b")]), path)
    left = sorted(p.name for p in (tmp_path / "t" / "data").iterdir())
    bad = frame(spark, [(1, "x"), (2, "y")]).withColumn("content", F.when(F.col("file_id") == 2, F.raise_error(F.lit("broken")).cast("string")).otherwise(F.col("content")))
    with pytest.raises(Exception, match="broken"):
        versions.replace(bad, path)
    assert table(spark, path) == [(1, "a"), (2, "b")] and sorted(p.name for p in (tmp_path / "t" / "data").iterdir()) == left


def test_who_comes_second_merges(spark, tmp_path, monkeypatch):
    """Another writer gets in between a run's merge and its claim, in the same bucket or not."""
    path = str(tmp_path / "t")
    versions.replace(frame(spark, [(i, "old") for i in range(6)]), path, buckets=2)
    claim, inner = versions._Folder.claim, [True]

    def late(self, text, *parts):
        if inner[0]:
            inner[0] = False
            versions.replace(frame(spark, [(i, "other") for i in (0, 1, 2)]), path)
        return claim(self, text, *parts)

    monkeypatch.setattr(versions._Folder, "claim", late)
    assert versions.replace(frame(spark, [(i, "own") for i in (2, 3)]), path) == 3
    assert table(spark, path) == [(0, "other"), (1, "other"), (2, "own"), (3, "own"), (4, "old"), (5, "old")]
    monkeypatch.setattr(versions._Folder, "claim", lambda *_: False)
    with pytest.raises(versions.Conflict):
        versions.replace(frame(spark, [(1, "x")]), path, tries=2)


def test_writers_and_a_reader_at_once(spark, tmp_path):
    """Each run stamps all of its keys; no view mixes two stamps of a writer's keys."""
    path, errors, views = str(tmp_path / "t"), [], []
    versions.replace(frame(spark, [(k, f"{w} 0") for w in range(3) for k in range(10 * w, 10 * w + 10)]), path, buckets=4)
    done = threading.Event()

    def write(w):
        try:
            for n in range(1, 4):
                versions.replace(frame(spark, [(k, f"{w} {n}") for k in range(10 * w, 10 * w + 10)]), path)
        except Exception as e:
            errors.append(e)

    def look():
        while not done.is_set():
            views.append(table(spark, path))

    threads = [threading.Thread(target=write, args=(w,)) for w in range(3)]
    reader = threading.Thread(target=look)
    for t in [*threads, reader]:
        t.start()
    for t in threads:
        t.join(90)
    done.set()
    reader.join(30)
    assert not errors and views and versions.latest(spark, path) == 10
    for view in [*views, *(table(spark, path, n) for n in range(1, 11))]:
        assert sorted(k for k, _ in view) == list(range(30))
        assert all(len({c for k, c in view if k // 10 == w}) == 1 for w in range(3))
    assert {c for _, c in table(spark, path)} == {"0 3", "1 3", "2 3"}


def test_clear(spark, tmp_path):
    path = str(tmp_path / "t")
    for n in range(4):
        versions.replace(frame(spark, [(1, f"{n}"), (n + 10, "x")]), path, buckets=4)
    assert versions.clear(spark, path) == [] and table(spark, path, 1) == [(1, "0"), (10, "x")]
    (tmp_path / "t" / "data" / "broken off").mkdir()
    assert versions.clear(spark, path, keep=1, older_than=0) == [1, 2, 3]
    assert table(spark, path) == [(1, "3"), (10, "x"), (11, "x"), (12, "x"), (13, "x")]
    assert not (tmp_path / "t" / "data" / "broken off").exists()
