import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from fixtures import SCHEMA, documents, prose

from sedge.llm import hashing, substring_dedup


def brute(rows, window):
    docs = [(r[0], hashing.words_of(r[1] or "")) for r in rows]
    seen = Counter(tuple(w[i : i + window]) for _, w in docs for i in range(len(w) - window + 1))
    out = []
    for d, w in docs:
        gone = set()
        for i in range(len(w) - window + 1):
            if seen[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        kept = b" ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((d, len(w), len(gone), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("window", [5, 35])
def test_matches_brute_force(spark, window):
    rng = random.Random(3)
    passage = prose(rng, 40)
    extra = [(100 + i, f"{prose(rng, i)} {' '.join(passage.split()[: 30 + i])} {prose(rng, 9)}") for i in range(10)]
    extra += [(200 + i, "la " * i) for i in range(30, 40)] + [(None, passage)]
    rows = [r[:2] for r in documents()] + extra
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, key int, blocks int").repartition(6)
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(df, window).collect()), key=str)
    assert got == brute(rows, window)


def test_empty(spark):
    assert substring_dedup.remove_repeats(spark.createDataFrame([], SCHEMA)).collect() == []


def test_windows_equal_only_for_equal_words():
    words = [b"a", b"b", b"a", b"b", b"a", b"c"] * 3
    h = hashing.windows(hashing.word_hashes(words), 4)
    same = {}
    for i, x in enumerate(h.tolist()):
        assert same.setdefault(tuple(words[i : i + 4]), x) == x
    assert len(set(same.values())) == len(same) and len(hashing.windows(h[:3], 4)) == 0


def test_membership_filter_has_no_false_negatives(spark):
    keys = spark.range(0, 5000, 7).withColumnRenamed("id", "key")
    got = hashing.may_hold(spark.range(0, 5000).withColumnRenamed("id", "key"), "key", hashing.membership(keys, "key"), "hit").filter("hit").collect()
    assert {r.key for r in got} >= set(range(0, 5000, 7)) and len(got) < 760


def test_packing_of_positions_round_trips():
    p = substring_dedup.Packer(3, 7)
    rng = np.random.default_rng(0)
    given = {7: rng.integers(0, 2**63, 50, dtype=np.uint64), -9: rng.integers(0, 2**63, 70000, dtype=np.uint64)}
    for k, h in given.items():
        p.add(k, np.arange(len(h)), h)
    got = set()
    for _, row in p.flush().groupby("part"):
        d, at, h = substring_dedup.unpacked(row, 7)
        got |= set(zip(d.tolist(), at.tolist(), h.tolist(), strict=True))
    assert got == {(k, i, int(x) >> 8) for k, h in given.items() for i, x in enumerate(h)}


def test_word_hashes_of_bytes():
    """Equal words have equal hashes and others don't, whatever parts them and wherever they stand."""
    rng = random.Random(8)
    words = [prose(rng, 1).encode() for _ in range(5000)] + ["é\x1c".encode(), b"\x00", b"\x00\x00", b"x" * (hashing.SLICE + 5), b"a"]
    text = b" \t" + b"".join(w + rng.choice([b" ", b"\n", b"\r\n", b"\x0b\x0c"]) for _ in range(30) for w in words)
    assert len(text) > 3 * hashing.SLICE
    known = {}
    got = hashing.text_hashes(text).tolist()
    assert len(got) == len(text.split())
    for w, h in zip(text.split(), got, strict=True):
        assert known.setdefault(w, h) == h
    assert len(set(known.values())) == len(known)
    assert len(hashing.text_hashes(b"")) == len(hashing.text_hashes(b" \n ")) == 0


def test_classes_without_repeats(spark):
    """More classes than windows that stay: those that mark nothing are passed over."""
    rows = [(i, "one two three four five six seven") for i in range(3)] + [(9, "a b c d e f g h")]
    got = {r.doc_id: r.n_removed for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()}
    assert got == {0: 7, 1: 7, 2: 7, 9: 0}


def swapped(letters):
    """Two strings of ``letters`` a and b that any polynomial modulo a power of two takes for equal."""
    a = ""
    for i in range(letters):
        a += "ab"[bin(i).count("1") % 2]
    return a, a.translate(str.maketrans("ab", "ba"))


def test_long_words_differ(spark):
    """Words are told apart whatever they repeat; one that differs is no repeat."""
    for letters in (8, 1024, 1 << 15):
        assert len(set(hashing.text_hashes(" ".join(swapped(letters)).encode()).tolist())) == 2
    words = prose(random.Random(4), 34).split()
    one, two = swapped(1024)
    rows = [(1, " ".join([*words, one])), (2, " ".join([*words, two])), (3, " ".join([*words[:20], two, *words[20:]]))]
    got = substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [(r.n_words, r.n_removed) for r in got] == [(35, 0)] * 3


def test_windows_are_compared_by_both_hashes(spark, monkeypatch):
    """With nothing carried of the first hash but a byte, the second one still tells windows apart."""
    monkeypatch.setattr(substring_dedup, "WINDOW_BYTES", (1, 8))
    rows = [r[:2] for r in documents()]
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 5).collect()), key=str)
    assert got == brute(rows, 5)


def test_classes_dealt_twice(spark, monkeypatch):
    """More classes than a task deals at once."""
    monkeypatch.setattr(substring_dedup, "COARSE", 4)
    monkeypatch.setattr(substring_dedup, "FLUSH", 4000)
    rows = [r[:2] for r in documents()]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = sorted((tuple(r) for r in substring_dedup.remove_repeats(df, 5).collect()), key=str)
    assert got == brute(rows, 5)
