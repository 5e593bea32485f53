import os
import subprocess
import sys
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from fixtures import SCHEMA, documents
from hypothesis import given, settings
from hypothesis import strategies as st

from sedge.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


AWKWARD = ["İ", "İ.", "İstanbul", "m²,", "12 m², ok", "x¹)", "H₂O, x", "a³.", "cafe\u0301", "CAFE\u0301 H\u0331 J\u030c.", "x<|endoftext|>. <|EndOfText|>!", "a<b> <i>c</i>", "it's. 'S'S, I'LL", " a\x85b\xa0c\x1cd", "≠ =\u0338 <\u0338", "ΑΣ Σ. ΣΑΣ", "각 ﬁ K Å"]
ODD = st.sampled_from(list("aAbé\u0301ÉΣσİ'stve<|>endofx \t\n\x1c\x85 \u30001½.,!字"))
ANY = st.characters(exclude_categories=["Cs"])


def exact(codec, text):
    assert np.frombuffer(codec.encode(text), "<u4").tolist() == codec.whole.encode(text, add_special_tokens=False).ids


def fresh(codec):
    """The same tokenizer with nothing remembered."""
    new = packing.WordCodec.__new__(packing.WordCodec)
    new.__dict__.update(codec.__dict__, known={}, before={}, held=0)
    return new


@settings(max_examples=5000, deadline=None)
@given(st.text(alphabet=ODD | ANY))
def test_codec_is_exact(text):
    shared = packing.codec(PATH)
    exact(shared, text)
    exact(fresh(shared), text)


LATIN = st.sampled_from([*"abcdefghijklmnopqrstuvwxyz", *map(chr, range(0xC0, 0x100)), *"''<|>._-!", "\u0301"])


@settings(max_examples=3000, deadline=None)
@given(st.text(alphabet=LATIN, max_size=12), st.text(alphabet=LATIN, max_size=12))
def test_codec_is_exact_on_latin_words(first, second):
    shared = packing.codec(PATH)
    assert shared.bare is not None
    exact(fresh(shared), f"{first} {second}")
    exact(shared, f"{first} {second}")


def test_codec_without_the_bare_model():
    """Ids are the same where a tokenizer has no form without normalising."""
    c = fresh(packing.codec(PATH))
    c.bare = None
    for text in [*AWKWARD, *(r[1] for r in documents() if r[1])]:
        exact(c, text)


def test_codec_on_awkward_words():
    shared = packing.codec(PATH)
    for text in AWKWARD:
        exact(fresh(shared), text)
        exact(shared, text)


def test_codec_forgets(monkeypatch):
    """Ids stay exact when what is remembered is bounded to almost nothing."""
    monkeypatch.setattr(packing, "CACHE_BYTES", 2000)
    monkeypatch.setattr(packing, "GROUP_BYTES", 100)
    c = fresh(packing.codec(PATH))
    texts = [r[1] for r in documents()] + AWKWARD
    want = [c.whole.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert [np.frombuffer(x, "<u4").tolist() for x in c.encode_all(texts)] == want
    assert c.held < 2000 + 300 * 20000


def test_packing(spark):
    rows = documents()
    df = spark.createDataFrame(rows, SCHEMA)
    got = packing.pack_documents(df, PATH, window=256).collect()
    whole = packing.codec(PATH).whole
    copies = Counter(r[0] for r in rows)
    ids = {r[0]: [*whole.encode(r[1] or "", add_special_tokens=False).ids, 2] for r in rows}
    pieces = defaultdict(list)
    for r in got:
        pieces[r.doc_id].append((r.start, r.length))
        assert r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], dtype="<u4").tobytes())
    for i, own in pieces.items():
        at = 0
        for start, length in sorted(set(own)):
            assert start == at and own.count((start, length)) == copies[i]
            at += length
        assert at == len(ids[i])
    assert set(pieces) == set(ids)
    by = defaultdict(list)
    for r in got:
        by[r.sequence_id].append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    assert packing.pack_documents(df.limit(0), PATH).collect() == []


def test_plan_pads_little():
    rng = np.random.default_rng(0)
    lengths = np.minimum(4096, np.exp(rng.normal(6.3, 1.0, 60_000)).astype(int) + 1)
    counts = dict(Counter(lengths.tolist()))
    rows, sequences = packing.plan(counts, 4096)
    used = Counter()
    for length, low, high, each, _ in rows:
        assert low == used[length] and high > low and each >= 1
        used[length] += high - low
    assert used == counts
    assert sequences * 4096 / lengths.sum() < 1.01


def test_nnls():
    rng = np.random.default_rng(3)
    columns = np.array([[0, 1, -1], [0, 0, 2], [1, 2, 2], [3, -1, -1], [0, 3, 3]])
    a = np.zeros((4, 5))
    for j, c in enumerate(columns):
        for i in c[c >= 0]:
            a[i, j] += 1
    for _ in range(20):
        h = rng.integers(0, 30, 4).astype(float)
        x = packing.nnls(columns, h)
        grad = a.T @ (a @ x - h)
        assert (x >= 0).all() and (grad > -1e-6).all() and abs((grad * x).sum()) < 1e-5


def test_lean_codec_stays_small():
    """A worker with the lean codec grows by little over tasks full of new words, and gives it back after each."""
    code = """
import random, re, sys, threading, time
from sedge.llm import packing
from sedge.llm.shared import trim
held = lambda: sum(map(int, re.findall(r"Pss_Anon:\\s+(\\d+)", open("/proc/self/smaps_rollup").read()))) / 1024
most, stop = [0.0], []
def watch():
    while not stop:
        most[0] = max(most[0], held())
        time.sleep(0.01)
r = random.Random(0)
texts = [" ".join("".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=r.randint(4, 9))) for _ in range(4000)) for _ in range(100)]
trim()
began = held()
threading.Thread(target=watch, daemon=True).start()
for _ in range(3):
    codec = packing.codec(sys.argv[1], True)
    for _ in codec.encode_all(texts, packing.LEAN_BYTES):
        pass
    codec.forget()
    packing._codecs.clear()
    del codec
    trim()
stop.append(1)
print(most[0] - began, held() - began)
"""
    peak, left = map(float, subprocess.run([sys.executable, "-c", code, PATH], capture_output=True, text=True, check=True, env=os.environ | {"PYTHONPATH": os.pathsep.join(sys.path)}).stdout.split())
    assert peak < 200 and left < 34, (peak, left)
