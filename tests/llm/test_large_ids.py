"""Ids that doubles can't hold, beside a null one in the same batch."""

from collections import Counter

from public_tokenizers import path

from sedge.llm import exact_dedup, jaccard_join, packing, quotation, substring_dedup

A, B, C = 2**60 + 1, 2**60 + 3, 2**60 + 5
TEXT = " ".join(f"word{i}" for i in range(60))


def frame(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema).coalesce(1)


def test_exact_dedup(spark):
    rows = [(None, "x"), (B, TEXT), (A, TEXT), (C, "y"), (None, TEXT), (A + 1, "y")]
    got = Counter(tuple(r)[:4] for r in exact_dedup.dedup(frame(spark, rows)).collect())
    assert got == Counter([(None, None, 1, None), (B, A, 3, False), (A, A, 3, True), (None, A, 3, None), (C, A + 1, 2, False), (A + 1, A + 1, 2, True)])


def test_jaccard_join(spark):
    rows = [(None, None), (A, TEXT), (B, TEXT + " more"), (C, "some other text")]
    got = Counter(tuple(r) for r in jaccard_join.join(frame(spark, rows)).collect())
    assert got == Counter([(None, 0, None), (A, 56, A), (B, 57, A), (C, 1, C)])


def test_substring_dedup(spark):
    rows = [(None, "x"), (A, TEXT), (B, TEXT), (C, "y z")]
    got = Counter(tuple(r)[:3] for r in substring_dedup.remove_repeats(frame(spark, rows)).collect())
    assert got == Counter([(None, 1, 0), (A, 60, 60), (B, 60, 60), (C, 2, 0)])


def test_packing(spark):
    rows = [(None, "x"), (A, "a text"), (B, None), (C, TEXT)]
    got = [r.doc_id for r in packing.pack_documents(frame(spark, rows), path("word_bpe_49k.json")).collect()]
    assert Counter(got) == Counter([None, A, B, C])


def test_quotation(spark):
    said = "What a user would ask about the table in the first place"
    rows = [(None, 1, "u", "x"), (A, 2**60 + 1, "u", said), (A + 1, 2**60 + 1, "u", "nothing"), (A + 1, 2**60 + 2, "u", f"> {said}\nYes"), (A, 2**60 + 3, "u", f"> {said}\nNo"), (A, None, "u", "y")]
    got = {(r.conv_id, r.turn): (r.reply_to, r.position) for r in quotation.reply_order(frame(spark, rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(None, 1): (None, 0), (A, 2**60 + 1): (None, 1), (A, 2**60 + 3): (2**60 + 1, 2), (A, None): (None, 0), (A + 1, 2**60 + 1): (None, 0), (A + 1, 2**60 + 2): (None, 1)}
