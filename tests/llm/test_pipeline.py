from collections import Counter

import corpus_pipeline
from fixtures import SCHEMA, documents
from pyspark.sql import functions as F
from test_jaccard_join import brute as near_brute
from test_line_dedup import brute as lines_brute

from sedge.llm import language_id, packing


def test_stages(spark):
    rows = documents()
    docs = spark.createDataFrame(rows, SCHEMA).cache()
    one = corpus_pipeline.identify_languages(spark, docs, "").cache()
    kept = [r for r in rows if r[1] and any(c.isalpha() for c in r[1])]
    assert Counter(r.doc_id for r in one.collect()) == Counter(r[0] for r in kept) and one.filter("lang is null").isEmpty()
    # the prediction stands for the label, whatever that says
    model = language_id.fit(docs.filter(~language_id.held_out()).select(F.col("doc_id").alias("order"), "text", "lang"))
    said = {r.doc_id: r.lang_pred for r in language_id.predict(docs, model).collect()}
    assert {r.doc_id: r.lang for r in one.collect()} == {i: said[i] for i in {r[0] for r in kept}}

    two = corpus_pipeline.drop_repeated_lines(spark, one, "").cache()
    gone = {x[:2] for x in lines_brute([r[:2] for r in kept])}
    texts = {r[0]: "\n".join(x for k, x in enumerate(r[1].split("\n")) if (r[0], k) not in gone) for r in kept}
    expected = {i: t for i, t in texts.items() if i not in {g[0] for g in gone} or t.strip()}
    assert {r.doc_id: r.text for r in two.collect()} == expected
    assert all(r.n_chars == len(r.text) for r in two.collect() if r.doc_id in {g[0] for g in gone})

    three = corpus_pipeline.drop_near_copies(spark, two, "").cache()
    assert sorted(r.doc_id for r in three.collect()) == [i for i, _, c in near_brute([(r.doc_id, r.text) for r in two.collect()], 5, 80) if i == c]

    four = corpus_pipeline.mix_sources(spark, three, "").cache()
    assert max(Counter(r.doc_id for r in four.collect()).values()) <= 2 and four.columns == corpus_pipeline.COLUMNS
    words = sum(len(r.text.split()) for r in three.collect())
    assert 1.2 * words < sum(len(r.text.split()) for r in four.collect()) <= 1.5 * words

    five = corpus_pipeline.pack_sequences(spark, four, "")
    assert sum(r.length for r in five.collect()) == sum(len(packing.codec(corpus_pipeline.path("word_bpe_49k.json")).encode(r.text)) // 4 + 1 for r in four.collect())


def test_short_lines_stay(spark):
    """A list or a text without spaces stays when it loses a shared header."""
    poem, zh = "\n".join(f"item{i}" for i in range(50)), "\u6625\u7720\u4e0d\u89c9\u6653"
    texts = ["the shared header line", f"the shared header line\n{poem}", f"the shared header line\n{zh}", "the shared header line\n \t"]
    docs = spark.createDataFrame([(i, t, "en", "s", None) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, "").collect()}
    assert got == {0: texts[0], 1: poem, 2: zh}


def test_null_and_repeated_ids(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    table = lambda rows: spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], schema)
    texts = lambda df: sorted(r.text for r in df.collect())
    a, b, c = ("\n".join(f"{x}{k} {x}{k + 1} {x}{k + 2} end" for k in range(9)) for x in "abc")

    lines = [(None, "top line of all\nc one two"), (1, "top line of all"), (2, "top line of all\na one two"), (2, "b one two\nb three four")]
    assert texts(corpus_pipeline.drop_repeated_lines(spark, table(lines), "")) == ["a one two", "b one two\nb three four", "c one two", "top line of all"]

    near = corpus_pipeline.drop_near_copies(spark, table([(None, a), (3, a), (7, a), (7, a), (7, b), (None, c), (None, c)]), "").collect()
    assert sorted((r.doc_id or 0, r.text) for r in near) == [(0, c), (3, a), (7, b)]

    mixed = corpus_pipeline.mix_sources(spark, table([(None, a), (None, b + " x"), (4, c + " y z"), (4, "one"), (4, "two words")]), "").collect()
    assert {r.text for r in mixed} == {a, b + " x", c + " y z", "one", "two words"}
    assert 1.3 * 114 < sum(len(r.text.split()) for r in mixed) <= 1.5 * 114


def test_runs_whole(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language identification", "line dedup", "near-copy join", "mixing", "packing"]
    assert corpus_pipeline.run(spark, "/root/testdata/sf0.001").count() > 50
