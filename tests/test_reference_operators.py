"""Cases with values worked out by hand."""

import base64
import io
import json
import zipfile
from datetime import datetime

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedge import schema
from sedge.functions import arrow as A
from sedge.functions import columns as C
from sedge.operators import billing, chunking, context, embedding, jobs, notices, reports, search, tables
from sedge.sources import extract, requests, sinks
from sedge.streaming import continuous

NOW = datetime(2024, 2, 10, 12, 0)


@pytest.fixture(autouse=True)
def _now(spark):
    global now
    now = F.lit(NOW).cast("timestamp_ntz")


def one(spark, **columns):
    r = spark.range(1).select(*[c.alias(k) for k, c in columns.items()]).first()
    return r[0] if len(columns) == 1 else tuple(r)


def test_text_functions(spark):
    assert one(spark, a=C.collapse_space(F.lit("  a \n　b﻿ ")), b=C.trim_all(F.lit("\t x y "))) == ("a b", "x y")
    assert one(spark, a=C.extension(F.lit("A.TXT")), b=C.extension(F.lit("README")), c=C.index_of(F.lit("xabc"), F.lit("bc")), d=C.index_of(F.lit("x"), F.lit("q"))) == ("txt", "readme", 2, -1)
    assert one(spark, a=C.section_number(F.lit("a\n\nb\n\n\nc"), F.lit(8)), b=C.utf16_length(F.lit("a😀")), c=C.preview(F.lit("x" * 301))) == (3, 3, "x" * 300 + "...")
    m = lambda **k: F.from_json(F.lit(json.dumps(k)), schema.METADATA)
    assert one(spark, a=C.location(m(estimatedPage=3, totalPages=10, chunkIndex=4, totalChunks=12, section=2)), b=C.location(m(chunkIndex=0))) == ("Page ~3/10, Chunk 5/12, Section 2", "Chunk 1/?")
    answer = lambda t, b=False: one(spark, x=C.structured_answer(F.lit(t), F.lit(b)))
    assert answer("  ") == "" and answer("Hi") == "## Answer\nHi\n\n## Key Points\n- Summarized above."
    assert answer("Hi", True).endswith("re-run with citations.") and answer("Answer\n# KEY POINTS\nsources ", True) == "Answer\n# KEY POINTS\nsources"
    assert answer("Answeré x").startswith("Answeré") and answer("Answers x").startswith("## Answer\n")
    assert one(spark, a=C.url_path(F.lit("a b/ü")), b=C.retry_delay_seconds(F.lit('retryDelay": "37s"'))) == ("a%20b/%C3%BC", 37)


def test_numbers(spark):
    assert one(spark, a=C.estimate_tokens(F.lit("")), b=C.estimate_tokens(F.lit("abcd")), c=C.estimate_tokens(F.lit("abcde"))) == (0, 1, 2)
    assert one(spark, a=C.quantity(F.lit(-3.0)), b=C.quantity(F.lit(2.4)), c=C.quantity(F.lit(2.5))) == (0, 2, 3)
    assert one(spark, a=C.storage_units(F.lit(1)), b=C.storage_units(F.lit(2**30)), c=C.storage_units(F.lit(3 * 2**29))) == (1, 1000, 1500)
    assert one(spark, a=C.position_percent(F.lit(2500), F.lit(10000)), b=C.page_estimate(F.lit(2500), F.lit(10000), F.lit(8)), c=C.page_estimate(F.lit(0), F.lit(9), F.lit(8)), d=C.page_estimate(F.lit(1), F.lit(9), F.lit(0))) == (25, 2, 1, None)
    assert [one(spark, a=C.backoff_minutes(F.lit(n))) for n in (1, 2, 3, 4, 6, 99)] == [2, 4, 8, 16, 60, 60]
    assert one(spark, a=C.minor_units(F.lit("1.005").cast("decimal(10,3)")), b=C.percent(F.lit(5), F.lit(0)), c=C.percent(F.lit(300), F.lit(100)), d=C.percent(F.lit(1), F.lit(200))) == (101, 0, 100, 1)
    assert one(spark, a=C.size_label(F.lit(1023)), b=C.size_label(F.lit(1536)), c=C.size_label(F.lit(5 * 1024 * 1024))) == ("1023 B", "1.5 KB", "5.0 MB")
    assert one(spark, a=C.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(0.0)))) is None
    assert one(spark, a=C.cycle_start(now), b=C.cycle_end(now)) == C.cycle_bounds(NOW) == (datetime(2024, 2, 1), datetime(2024, 2, 29, 23, 59, 59, 999000))
    assert one(spark, a=C.from_epoch(F.lit("86400")), b=C.from_epoch(F.lit("x")), c=C.plus_days(now), d=C.date_label(now)) == (datetime(1970, 1, 2), None, datetime(2024, 3, 11, 12), "Feb 10, 2024, 12:00 PM")
    assert C.flag("ON", False) and not C.flag("2", True) and C.flag(None, True)


def test_presentation(spark):
    trace = "TypeError: no x\n  at run (/app/a.js:3:7)\nnoise\n at node:internal/x.js:1:2\n at odd"
    t = one(spark, a=C.stack_trace(F.lit(trace)))
    assert (t.error_type, t.error_message) == ("TypeError", "no x")
    assert [tuple(f)[:5] for f in t.frames] == [("run", "/app/a.js", 3, 7, False), (None, "node:internal/x.js", 1, 2, True), (None, None, None, None, False)]
    assert one(spark, a=C.accepts(F.lit("image/*, text/csv"), F.lit("image/png")), b=C.accepts(F.lit("text/csv"), F.lit("text/plain")), c=C.accepts(F.lit(" "), F.lit("x/y"))) == (True, False, True)
    assert one(spark, a=C.media_category(F.lit("file"), F.lit("video/x")), b=C.attachment_label(F.lit("file"), F.lit("image/x"), F.lit(None), F.lit("")), c=C.duration_label(F.lit(999)), d=C.duration_label(F.lit(1500))) == ("video", "Image", "999ms", "1.50s")
    assert one(spark, a=C.is_pdf(F.lit("x"), F.lit("A.PDF")), b=C.is_text_viewable(F.lit("text/html"), F.lit("a.q")), c=C.icon(F.lit(""), F.lit("a.docx"))) == (True, True, "document")


def test_tokens_and_signatures(spark):
    df = spark.createDataFrame([("u", "f.txt", 5, "text/plain", 1000)], "userId string, fileName string, fileSize bigint, fileType string, expiresAt bigint")
    token = df.select(A.upload_token(F.struct("*"), "s").alias("t")).first().t
    rows = spark.createDataFrame([(token,), (token + "x",), ("bad",), (None,)], "t string")
    got = rows.select(A.token_payload(F.col("t"), "s", 1000).alias("p")).collect()
    assert got[0].p.fileName == "f.txt" and [g.p for g in got[1:]] == [None] * 3
    assert rows.limit(1).select(A.token_payload(F.col("t"), "s", 1001).alias("p")).first().p is None
    signed = rows.limit(1).select(F.lit("b").alias("b"), A.hmac_hex(F.lit("b"), "k").alias("h"))
    assert signed.select(A.signature_holds("b", "h", "k").alias("x"), A.signature_holds("b", F.lit(None).cast("string"), "k").alias("y")).first() == (True, False)
    A.register(spark)
    assert spark.sql("select estimate_tokens('abcde'), sanitize_text(' a  b '), round(cosine_similarity(array(1f, 0f), array(1f, 1f)), 4)").first() == (2, "a b", 0.7071)


def test_rating(spark):
    plan = schema.plans(spark).filter("plan_code = 'free'")
    cost = lambda *u: float(plan.select(C.overage_inr(*[F.lit(x) for x in u]).alias("x")).first().x)
    assert cost(1_500_000, 400_000, 1_250_000, 30_000) == 100.0 and cost(0, 300_000, 5, 15_000) == 0.0
    events = spark.createDataFrame([("a", "model_input_tokens", 1_500_000, datetime(2024, 2, 29, 23, 59, 59)), ("a", "other", 9, NOW), ("b", "model_output_tokens", 10**10, NOW), ("a", "model_input_tokens", 7, datetime(2024, 3, 1))], "user_id string, metric string, quantity bigint, occurred_at timestamp_ntz")
    subs = spark.createDataFrame([(1, "b", "pro", "active", NOW), (2, "b", "weird", "active", datetime(2024, 1, 1)), (3, "c", "weird", "active", NOW), (4, "c", "team", "canceled", NOW)], "id int, user_id string, plan_code string, status string, updated_at timestamp_ntz")
    got = {r.user_id: r for r in billing.usage_summary(events, subs, spark.createDataFrame([("a",), ("b",), ("c",)], "user_id string"), NOW).collect()}
    assert (got["a"].plan_code, float(got["a"].overage_inr), got["a"].is_blocked) == ("free", 30.0, True)
    assert (got["b"].plan_code, got["b"].used_output, got["b"].is_blocked) == ("pro", 10**10, False)
    assert (got["c"].plan_code, got["c"].used_input) == ("free", 0)
    limits = billing.upload_limits(spark.createDataFrame([("a",)], "user_id string"), subs)
    assert limits.first().max_bytes == 26_214_400
    requests_ = spark.createDataFrame([("a", "f", 1, "t"), ("z", "f", 26_214_401, "t"), ("z", "", 1, "t"), ("z", "f", 1, "t")], "user_id string, file_name string, file_size bigint, file_type string")
    summary = spark.createDataFrame([("a", True)], "user_id string, is_blocked boolean")
    assert sorted(r.status for r in billing.upload_decisions(requests_, limits, summary).collect()) == [200, 400, 402, 413]


def test_splitter_cases():
    text = "aaaa bbbb cccc dddd"
    assert chunking.split(text, 10, 3) == ["aaaa bbbb", "cccc dddd"]
    assert chunking.split(text, 10, 5) == ["aaaa bbbb", "bbbb cccc", "cccc dddd"]


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="ab \n", max_size=300), st.integers(5, 40), st.integers(0, 4))
def test_splitter_properties(text, size, overlap):
    text = text.strip()
    parts = chunking.split(text, size, overlap) if text else []
    assert all(0 < len(p) <= size and p in text and p == p.strip() for p in parts)
    letters = [c for c in text if not c.isspace()]
    at = iter(letters)
    seen = [c for p in parts for c in p if not c.isspace()]
    assert all(c in at for c in letters[:0]) and len(seen) >= len(letters) and set(seen) == set(letters)
    if text and len(text) <= size - 1:
        assert parts == [text]


def test_chunk_metadata(spark):
    text = "first part\n\nsecond part\n\n" + "word " * 30
    df = spark.createDataFrame([(1, "a.txt", text, 4), (2, "b.txt", " \n ", 1), (3, "c.txt", None, 1)], "id int, name string, text string, pages int")
    rows = chunking.chunk(df, pages_col="pages", size=40, overlap=5).orderBy("chunk_index").collect()
    assert {r.id for r in rows} == {1} and [r.chunk_index for r in rows] == list(range(len(rows)))
    for r in rows:
        m = r.metadata
        assert text.find(r.content) == m.charOffset and m.totalChunks == len(rows) and m.charLength == len(r.content)
        assert m.section == text[: m.charOffset].count("\n\n") + 1 and m.fileName == "a.txt" and 1 <= m.estimatedPage <= 4


def test_chunks_without_batches_of_texts(spark):
    lead = "\ufeff\u3000 \n\n"
    texts = [lead + "one\n\ntwo 😀 " * 9 + "\t", "", None, lead, "x"]
    made = chunking.chunk(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, text string"), name_col=None, size=20, overlap=4)
    got = [(r.id, r.content, r.metadata.charOffset, r.metadata.section) for r in made.orderBy("id", "chunk_index").collect()]
    body = texts[0].strip("\ufeff\u3000 \n\t")
    want = [(0, c, texts[0].find(c), texts[0][: texts[0].find(c)].count("\n\n") + 1) for c in chunking.split(body, 20, 4)]
    assert got == [*want, (4, "x", 0, 1)]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "Arrow" not in plan  # a hundred rows at a time, not ten thousand


def test_search(spark):
    chunks = spark.createDataFrame([(1, "u", 1, "c1", [1.0, 0.0]), (2, "u", 1, "c2", [0.0, 1.0]), (3, "v", 2, "c3", [1.0, 0.0]), (4, "u", 1, "c4", [0.0, 0.0])], "id int, user_id string, file_id int, content string, embeddings array<float>").withColumn("metadata", F.lit(None).cast(schema.METADATA))
    files = spark.createDataFrame([(1, "f", "t", "u"), (2, "g", "t", "v")], "id int, name string, type string, user_id string")
    assert [r.id for r in search.search([1.0, 0.0], chunks, files, "u", threshold=0.5).collect()] == [1]
    assert search.search([1.0, 0.0], chunks, files, "u", threshold=1.0).collect() == []
    rng = np.random.default_rng(0)
    rows = [(i, "uv"[i % 2], [float(x) for x in rng.normal(size=6)]) for i in range(200)]
    many = spark.createDataFrame(rows, "id int, user_id string, embeddings array<float>").repartition(4)
    queries = spark.createDataFrame([(q, "uvw"[q % 3], [float(x) for x in rng.normal(size=6)]) for q in range(20)], "query_id int, user_id string, vector array<float>")
    a, b = (sorted((r.query_id, r["rank"], r.id, round(r.similarity, 9)) for r in f(queries, many).collect()) for f in (search.search_many, search.search_joined))
    assert a == b and max(x[1] for x in a) == 10


def test_context_round_trip(spark):
    hits = spark.createDataFrame([(1, 2, "two", 0.4), (1, 1, "one\nline", 0.9)], "query_id int, rank int, content string, similarity double").withColumn("metadata", F.lit(None).cast(schema.METADATA)).withColumn("file", F.struct(F.lit(7).alias("id"), F.lit("n").alias("name"), F.lit("t").alias("type")))
    got = {r.query_id: r.context for r in context.build_context(spark.createDataFrame([(1,), (2,)], "query_id int"), hits).collect()}
    assert got[2] == C.NOTHING_FOUND and got[1].startswith("[Citation 1] Source: [n](/files/7) | \nContent: one\nline\n\n---\n\n[Citation 2]")
    back = context.parse_context(spark.createDataFrame(list(got.items()), "query_id int, context string")).orderBy("position").collect()
    assert [(r.query_id, r.content) for r in back] == [(1, "one\nline"), (1, "two")]


def test_jobs(spark):
    rows = [(1, 1, "queued", 0, None, datetime(2024, 1, 2)), (2, 1, "queued", 0, datetime(2024, 2, 1), datetime(2024, 1, 1)), (3, 1, "queued", 0, datetime(2024, 3, 1), datetime(2024, 1, 1)), (4, 1, "processing", 0, None, datetime(2023, 1, 1))]
    df = spark.createDataFrame([(*r[:4], None, r[4], None, None, r[5], r[5]) for r in rows], schema.JOBS)
    assert [r.id for r in jobs.due_jobs(df, now).collect()] == [2, 1]
    assert jobs.clamp_limit(0) == 1 and jobs.clamp_limit(99) == 20 and jobs.clamp_limit(None) == 2
    with pytest.raises(ValueError):
        jobs.clamp_limit(float("nan"))
    for before, wait in ((0, 2), (1, 4), (2, 8), (3, 16), (4, None)):
        r = jobs.fail(jobs.claim(df.filter("id = 1").withColumn("attempts", F.lit(before)), now), F.lit("e"), now).first()
        assert (r.status, r.next_retry_at) == (("queued", datetime(2024, 2, 10, 12, wait)) if wait else ("failed", None))
    after = {r.id: r for r in continuous.work_queue(df, now, lambda c: c.select("id", F.when(F.col("id") == 2, "bad").alias("error"))).collect()}
    assert [after[i].status for i in (1, 2, 3, 4)] == ["completed", "queued", "queued", "processing"] and after[2].last_error == "bad"


def notice(event, at=1, sub=None, pay=None):
    p = {k: {"entity": v} for k, v in (("subscription", sub), ("payment", pay)) if v}
    return json.dumps({"event": event, "created_at": at, "payload": p})


def test_notices(spark):
    sub = {"id": "s1", "plan_id": "P", "notes": {"userId": "u"}, "current_start": 0, "current_end": 86400}
    rows = [(1, notice("subscription.activated", 1, sub)), (2, notice("subscription.charged", 2, sub)), (3, notice("payment.failed", 3, {"id": "s2", "notes": {"userId": "w"}})), (4, notice("other", 4)), (5, notice("payment.captured", 5, None, {"id": "p1"}))]
    df = spark.createDataFrame(rows, "seq bigint, body string")
    prices = schema.price_ids(spark, {("pro", "razorpay", "INR"): "P", ("team", "razorpay", "INR"): ""})
    none, subs = spark.createDataFrame([], schema.PAYMENT_EVENTS), spark.createDataFrame([(9, "u", "team", "razorpay", "old", "inactive", None, None, True, NOW, NOW)], schema.SUBSCRIPTIONS)
    events, after = notices.take_in(none, subs, df, prices, now)
    assert sorted(r.event_id for r in events.collect()) == ["other-4", "p1", "s1", "s2"]
    got = {r.user_id: r for r in after.collect()}
    assert (got["u"].id, got["u"].plan_code, got["u"].status, got["u"].cancel_at_period_end, got["u"].current_period_end) == (9, "pro", "active", False, datetime(1970, 1, 2))
    assert (got["w"].id, got["w"].plan_code, got["w"].status) == (10, "free", "past_due")
    again, same = notices.take_in(events.withColumn("id", F.lit(1)), after, df, prices, now)
    assert again.collect() == [] and sorted(map(str, same.collect())) == sorted(map(str, after.collect()))
    assert notices.take_in(none, subs, df, prices, now, lifecycle=True)[0].count() == 5
    assert notices.paid_subscriptions(spark.createDataFrame([("u", "pro", 1)], "user_id string, plan_code string, seq int"), now).first().current_period_end == datetime(2024, 3, 11, 12)


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    src.mkdir()
    (src / "a.json").write_text("\n".join(json.dumps({"seq": i, "ts": f"2024-02-10T12:0{i}:00Z", "body": notice("subscription.x", 1, {"id": f"s{i % 2}"})}) for i in range(6)))
    seen = []
    q = continuous.each_batch(continuous.first_notices(continuous.notice_stream(spark, str(src))), lambda df, n: seen.extend(r.event_id for r in df.collect()), str(tmp_path / "cp"))
    q.awaitTermination(120)
    assert sorted(seen) == ["s0", "s1"]


def test_tables(spark, tmp_path):
    old = spark.createDataFrame([(1, "a"), (1, "b"), (2, "c")], "file_id int, content string")
    new = spark.createDataFrame([(1, "z")], "file_id int, content string")
    merged = tables.replace_by_key(old, new, "file_id")
    assert sorted(map(tuple, merged.collect())) == [(1, "z"), (2, "c")] == sorted(map(tuple, tables.replace_by_key(merged, new, "file_id").collect()))
    path = str(tmp_path / "chunks")
    for df in (old, new, new):
        sinks.replace_chunks(df, path, 4)
    assert sorted((r.file_id, r.content) for r in spark.read.parquet(path).collect()) == [(1, "z"), (2, "c")]
    files = spark.createDataFrame([(1, "u"), (2, "u"), (3, "v")], "id int, user_id string")
    left = tables.delete_owned(files, spark.createDataFrame([(1, "u"), (3, "u")], "id int, user_id string"))
    assert sorted(r.id for r in left.collect()) == [2, 3]
    assert [r.file_id for r in tables.cascade(old, left, "file_id").collect()] == [2]
    assert [r.id for r in tables.orphans(files, old, "file_id").collect()] == [3]
    customers = spark.createDataFrame([], schema.CUSTOMERS)
    made = tables.upsert_customers(customers, spark.createDataFrame([("u", "g", None)], "user_id string, gateway string, gateway_customer_id string"), now)
    known = tables.upsert_customers(made, spark.createDataFrame([("u", "g", "c1")], "user_id string, gateway string, gateway_customer_id string"), now)
    assert [(r.id, r.gateway_customer_id, r.currency) for r in known.collect()] == [(1, "c1", "INR")]


def test_broken_replacement(spark, tmp_path):
    path = str(tmp_path / "chunks")
    sinks.replace_chunks(spark.createDataFrame([(1, "a"), (2, "b")], "file_id int, content string"), path, 4)
    changed = spark.read.parquet(path).withColumn("content", F.when(F.col("file_id") == 1, "z").otherwise(F.col("content")))
    changed.write.partitionBy("bucket").parquet(f"{path}.staged")  # whole, but not in place
    sinks.recover_chunks(spark, path)
    assert {r.content for r in spark.read.parquet(path).collect()} == {"z", "b"}
    assert not (tmp_path / "chunks.staged").exists()
    (tmp_path / "chunks.staged").mkdir()  # nothing whole: dropped
    before = sorted(map(tuple, spark.read.parquet(path).collect()))
    sinks.recover_chunks(spark, path)
    assert sorted(map(tuple, spark.read.parquet(path).collect())) == before and not (tmp_path / "chunks.staged").exists()


def test_numbered(spark):
    rows = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("a"), (F.col("id") % 3).alias("b"))
    got = sorted(map(tuple, tables.numbered(rows, ["a", "b"]).collect()))
    assert [n for *_, n in got] == list(range(1, 5001))
    assert tables.numbered(rows.limit(0), ["a"]).count() == 0


def test_chunk_table_function(spark):
    chunking.register(spark)
    text = "one two three four"
    got = spark.sql(f"SELECT * FROM chunk_text('{text}', 9, 2) ORDER BY chunk_index").collect()
    assert [tuple(r) for r in got] == list(enumerate(chunking.split(text, 9, 2)))
    assert spark.sql("SELECT * FROM chunk_text(' ', 9, 2)").count() == 0


def docx(paragraphs):
    out = io.BytesIO()
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>')
    return out.getvalue()


def test_extraction(spark, tmp_path):
    rows = [("a.txt", None, b"hi \xff"), ("b.csv", "text/csv", b'a,"b\nc"\n\n1,2\n'), ("c.csv", "text/plain", b"a,b"), ("d.docx", None, docx(["one", "two"])), ("README", "", b"x"), ("e.md", None, b" \n"), ("f.pdf", None, b"%PDF"), ("g.csv", None, b"a,b\nc"), ("h.docx", None, b"junk")]
    df = spark.createDataFrame(rows, "name string, type string, content binary")
    got = {r.name: (r.text, r.error) for r in extract.extract(df, pdf_reader=lambda raw: ("pages", 2)).collect()}
    assert got["a.txt"][0] == "hi �" and got["b.csv"][0] == "a b\nc\n1 2" and got["c.csv"][0] == "a,b" and got["d.docx"][0] == "one\n\ntwo\n\n" and got["f.pdf"][0] == "pages"
    assert got["README"] == (None, "Unsupported file type: .readme") and got["e.md"][1].startswith("No text extracted") and got["g.csv"][1] and got["h.docx"][1]
    assert extract.extract(df.filter("name = 'a.txt'"), max_bytes=2).first().error == "File is too large"
    (tmp_path / "x y.txt").write_bytes(b"q")
    assert [(r.name, bytes(r.content)) for r in extract.read_binary(spark, str(tmp_path), "*.txt").collect()] == [("x y.txt", b"q")]
    big = bytes(range(256)) * 3
    uri = f"data:application/x;base64,{base64.b64encode(big).decode()}"
    assert one(spark, a=C.data_uri(F.lit(big), F.lit("application/x"))) == uri
    r = spark.createDataFrame([(uri, None), ("nope", None), (None, None)], "d string, s binary").select(*[c.alias(n) for c, n in zip(extract.body(F.col("s"), F.col("d")), ("b", "e"), strict=True)]).collect()
    assert bytes(r[0].b) == big and [x.e for x in r] == [None, "Invalid file data", "No file content"]


def test_requests(spark):
    rows = spark.createDataFrame([('{"fileName":"a","fileSize":3,"fileType":"t"}',), ('{"fileName":"","fileSize":3,"fileType":"t"}',), ("junk",)], "body string")
    good, bad = requests.upload_requests(rows)
    assert good.count() == 1 and bad.count() == 2
    good, bad = requests.checkout_requests(spark.createDataFrame([('{"planCode":"pro","gateway":"razorpay"}',), ('{"planCode":"free","gateway":"razorpay"}',)], "body string"))
    assert good.first().request.currency == "INR" and bad.count() == 1


def test_embedding(spark):
    e = embedding.HashingEmbedder(32)
    assert np.allclose(np.linalg.norm(e.embed(["a b", "c"]), axis=1), 1) and e.embed([]).shape == (0, 32)
    df = spark.createDataFrame([(1, " a  b "), (2, None)], "id int, text string")
    got = {r.id: r.embeddings for r in embedding.embed(df, "text", e).collect()}
    assert got[2] is None and np.allclose(got[1], e.embed(["a b"])[0])
    waits, calls = [], []

    def call(texts):
        calls.append(len(texts))
        if len(calls) == 2:
            raise embedding.RateLimited('retryDelay: "7s"')
        return np.ones((len(texts), 3))

    assert embedding.RemoteEmbedder(call, 3, sleep=waits.append).embed(["x"] * 20).shape == (20, 3)
    assert calls == [14, 6, 6] and waits == [61.0, 9]


def test_history_and_reports(spark):
    df = spark.createDataFrame([("m1", "c", "data", "hi", None, NOW), ("m2", "c", "user", "x", [("text", "y", None, None, None)], NOW), ("m3", "c", "assistant", "z", [("tool-invocation", None, C.SEARCH_TOOL, "{}", "t")], NOW)], schema.MESSAGES)
    got = {r.id: r for r in reports.restored_history(df).collect()}
    assert got["m1"].role == "system" and got["m1"].parts[0].text == "hi" and got["m2"].parts[0].text == "y" and [p.type for p in got["m3"].parts] == ["text", "tool-invocation"]
    assert reports.retrieval_counters(df).first() == ("c", 3, 1) and reports.last_search(df).first()["last"].toolCallId == "t"
    calls = F.from_json(F.lit('[[{"type":"tool-call","toolName":"searchKnowledgeBase","args":"{}","toolCallId":"1"},{"type":"text"}],null]'), "array<array<struct<type:string,toolName:string,args:string,toolCallId:string>>>")
    assert one(spark, a=C.had_lookup(C.tool_calls(calls)), b=F.size(C.assistant_parts(F.lit("t"), C.tool_calls(calls)))) == (True, 2)
    assert one(spark, a=C.message_text(F.lit(None).cast(f"array<{schema.PART}>"))) == ""
    segments = spark.createDataFrame([("a", 0.0, 1.0), (" ", 0.0, 9.0), ("b", 1.0, 2.0)], "text string, start double, end double")
    assert [r.text for r in reports.active_segments(segments, F.lit(1.0)).collect()] == ["b"]
    rates = reports.pass_rates(spark.createDataFrame([("s", "passed"), ("s", "failed")], "suite string, status string")).first()
    assert rates.passed_percent == 50.0
