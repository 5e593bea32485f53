"""PDF files as three kinds of producers write them, and broken ones."""

import base64
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedge.plans.queries import QUERIES
from sedge.sources import extract, pdf


def stream(data, more=b""):
    return b"<< /Length %d %s >>\nstream\n%s\nendstream" % (len(data), more, data)


def classic(objects, trailer=b"", head=b"%PDF-1.4\n", places=None, start=None):
    """Objects by number with a table of references, the whole file or an update behind ``head``."""
    out, places = head, {} if places is None else places
    own = {}
    for n, body in objects.items():
        own[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    out += b"xref\n0 1\n0000000000 65535 f \n" if start is None else b"xref\n"
    for n, place in own.items():
        out += b"%d 1\n%010d 00000 n \n" % (n, place)
    prev = b"" if start is None else b"/Prev %d " % start
    return out + b"trailer\n<< /Size 99 /Root 1 0 R %s%s>>\nstartxref\n%d\n%%%%EOF\n" % (prev, trailer, at), at


SIMPLE = {
    1: b"<< /Type /Catalog /Pages 2 0 R >>",
    2: b"<< /Type /Pages /Kids [3 0 R 4 0 R] /Count 2 /Resources << /Font << /F1 5 0 R /F#32 6 0 R >> >> >>",
    3: b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R >>",
    4: b"<< /Type /Page /Parent 2 0 R /Contents [8 0 R 9 0 R] >>",
    5: b"<< /Type /Font /Subtype /Type1 /BaseFont /Helvetica /Encoding /WinAnsiEncoding >>",
    6: b"<< /Type /Font /Subtype /Type1 /BaseFont /X /Encoding << /BaseEncoding /MacRomanEncoding /Differences [65 /eacute /fi 200 /uni20AC /Lslash.alt] >> >>",
    7: stream(b"BT /F1 12 Tf 72 720 Td (Hello \\(wor\\154d\\)) Tj [( ke)-20(rned)-300(gap)] TJ 0 -14 Td (se\\\ncond) Tj ET % note\nBT /F1 12 Tf 1 0 0 1 72 600 Tm (caf\\351 \x80) Tj ET"),
    8: stream(b"BT /F2 10 Tf 12 TL 1 0 0 1 10 50 Tm <4142C8> Tj (x)"),
    9: stream(b"' T* (y) Tj q BI /W 1 /H 1 ID \x00(\xff) Tj\n EI Q (z) Tj ET"),
}
PAGES = ["Hello (world) kerned gap\nsecond\ncafé €", "éﬁ€\nx\nyz"]


def modern():
    """Objects in compressed streams, and a stream of references with a predictor."""
    inner = {1: b"<< /Type /Catalog /Pages 2 0 R >>", 2: b"<< /Type /Pages /Kids [3 0 R] /Count 1 >>", 3: b"<< /Type /Page /Contents 6 0 R /Resources 4 0 R >>", 4: b"<< /Font << /F1 5 0 R >> >>", 5: b"<< /Type /Font /Subtype /Type0 /ToUnicode 7 0 R /Encoding /Identity-H >>"}
    heads, bodies = b"", b""
    for n, body in inner.items():
        heads += b"%d %d " % (n, len(bodies))
        bodies += body + b" "
    cmap = b"begincmap 1 begincodespacerange <0000> <FFFF> endcodespacerange 2 beginbfchar <0001> <D83DDE00> <0002> <00660069> endbfchar 2 beginbfrange <0010> <0012> <0041> <0020> <0021> [<4E2D> <6587>] endbfrange endcmap"
    packed = zlib.compress(heads + bodies)
    whole = {8: stream(packed, b"/Type /ObjStm /N 5 /First %d /Filter /FlateDecode" % len(heads)), 6: stream(zlib.compress(b"BT /F1 9 Tf <0010001100120001> Tj 0 -10 TD <00020020> Tj T* <0021> Tj ET"), b"/Filter [/FlateDecode]"), 7: stream(zlib.compress(cmap), b"/Filter /FlateDecode")}
    out, places = b"%PDF-1.5\n%\xe2\xe3\n", {}
    for n, body in whole.items():
        places[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body)
    at = len(out)
    rows = [(0, 0, 0), *[(2, 8, i) for i in range(5)], *[(1, places[n], 0) for n in (6, 7, 8)], (1, at, 0)]
    table, before = b"", bytes(4)
    for kind, a, b in rows:
        row = bytes([kind]) + a.to_bytes(2, "big") + bytes([b])
        table += b"\x02" + bytes((x - y) & 255 for x, y in zip(row, before, strict=True))
        before = row
    out += b"9 0 obj\n" + stream(zlib.compress(table), b"/Type /XRef /Size 10 /W [1 2 1] /Root 1 0 R /Filter /FlateDecode /DecodeParms << /Predictor 12 /Columns 4 >>") + b"\nendobj\nstartxref\n%d\n%%%%EOF" % at
    return out


MODERN = "ABC😀\nfi中\n文"


def updated():
    """A file with an update that replaces a page's content; a form; two filters."""
    first, at = classic(SIMPLE)
    content = base64.a85encode(zlib.compress(b"BT /F1 9 Tf (new) Tj ET /Fm Do")) + b"~>"
    form = stream(b"BT 1 0 0 1 0 -5 Tm /F1 9 Tf (form) Tj ET", b"/Type /XObject /Subtype /Form /Resources << /Font << /F1 5 0 R >> >>")
    new = {3: b"<< /Type /Page /Parent 2 0 R /Contents 7 0 R /Resources << /Font << /F1 5 0 R >> /XObject << /Fm 10 0 R >> >> >>", 7: stream(content, b"/Filter [/A85 /Fl]"), 10: form}
    return classic(new, head=first, start=at)[0]


def test_three_producers():
    assert list(pdf.texts(classic(SIMPLE)[0])) == PAGES
    assert pdf.read(modern()) == (f"\n\n{MODERN}", 1)
    assert list(pdf.texts(updated())) == ["new\nform", PAGES[1]]


def test_lost_references():
    whole = classic(SIMPLE)[0]
    assert list(pdf.texts(whole.replace(b"startxref", b"startxxxx"))) == PAGES
    assert list(pdf.texts(b"junk before " + whole)) == PAGES
    assert list(pdf.texts(whole[: whole.index(b"xref\n0 1")])) == PAGES
    m = modern()
    assert list(pdf.texts(m[: m.index(b"9 0 obj")])) == [MODERN]
    assert list(pdf.texts(whole.replace(b"/Length 4", b"/Length 9"))) == PAGES


def test_what_isnt_read_says_so():
    for raw, why in [(b"", "no PDF"), (b"%PDF-1.4\n", "no pages"), (classic(SIMPLE, b"/Encrypt << >> ")[0], "encrypted"), (classic(SIMPLE | {7: stream(b"x", b"/Filter /LZWDecode")})[0], "LZWDecode"), (b"%PDF-1.4 1 0 obj " + b"[" * 5000, "nested too deep")]:
        with pytest.raises(pdf.PdfError, match=why):
            list(pdf.texts(raw))
    circle = SIMPLE | {2: b"<< /Type /Pages /Kids [2 0 R 3 0 R 2 0 R] /Resources << /Font << /F1 5 0 R >> >> >>"}
    assert list(pdf.texts(classic(circle)[0])) == PAGES[:1]


@settings(max_examples=150, deadline=5000)
@given(st.data())
def test_damage_is_an_error_at_most(data):
    raw = bytearray(data.draw(st.sampled_from([classic(SIMPLE)[0], modern(), updated()])))
    for _ in range(data.draw(st.integers(1, 6))):
        raw[data.draw(st.integers(9, len(raw) - 1))] = data.draw(st.integers(0, 255))
    raw = bytes(raw[: data.draw(st.integers(20, len(raw)))])
    try:
        assert all(isinstance(t, str) for t in pdf.texts(raw))
    except RecursionError:
        raise
    except Exception as e:
        assert isinstance(e, (ValueError, KeyError, TypeError, IndexError, AttributeError, zlib.error, OverflowError))


def test_rows_of_pages(spark):
    big = 2**60 + 1
    files = [(big, classic(SIMPLE)[0]), (None, modern()), (big + 2, b"junk"), (4, None)]
    df = spark.createDataFrame(files, "id long, content binary").coalesce(1)
    got = sorted((tuple(r) for r in pdf.page_rows(df).collect()), key=repr)
    assert got == sorted([(big, 1, PAGES[0], None), (big, 2, PAGES[1], None), (None, 1, MODERN, None), (big + 2, None, None, "PdfError: no PDF file"), (4, None, None, "PdfError: no PDF file")], key=repr)
    assert pdf.page_rows(df.limit(0)).collect() == []


def test_extraction(spark):
    rows = [("a.pdf", "", classic(SIMPLE)[0]), ("b", "application/pdf", modern()), ("c.pdf", "", b"junk"), ("d.pdf", "", classic(SIMPLE | {7: stream(b""), 8: stream(b""), 9: stream(b"")})[0])]
    got = {r.name: (r.text, r.num_pages, r.error) for r in extract.extract(spark.createDataFrame(rows, "name string, type string, content binary")).collect()}
    assert got["a.pdf"] == (f"\n\n{PAGES[0]}\n\n{PAGES[1]}", 2, None) and got["b"] == (f"\n\n{MODERN}", 1, None)
    assert got["c.pdf"][2] == "PdfError: no PDF file" and got["d.pdf"][2].startswith("No text extracted from d.pdf.")


def test_a_file_as_an_expression(spark):
    texts = ["one line", "two\n\nlines 中 😀 (x) \\", "", "a\tb\r"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").select("id", pdf.one_page(F.col("t")).alias("content"))
    assert [r.text for r in pdf.page_rows(df).orderBy("id").collect()] == ["\n".join(x for x in t.split("\n") if x) for t in texts]


def test_a_code_is_looked_for_once(monkeypatch):
    asked, meaning = [], pdf.Font.meaning
    monkeypatch.setattr(pdf.Font, "meaning", lambda self, code: asked.append(code) or meaning(self, code))
    cmap = b"1 begincodespacerange <0000> <FFFF> endcodespacerange 1 beginbfrange <0000> <FFFF> <0000> endbfrange"
    page = {7: stream(b"BT /F1 9 Tf <" + "abba".encode("utf-16-be").hex().encode() * 50 + b"0063 61> Tj ET"), 5: b"<< /Type /Font /Subtype /Type0 /ToUnicode 10 0 R >>", 10: stream(cmap)}
    assert next(pdf.texts(classic(SIMPLE | page)[0])) == "abba" * 50 + "ca"
    assert sorted(asked) == [0x61, 0x61, 0x62, 0x63]  # the last one is half a code


def test_pages_are_read_by_all_tasks(spark, tmp_path, monkeypatch):
    html = [f"page {i}\n{'x' * 50}" for i in range(400)]
    spark.createDataFrame(list(enumerate(html)), "page_id long, html string").coalesce(1).write.parquet(str(tmp_path / "pages.parquet"))
    got = QUERIES["pdf_pages"](spark, str(tmp_path))
    assert sum(n > 0 for n in got.rdd.mapPartitions(lambda rows: [sum(1 for _ in rows)]).collect()) >= 8
    assert [r.text for r in got.orderBy("id").collect()] == html
    monkeypatch.setattr(pdf, "TOGETHER", 300)
    files = spark.createDataFrame([(i, classic(SIMPLE)[0]) for i in range(9)], "id int, content binary").coalesce(1)
    assert sorted((r.id, r.page, r.text) for r in pdf.page_rows(files).collect()) == [(i, n, PAGES[n - 1]) for i in range(9) for n in (1, 2)]
