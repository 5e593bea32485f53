"""Text of uploaded files: binary files in, text, pages and error out."""

from __future__ import annotations

import csv
import io
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.functions import columns as C
from sedge.sources import pdf

DOCX_TYPE = "application/vnd.openxmlformats-officedocument.wordprocessingml.document"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
PdfReader = Callable[[bytes], tuple[str, int]]


def read_binary(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """name, content, length, modified of the files below a path of any file system."""
    rows = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path)
    return rows.select(F.url_decode(F.element_at(F.split("path", "/"), -1)).alias("name"), "content", "length", F.col("modificationTime").cast("timestamp_ntz").alias("modified"))


def body(storage_content: Column, file_data: Column) -> tuple[Column, Column]:
    """(bytes, error): stored bytes, else those of the inline address."""
    inline = C.data_uri_bytes(file_data)
    bytes_ = F.coalesce(storage_content, inline)
    error = F.when(bytes_.isNull(), F.when(file_data.isNotNull(), "Invalid file data").otherwise("No file content"))
    return bytes_, error


def kind(mime, name) -> Column:
    """Which reader a file gets; the type or the extension decides, in this order."""
    m, e = F.coalesce(F.col(mime), F.lit("")), C.extension(name)
    return F.when((m == "application/pdf") | (e == "pdf"), "pdf").when(m.isin("text/plain", "text/markdown") | e.isin("txt", "md"), "text").when((m == "text/csv") | (e == "csv"), "csv").when((m == DOCX_TYPE) | (e == "docx"), "docx")


def csv_text(raw: bytes) -> str:
    """Cells joined by a space, rows by a newline; rows of unlike length are an error."""
    rows = [r for r in csv.reader(io.StringIO(raw.decode("utf-8", "replace"), newline=""), strict=True) if r]
    if len({len(r) for r in rows}) > 1:
        raise ValueError("rows of unlike length")
    return "\n".join(" ".join(r) for r in rows)


def docx_text(raw: bytes) -> str:
    """Paragraphs, each followed by a blank line."""
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        root = ET.fromstring(z.read("word/document.xml"))
    out = []
    for paragraph in root.iter(f"{_WORD}p"):
        parts = {f"{_WORD}t": lambda n: n.text or "", f"{_WORD}tab": lambda n: "\t", f"{_WORD}br": lambda n: "\n"}
        out.append("".join(parts[n.tag](n) for n in paragraph.iter() if n.tag in parts))
    return "".join(f"{p}\n\n" for p in out)


def extract(files: DataFrame, content_col: str = "content", name_col: str = "name", type_col: str = "type", max_bytes: int | None = None, pdf_reader: PdfReader | None = None) -> DataFrame:
    """``files`` without content, with text, num_pages and error.

    Plain text is decoded by an expression; only other kinds go through Python. A
    failure is a row's error, never the job's. ``max_bytes``: larger ones are errors.
    ``pdf_reader``: another reader than that of ``pdf``, from bytes to (text, pages).
    """
    read_pdf = pdf_reader or pdf.read

    @F.pandas_udf("text string, num_pages int, error string")
    def parse(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        def one(raw: bytes, which: str) -> tuple:
            try:
                if which == "pdf":
                    return *read_pdf(raw), None
                return (csv_text if which == "csv" else docx_text)(raw), None, None
            except Exception as e:  # whatever a broken file makes a parser raise is that file's error
                return None, None, f"{type(e).__name__}: {e}"

        for raws, kinds in batches:
            yield pd.DataFrame([(None, None, None) if k in (None, "text") or r is None else one(r, k) for r, k in zip(raws, kinds, strict=True)], columns=["text", "num_pages", "error"]).astype({"num_pages": "Int32"})

    rows = files.withColumn("_kind", kind(type_col, name_col))
    if max_bytes is not None:
        rows = rows.withColumn("_large", F.length(content_col) > max_bytes)
    else:
        rows = rows.withColumn("_large", F.lit(False))
    plain = F.make_valid_utf8(F.col(content_col).cast("string"))
    simple = F.col("_kind").isNull() | (F.col("_kind") == "text") | F.col("_large")
    left = rows.filter(simple).withColumns({"_text": F.when((F.col("_kind") == "text") & ~F.col("_large"), plain), "num_pages": F.lit(None).cast("int"), "_error": F.lit(None).cast("string")})
    right = rows.filter(~simple).withColumn("_p", parse(content_col, "_kind")).withColumns({"_text": F.col("_p.text"), "num_pages": F.col("_p.num_pages"), "_error": F.col("_p.error")}).drop("_p")
    both = left.unionByName(right)
    blank = F.coalesce(C.trim_all("_text"), F.lit("")) == ""
    error = (
        F.when(F.col("_large"), F.lit("File is too large"))
        .when(F.col("_kind").isNull(), F.concat(F.lit("Unsupported file type: ."), F.coalesce(F.nullif(C.extension(name_col), F.lit("")), F.col(type_col))))
        .when(F.col("_error").isNotNull(), F.col("_error"))
        .when(blank, F.concat(F.lit("No text extracted from "), F.col(name_col), F.lit(". Scanned PDFs and image-only documents are not supported yet.")))
    )
    return both.withColumn("error", error).withColumn("text", F.when(F.col("error").isNull(), F.col("_text"))).drop("_kind", "_large", "_text", "_error", content_col)
