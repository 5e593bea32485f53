"""A corpus from raw documents to packed sequences, in five stages.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; what it returns is
written as Parquet and read again as the next stage's documents.
"""

from __future__ import annotations

from public_tokenizers import path
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import jaccard_join, language_id, line_dedup, mixing, packing
from sedge.llm.hashing import without
from sedge.llm.shared import WORD, ship, stored

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: A key of each row, from the first stage to the mixing: doc_id may be null or repeat.
KEY = "pipeline_row"
#: Neither the fitted classifier nor the near-copy join, the mix and the packing are said in SQL.
ORACLE_SQL = None


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``KEY``, as the stage before has written it or else made and stored here."""
    if KEY in docs.columns:
        return docs.select(KEY, *COLUMNS)
    return stored(docs.select(*COLUMNS).withColumn(KEY, F.monotonically_increasing_id()), "pipeline-keyed").select(KEY, *COLUMNS)


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language can be told, with the predicted language as ``lang``.

    Null texts and texts without a letter are rejected, and all if no row has a label.
    """
    ship(spark)
    learn = docs.filter(~language_id.held_out()).select(F.col("doc_id").alias("order"), "text", "lang")
    known = language_id.predict(docs.select(*COLUMNS), language_id.fit(learn))
    return known.filter(F.col("lang_pred") != language_id.UNKNOWN).withColumn("lang", F.col("lang_pred")).withColumn(KEY, F.monotonically_increasing_id()).select(KEY, *COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that stand earlier in the corpus, equal or but for a word.

    Every line that isn't blank is judged, one of a single word too. Documents stand in
    the order of doc_id, null last; rows that repeat one are documents of their own.
    A document goes if it lost lines and nothing but white space is left.
    """
    ship(spark)
    place = F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", KEY)
    rows = line_dedup.dedup_lines(keyed(docs).withColumn("_place", place), id_col="_place", every=True)
    changed = F.col("lines_gone") > 0
    return rows.filter(~changed | F.col("text").rlike(WORD)).withColumn("n_chars", F.when(changed, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(KEY, *COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near copies, by doc_id, null last.

    Of rows that repeat an id each is judged by its own text.
    """
    ship(spark)
    docs = keyed(docs)
    groups = stored(jaccard_join.join(docs, id_col=KEY), "pipeline-groups")
    members = groups.select(F.col("doc_id").alias(KEY), "component_id").join(docs.select(KEY, "doc_id"), KEY)
    first = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", KEY)).alias("first"))
    gone = stored(groups.select(F.col("doc_id").alias(KEY)).join(first.select(f"first.{KEY}"), KEY, "left_anti"), "pipeline-gone")
    return without(docs, gone, KEY)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it, also with a null or repeated doc_id."""
    ship(spark)
    docs = keyed(docs)
    copies = mixing.mix(docs, row_col=KEY).filter("copies > 0").select(KEY, "copies")
    return docs.join(copies, KEY).withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies")))).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents with their sequences and places."""
    ship(spark)
    return packing.pack_documents(docs, path("word_bpe_49k.json"), lean=True)


STAGES = [
    ("language identification", identify_languages),
    ("line dedup", drop_repeated_lines),
    ("near-copy join", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
