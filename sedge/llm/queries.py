"""The queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sedge.llm import centroids, embedding_dedup, exact_dedup, importance, jaccard_join, language_id, line_dedup, mixing, packing, pii, quotation, substring_dedup, toxicity
from sedge.llm.shared import ship
from sedge.llm.sql import ORACLES


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_nnls_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from public_tokenizers import path

    return packing.pack_documents(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quotation.reply_order(table(spark, sf_dir, "conversations"))


def op3_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.join(table(spark, sf_dir, "documents"), n=4, percent=85)


def op4_hierarchical_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(table(spark, sf_dir, "documents"))


def op5_extendible_hash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


def op6_feistel_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = pii.pseudonymise(table(spark, sf_dir, "documents"), key="a key of the owner's")
    return made.select("doc_id", "text", "n_values", F.array_join("kinds", ",").alias("kinds"))


def op7_fixed_block_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.remove_repeats(table(spark, sf_dir, "documents"), window=35)


def op8_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op9_pivot_permutation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"), cosine=0.9)


def op10_line_neighbourhood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.repeated_lines(table(spark, sf_dir, "documents"))


def op11_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_csr_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_exact_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def _shipped(query: Callable) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        ship(spark)
        return query(spark, sf_dir)

    return run


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = [
        op1_nnls_packing,
        op2_quotation_linking,
        op3_parity_sketch_join,
        op4_hierarchical_language_id,
        op5_extendible_hash_dedup,
        op6_feistel_pseudonyms,
        op7_fixed_block_anchors,
        op8_subset_sum_mixing,
        op9_pivot_permutation,
        op10_line_neighbourhood,
        op11_recurrent_toxicity,
        op12_csr_importance,
        op13_exact_centroids,
        pipeline,
    ]
    return {f.__name__: _shipped(f) for f in every}


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
