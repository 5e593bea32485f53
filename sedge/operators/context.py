"""Citation contexts for answers, and their inverse."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sedge.functions import columns as C


def build_context(queries: DataFrame, hits: DataFrame) -> DataFrame:
    """query_id, context, hits: the citations of each query in rank order, or the
    sentence that says nothing was found.

    ``hits``: query_id, rank, content, metadata, file (id, name, type), similarity;
    at most k for each query.
    """
    cited = hits.select("query_id", F.struct("rank", C.citation("rank", F.col("file.name"), F.col("file.id"), C.location("metadata"), "content").alias("text"), "similarity").alias("hit"))
    ordered = cited.groupBy("query_id").agg(F.sort_array(F.collect_list("hit")).alias("hits"))
    joined = queries.select("query_id").join(ordered, "query_id", "left")
    text = F.array_join(F.transform("hits", lambda h: h["text"]), C.SEPARATOR)
    return joined.select("query_id", F.coalesce(text, F.lit(C.NOTHING_FOUND)).alias("context"), F.coalesce(F.size("hits"), F.lit(0)).alias("n_hits"))


def parse_context(contexts: DataFrame, column: str = "context") -> DataFrame:
    """One row for each citation of a context: position, source, content."""
    each = contexts.select("*", F.posexplode(F.filter(F.split(column, C.SEPARATOR), lambda x: (x != "") & (x != C.NOTHING_FOUND))).alias("position", "_text"))
    lines = F.split("_text", "\n")
    rest = F.array_join(F.slice(lines, 2, 1_000_000), "\n")
    at = F.position(F.lit("Content: "), rest)
    content = F.when(at > 0, F.concat(F.substring(rest, F.lit(1), at - 1), F.substring(rest, at + 9, F.length(rest)))).otherwise(rest)
    return each.withColumn("source", F.element_at(lines, 1)).withColumn("content", content).drop("_text", column)
