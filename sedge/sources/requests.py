"""JSON bodies read against a schema, with rejects apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sedge import schema


def parsed(rows: DataFrame, column: str, ddl: str, valid: Column | None = None) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): accepted has ``request``, a struct of ``ddl``."""
    read = rows.withColumn("request", F.from_json(column, ddl, {"mode": "PERMISSIVE"}))
    good = F.col("request").isNotNull() if valid is None else F.col("request").isNotNull() & F.coalesce(valid, F.lit(False))
    return read.filter(good), read.filter(~good).drop("request")


def upload_requests(rows: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    r = F.col("request")
    return parsed(rows, column, schema.UPLOAD_REQUEST, (F.length(r["fileName"]) > 0) & (r["fileSize"] > 0) & (F.length(r["fileType"]) > 0))


def checkout_requests(rows: DataFrame, column: str = "body") -> tuple[DataFrame, DataFrame]:
    """The currency is INR unless said; only paid plans can be bought."""
    r = F.col("request")
    good, bad = parsed(rows, column, schema.CHECKOUT_REQUEST, r["planCode"].isin("pro", "team") & r["gateway"].isNotNull())
    return good.withColumn("request", r.withField("currency", F.coalesce(r["currency"], F.lit(schema.CURRENCY)))), bad


def token_matches(rows: DataFrame) -> DataFrame:
    """``rows`` (payload, user_id, file_name, file_size, file_type) with why a token
    doesn't fit its upload; null if it does."""
    p = F.col("payload")
    reason = (
        F.when(p.isNull(), "invalid token")
        .when(~p["userId"].eqNullSafe(F.col("user_id")), "user")
        .when(~p["fileName"].eqNullSafe(F.col("file_name")), "name")
        .when(~p["fileSize"].eqNullSafe(F.col("file_size").cast("bigint")), "size")
        .when(~p["fileType"].eqNullSafe(F.col("file_type")), "type")
    )
    return rows.withColumn("reject", reason)
