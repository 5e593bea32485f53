"""What a context has cost, by prices that change with time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Columns of a price list: US dollars for a million tokens, from a moment on.
PRICES = "model string, valid_from timestamp_ntz, input_usd decimal(18,6), output_usd decimal(18,6)"


def as_of(rows: DataFrame, dated: DataFrame, key: str, at: str, valid_from: str, bucket_seconds: int = 86400 * 30) -> DataFrame:
    """``rows`` with the columns of the row of ``dated`` that is valid at their time: the latest
    of their key that isn't later. Null where there is none, and for null keys and times.

    Each row of ``dated`` holds until the next of its key, and is dealt into the spans of
    ``bucket_seconds`` that it touches between the first and the last of ``rows``; rows meet
    it on key and span. So a key with a third of all rows lies in as many parts as there are
    spans, ``rows`` are in no window, and a small ``dated`` is broadcast. Of rows of
    ``dated`` with equal key and time the greatest counts, column by column.
    """
    more = [c for c in dated.columns if c not in (key, valid_from)]
    seconds = lambda c: F.unix_seconds(F.col(c).cast("timestamp"))
    low, high = rows.agg(F.min(seconds(at)), F.max(seconds(at))).first()
    span = lambda s: F.floor(s / bucket_seconds)
    one = dated.filter(F.col(key).isNotNull() & F.col(valid_from).isNotNull()).groupBy(key, valid_from).agg(F.max(F.struct(*more)).alias("_own"))
    until = F.lead(valid_from).over(Window.partitionBy(key).orderBy(valid_from))
    held = one.withColumn("_until", until).withColumns({"_first": F.greatest(span(seconds(valid_from)), F.floor(F.lit(low) / bucket_seconds)), "_last": F.least(F.coalesce(span(seconds("_until")), F.floor(F.lit(high) / bucket_seconds)), F.floor(F.lit(high) / bucket_seconds))})
    parts = held.filter("_first <= _last").select(F.col(key).alias("_key"), F.col(valid_from).alias("_from"), "_until", "_own", F.explode(F.sequence("_first", "_last")).alias("_span"))
    known = (F.col(key) == F.col("_key")) & (span(seconds(at)) == F.col("_span")) & (F.col(at) >= F.col("_from")) & (F.col("_until").isNull() | (F.col(at) < F.col("_until")))
    return rows.join(parts, known, "left").select(*rows.columns, F.col("_from").alias(valid_from), *[F.col("_own")[c].alias(c) for c in more])


def context_costs(usage: DataFrame, prices: DataFrame, model: str = "model", at: str = "at") -> DataFrame:
    """``usage`` (model, at, input_tokens, output_tokens) with cost_usd, exact to a trillionth.

    Tokens that are null count as none; cost is null where no price was valid.
    """
    priced = as_of(usage.drop("valid_from", "input_usd", "output_usd"), prices.select(F.col("model").alias(model), "valid_from", "input_usd", "output_usd"), model, at, "valid_from")
    each = lambda price: (F.col(price).cast("decimal(18,6)") * F.lit("0.000001").cast("decimal(6,6)")).cast("decimal(18,12)")
    part = lambda n, price: F.coalesce(F.col(n), F.lit(0)).cast("decimal(18,0)") * each(price)
    cost = (part("input_tokens", "input_usd") + part("output_tokens", "output_usd")).cast("decimal(38,12)")
    return priced.withColumn("cost_usd", cost).drop("valid_from", "input_usd", "output_usd")


def usd(amount: Column) -> Column:
    """Dollars and cents as text, halves away from zero: -$1,234.50; null as $0.00."""
    cents = F.round(F.coalesce(amount, F.lit(0)).cast("decimal(38,12)"), 2)
    return F.concat(F.when(cents < 0, "-").otherwise(""), F.lit("$"), F.format_number(F.abs(cents), 2))
