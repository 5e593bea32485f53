"""Prices as of a time, against a plain loop."""

import random
from datetime import datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from sedge.operators import costs

T0 = datetime(2024, 1, 1)


@pytest.mark.parametrize("span", [1, 3600, 86400 * 30, 10**9])
def test_as_of_is_the_latest_before(spark, span):
    rng = random.Random(span)
    at = lambda: T0 + timedelta(minutes=rng.randrange(240))
    prices = [(rng.choice("abc"), at(), rng.randrange(9)) for _ in range(40)] + [("a", None, 1), (None, T0, 1), ("d", T0 + timedelta(days=400), 1), ("a", T0 - timedelta(days=500), 7)]
    rows = [(i, rng.choice(["a", "b", "c", "d", "e", None]), rng.choice([at(), at(), None]), "x") for i in range(300)] + [(1, "a", T0, "x")]
    want = []
    for i, k, t, x in rows:
        own = [(f, p) for m, f, p in prices if m == k and f is not None and k is not None and t is not None and f <= t]
        want.append((i, k, t, x, *(max(own) if own else (None, None))))
    schema = "valid_from timestamp_ntz"
    got = costs.as_of(spark.createDataFrame(rows, "id int, model string, at timestamp_ntz, extra string"), spark.createDataFrame(prices, f"model string, {schema}, price int"), "model", "at", "valid_from", span if span > 1 else 60)
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)


def test_costs(spark):
    prices = spark.createDataFrame([("m", T0, Decimal("0.15"), Decimal("0.6")), ("m", T0 + timedelta(days=1), Decimal("3"), Decimal("15.000001"))], costs.PRICES)
    usage = spark.createDataFrame([(1, "m", T0, 1000, 1), (2, "m", T0 + timedelta(days=1), 7, 3), (3, "m", T0 - timedelta(seconds=1), 7, 3), (4, "n", T0, 1, 1), (5, "m", T0, None, 10**15)], "id int, model string, at timestamp_ntz, input_tokens bigint, output_tokens bigint")
    got = {r.id: r.cost_usd for r in costs.context_costs(usage, prices).collect()}
    assert got == {1: Decimal("0.0001506"), 2: Decimal("0.000066000003"), 3: None, 4: None, 5: Decimal("600000000")}
    assert costs.context_costs(usage.limit(0), prices).collect() == [] and costs.context_costs(usage, prices.limit(0)).filter("cost_usd is null").count() == 5


def test_dollars(spark):
    amounts = ["0", "1234.5", "-1234.505", "0.005", "-0.004", "999999999.999", None]
    df = spark.createDataFrame([(None if a is None else Decimal(a),) for a in amounts], "a decimal(38,12)")
    assert [r[0] for r in df.select(costs.usd(F.col("a"))).collect()] == ["$0.00", "$1,234.50", "-$1,234.51", "$0.01", "$0.00", "$1,000,000,000.00", "$0.00"]
