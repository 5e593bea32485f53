"""Every query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
NAMES = sorted(n for n in entry.oracle_sql())


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted([tuple(float(f"{r[i]:.9g}") if isinstance(r[i], float) else r[i] for i in order) for r in data], key=repr)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(entry.oracle_sql()[name])
    got = entry.queries()[name](spark, SF)
    names = [d[0] for d in want.description]
    assert sorted(names) == sorted(got.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(names, want.fetchall())


@pytest.mark.parametrize("name", ["chunked_documents", "embedded_documents", "signed_bodies"])
def test_runs(spark, name):
    assert entry.queries()[name](spark, SF).count() >= 50


def test_entry(spark):
    assert entry.entry(spark).count() > 0
