"""Each query against its SQL on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from sievespark.plans.queries import QUERIES

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    got = sorted((tuple(r) for r in df.collect()), key=repr)
    if name not in entry.oracle_sql():
        return
    want = duck.sql(entry.oracle_sql()[name])
    assert sorted(want.columns) == sorted(df.columns)
    assert got == sorted((tuple(r[want.columns.index(c)] for c in df.columns) for r in want.fetchall()), key=repr)


def test_entry(spark):
    assert entry.entry(spark).count() > 0
