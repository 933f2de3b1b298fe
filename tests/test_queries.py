import glob
import os

import duckdb
import pytest

import __spark_entry__ as entry
from webspark.plans.catalog import QUERIES
from webspark.plans.checks import checks

TABLES = {}


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


def test_every_query_has_a_check():
    assert set(QUERIES) == set(checks())
    assert set(QUERIES) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_its_check(spark, con, sf_dir, name):
    df = entry.queries()[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = con.sql(entry.oracle_sql()[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    want = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert got == want


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["site", "links"] and out.count() > 0
