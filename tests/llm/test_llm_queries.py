"""Every query of the package against its SQL check, and the pipeline's shape."""

import pytest

import __spark_entry__ as entry
from webspark.llm.checks import CHECKS
from webspark.llm.queries import QUERIES


@pytest.mark.parametrize("name", sorted(CHECKS))
def test_query_equals_its_check(spark, con, sf_dir, name):
    df = QUERIES[name](spark, sf_dir)
    cols = sorted(df.columns)
    rel = con.sql(CHECKS[name])
    assert sorted(rel.columns) == cols
    at = [rel.columns.index(c) for c in cols]
    got = sorted(repr(tuple(r[c] for c in cols)) for r in df.collect())
    want = sorted(repr(tuple(r[i] for i in at)) for r in rel.fetchall())
    assert got == want


def test_all_are_registered():
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())
    assert [sum(n.startswith(f"op{k}_") for n in QUERIES) for k in range(1, 14)] == [1] * 13
