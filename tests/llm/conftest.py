import glob
import os

import duckdb
import pytest

SMALL = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def con(sf_dir):
    c = duckdb.connect()
    for f in glob.glob(f"{sf_dir}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    return c


@pytest.fixture(scope="session")
def documents(spark, sf_dir):
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


@pytest.fixture(scope="session")
def texts(spark):
    """Documents of ``(doc_id, text)`` rows, with a column whose name an operator might use."""

    def make(*rows):
        return spark.createDataFrame(
            [(i, t, "x", "host", 0) for i, t in rows],
            "doc_id long, text string, kept string, source string, n_words long",
        )

    return make
