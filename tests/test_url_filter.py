import pytest
from conftest import column
from pyspark.sql import functions as F

from webspark.operators import frontier as fr
from webspark.sources.frontier_store import FrontierStore
from webspark.sources.shared import fresh_path
from webspark.sources.url_filter import blocks_for, build_filter, merge_filters, probe

T0 = "2024-01-01 00:00:00"


def _urls(spark, start, end):
    return spark.range(start, end).selectExpr("concat('http://x', id % 7, '.com/', id) AS url")


def _sites(spark, start, end):
    return fr.new_sites(_urls(spark, start, end), at=T0)


def test_no_known_url_is_called_unknown_and_few_unknown_ones_known(spark):
    known, blocks = _urls(spark, 0, 40_000), blocks_for(40_000)
    table = build_filter(known, blocks)
    assert table.count() <= blocks == 16
    assert probe(known, table, blocks).filter("NOT ws_maybe").isEmpty()
    wrong = probe(_urls(spark, 100_000, 200_000), table, blocks).filter("ws_maybe").count()
    assert wrong / 100_000 < 0.015


def test_a_merged_filter_is_the_filter_of_both(spark):
    one, other = build_filter(_urls(spark, 0, 500), 4), build_filter(_urls(spark, 300, 900), 4)
    merged = {r.block: bytes(r.bits) for r in merge_filters(one, other).collect()}
    assert merged == {r.block: bytes(r.bits) for r in build_filter(_urls(spark, 0, 900), 4).collect()}


@pytest.mark.parametrize("urls", [0, 1, 2_978, 2_979, 10**6, 10**11])
def test_blocks_bound_the_bits_of_a_url(urls):
    blocks = blocks_for(urls)
    assert blocks & (blocks - 1) == 0 and blocks * (1 << 15) >= urls * 11
    assert blocks == 1 or blocks * (1 << 15) < urls * 22 + (1 << 16)


def test_unknown_equals_import_links(spark):
    store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4)
    batch = _urls(spark, 50, 400).union(_urls(spark, 60, 90)).union(spark.createDataFrame([(None,), ("",)], "url string"))

    def agree():
        expected = fr.import_links(store.load(), batch)[1]
        found = column(store.unknown(batch.withColumnRenamed("url", "block"), "block"), "url")
        assert sorted(found) == sorted(column(expected, "url")) and len(set(found)) == len(found)
        return set(found)

    assert len(agree()) == 351
    store.commit(_sites(spark, 0, 100))
    agree()
    store.compact()
    agree()
    store.commit(_sites(spark, 100, 200))
    # A known URL goes, one that is only pending goes, and one that went comes back.
    gone = _sites(spark, 80, 120).withColumn("deleted_at", F.lit(T0).cast("timestamp"))
    store.commit(gone)
    store.commit(_sites(spark, 85, 90))
    left = agree()
    assert "http://x3.com/80" in left and "http://x5.com/110" in left and "http://x1.com/85" not in left
    store.compact()
    assert agree() == left


def test_filters_are_merged_grow_and_go_with_their_base(spark):
    store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4)
    for k in range(3):
        store.commit(_sites(spark, k * 1000, k * 1000 + 1000))
        store.compact()
    store.commit(_sites(spark, 3000, 8000))
    store.compact()
    bases = [e for e in store._entries() if e["kind"] == "base"]
    assert [e["filter_blocks"] for e in bases] == [2, 4]
    all_known = build_filter(_urls(spark, 0, 8000), 4)
    assert store._filter_table(bases[-1]).exceptAll(all_known).isEmpty()
    import os

    folders = [f for f in os.listdir(f"{store.path}/data") if f.startswith("filter-")]
    assert sorted(folders) == sorted(e["filter"] for e in bases)


def _above_base(df):
    """Lines of the executed plan from the scan of the base up to the first join."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0].splitlines()
    at = next(k for k, line in enumerate(plan) if "FileScan" in line and "webspark_" in line)
    found, depth = [plan[at]], len(plan[at]) - len(plan[at].lstrip(" :+-"))
    for line in reversed(plan[:at]):
        indent = len(line) - len(line.lstrip(" :+-"))
        if indent < depth:
            found, depth = [*found, line], indent
            if "Join" in line:
                break
    return found


@pytest.mark.parametrize("threshold", ["-1", "10MB"])
def test_the_base_is_read_in_place(spark, threshold):
    store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4)
    store.commit(_sites(spark, 0, 1000))
    store.compact()
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    try:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        path = _above_base(store.unknown(_urls(spark, 10, 1010)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "Join" in path[-1] and not [line for line in path if "Exchange" in line or "ShuffleQuery" in line]
