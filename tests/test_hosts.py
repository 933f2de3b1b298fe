import random

import pytest

from webspark.operators import hosts


def test_runs_of_the_example(spark):
    ips = ["A", "A", None, "B", "B", "A"]
    df = spark.createDataFrame(list(enumerate(ips)), "n bigint, ip string")
    for width in (1, 2, 4, 1000):
        rows = sorted(hosts.run_batches(df, "n", slices=width)[0].collect())
        assert [r.batch for r in rows] == [0, 0, 1, 1, 1, 2]


@pytest.mark.parametrize("width", [1, 7, 1 << 10])
def test_against_brute_force(spark, width):
    rng = random.Random(width)
    # One address holds most rows; order values have gaps.
    order = sorted(rng.sample(range(5000), 600))
    ips = [rng.choice(["hot"] * 6 + [None, None, "x", "y"]) for _ in order]
    df = spark.createDataFrame(list(zip(order, ips)), "n bigint, ip string").repartition(5)
    runs, batch, before = {}, 0, None
    for n, ip in zip(order, ips):
        if before is not None and ip != before:
            batch += 1
        runs[n], before = batch, ip
    got = hosts.run_batches(df, "n", slices=width)[0].collect()
    assert {r.n: r.batch for r in got} == runs
    seen, positions = {}, {}
    for n, ip in zip(order, ips):
        key = ip or "<nil>"
        positions[n] = (key, seen.get(key, 0), seen.get(key, 0) * 3)
        seen[key] = seen.get(key, 0) + 1
    plan = hosts.politeness_plan(df, "n", delay=3, slices=width)[0].collect()
    assert {r.n: (r.address, r.position, r.start_after) for r in plan} == positions
    assert {r.address: r.pending for r in hosts.pending_stats(df).collect()} == seen
    groups = hosts.group_by_address(df, "n").collect()
    assert {r.address: r.requests for r in groups} == seen
    assert tuple(hosts.pending_totals(df).first()) == (len(seen), len(order))


def test_requests_without_order_are_handed_back(spark):
    df = spark.createDataFrame(
        [(None, "a"), (None, "a"), (3, "x"), (5, None), (-4, "x"), (6, "c")], "n bigint, ip string"
    )
    plan, rest = hosts.politeness_plan(df, "n", slices=2)
    assert {r.n: r.position for r in plan.collect()} == {-4: 0, 3: 1, 5: 0, 6: 0}
    assert [tuple(r) for r in rest.collect()] == [(None, "a")] * 2
    runs, rest = hosts.run_batches(df, "n", slices=2)
    assert {r.n: r.batch for r in runs.collect()} == {-4: 0, 3: 0, 5: 1, 6: 1} and rest.count() == 2


def test_slices_hold_about_equal_parts_of_any_order(spark):
    # Values 2**40 apart, below zero, and a crowd within a short span.
    df = spark.sql(
        "SELECT (id - 500) * 1099511627776 AS n, 'x' AS ip FROM range(1000) "
        "UNION ALL SELECT 7 + id, 'y' FROM range(3000)"
    )
    sizes = [r["count"] for r in hosts._sliced(df, "n", 16).groupBy("ws_slice").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 4000 / 16
    assert df.sparkSession is spark


def test_no_requests(spark):
    df = spark.createDataFrame([], "n bigint, ip string")
    assert hosts.run_batches(df, "n")[0].count() == 0
    assert hosts.politeness_plan(df, "n")[0].count() == 0
    assert tuple(hosts.pending_totals(df).first()) == (0, 0)
