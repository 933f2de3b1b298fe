"""Shapes of the physical plans that decide how the operators scale."""

import re

import pytest
from pyspark.sql import functions as F

from webspark.operators import frontier as fr
from webspark.operators import hosts, links, resolution, robots
from webspark.plans import inputs
from webspark.plans.catalog import QUERIES
from webspark.sources.frontier_store import FrontierStore
from webspark.sources.shared import fresh_path


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


BATCH = [n for n in QUERIES if not n.startswith(("stream_", "read_", "page_record_json", "frontier_store"))]


@pytest.mark.parametrize("name", BATCH)
def test_no_python_no_pairs(spark, sf_dir, name):
    text = plan(QUERIES[name](spark, sf_dir))
    for operator in ("BatchEvalPython", "ArrowEvalPython", "CartesianProduct", "BroadcastNestedLoop", "MapInPandas"):
        assert operator not in text


def test_links_need_no_shuffle(pages):
    for df in (
        links.extract_links(pages),
        links.extract_links(pages, root=True),
        links.dedup_stats(pages),
        links.pages_with_links(pages),
    ):
        assert "Exchange" not in plan(df)


def test_links_are_computed_once(pages):
    """Neither the generator nor a filter repeats the extraction."""
    text = plan(links.extract_links(pages).filter("link LIKE '%.org/%'"))
    assert len(re.findall(r"regexp_extract_all\(html", text)) == 1


def test_html_never_travels(pages):
    new = fr.import_links(
        fr.new_sites(pages.select("url")), links.extract_links(pages), "link"
    )[0]
    for line in plan(new).splitlines():
        assert not ("Exchange" in line and "html" in line)


def test_columns_and_filters_reach_the_scan(spark, sf_dir):
    text = plan(inputs.frontier(spark, sf_dir))
    assert "ReadSchema: struct<url:string>" in text
    assert re.search(r"PushedFilters: \[.*StringStartsWith\(url,https:\)", text)


def test_robots_join_is_on_the_site(spark, sf_dir):
    asked = inputs.requests(spark, sf_dir)
    rules = robots.parse_robots(inputs.robots_bodies(spark, sf_dir))
    text = plan(robots.robots_allowed(asked, rules))
    assert re.search(r"(BroadcastHashJoin|SortMergeJoin) \[ws_digest#\d+L, site", text)


def test_next_urls_takes_the_best_of_each_task(spark):
    store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4)
    store.commit(fr.new_sites(spark.range(50).selectExpr("concat('http://x.com/', id) AS url")))
    store.compact()
    text = plan(fr.next_urls(store.load()))
    assert "TakeOrderedAndProject" in text and "Exchange" not in text
    assert "Not(EqualTo(visited,true))" in text


def test_stored_frontier_joins_in_place(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4)
        store.commit(fr.new_sites(spark.range(50).selectExpr("concat('http://x.com/', id) AS url")))
        store.compact()
        batch = spark.range(9).selectExpr("concat('http://y.com/', id) AS url")
        text = plan(fr.import_links(store.load(), batch, touched_only=True)[0])
        # Only the batch is shuffled.
        assert text.count("Exchange hashpartitioning") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_changes_meet_the_base_in_place(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4)
        store.commit(fr.new_sites(spark.range(50).selectExpr("concat('http://x.com/', id) AS url")))
        store.compact()
        store.commit(fr.new_sites(spark.range(9).selectExpr("concat('http://z.com/', id) AS url")))
        batch = spark.range(9).selectExpr("concat('http://y.com/', id) AS url")
        text = plan(fr.import_links(store.load(), batch, touched_only=True)[0])
        # The changes meet the base in place; after that only URLs travel.
        assert "Bucketed: true" in text
        for line in text.splitlines():
            assert not ("Exchange hashpartitioning" in line and "visited" in line)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_site_is_split(spark):
    """A site with nearly all requests: the adaptive skew join splits its partition."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "10000",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "10000",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    try:
        urls = spark.range(0, 20000, 1, 8).selectExpr(
            "if(id % 10 = 0, concat('http://h', id % 500, '.com/'), concat('http://hot.com/', id)) AS url"
        )
        bodies = spark.range(500).selectExpr(
            "if(id = 1, 'http://hot.com', concat('http://h', id, '.com')) AS site",
            "'User-agent: *\nDisallow: /1' AS body",
        )
        dns = spark.range(500).selectExpr(
            "if(id = 1, 'hot.com', concat('h', id, '.com')) AS host",
            "array('1.1.1.1') AS ips",
            "'' AS cname",
            "timestamp'2024-01-01 00:00:00' AS observed_at",
            "cast(NULL AS string) AS error",
        )
        timed = urls.withColumn("at", F.expr("timestamp'2024-01-01 00:10:00'"))
        for df, rows in (
            (robots.robots_allowed(urls, robots.parse_robots(bodies)), 20000),
            (resolution.attach_address(urls, dns), 20000),
            (resolution.attach_address(timed, dns, as_of="at"), 20000),
        ):
            assert len(df.collect()) == rows
            assert "skew=true" in plan(df)
    finally:
        for key in settings:
            spark.conf.unset(key)


def test_windows_are_over_slices(spark, sf_dir):
    asked = inputs.requests(spark, sf_dir)
    for df in (
        hosts.politeness_plan(asked, "page_id")[0],
        resolution.attach_address(asked, inputs.dns(spark, sf_dir), as_of="asked_at"),
    ):
        text = plan(df)
        assert "Exchange SinglePartition" not in text and "ws_slice" in text
    # Runs cross all slices, so one row per slice, and no request, meets in one task.
    text = plan(hosts.run_batches(asked, "page_id")[0])
    assert text.count("Exchange SinglePartition") == 1


def test_session_setting_is_the_shared_folder(spark):
    assert fresh_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_html_stays_where_it_is_read(spark, sf_dir):
    """No exchange of a registered query carries the bodies of pages."""
    from webspark.plans.catalog import QUERIES

    for name in ("extract_links", "links_per_site", "import_links", "pages_with_links", "dedup_stats"):
        text = plan(QUERIES[name](spark, sf_dir))
        for block in text.splitlines():
            assert not ("Exchange" in block and "html" in block), name
        assert "RoundRobinPartitioning" not in text, name


@pytest.mark.parametrize("name", ["filter_domain", "filter_links_table", "registered_domain_table", "reject_reasons"])
def test_url_forms_are_worked_on_once(spark, sf_dir, name):
    """A filter or the other side of a join does not resolve or normalise a URL again."""
    plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    once = QUERIES["resolve_reference"](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 1.5 * len(once)
