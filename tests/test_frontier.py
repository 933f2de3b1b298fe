from datetime import datetime

import pytest
from conftest import column

from webspark.operators import frontier as fr
from webspark.schemas import FRONTIER
from webspark.sources.frontier_store import FrontierStore
from webspark.sources.shared import fresh_path

T0 = datetime(2024, 1, 1)


def _urls(spark, *urls):
    return spark.createDataFrame([(u,) for u in urls], "url string")


def _frontier(spark, **changes):
    df = fr.new_sites(_urls(spark, "http://a.com/1", "http://b.co.uk/2"), at=T0)
    for name, value in changes.items():
        df = df.withColumn(name, value)
    return df


def _by_url(df):
    return {r.url: r for r in df.collect()}


def _record(url, success, message, seq):
    return ((url,), success, message, seq)


RECORDS = "Data struct<Url:string>, Success boolean, Message string, seq bigint"


def test_new_sites(spark):
    rows = _by_url(_frontier(spark))
    assert rows["http://b.co.uk/2"].tld == "b.co.uk"
    assert rows["http://a.com/1"].visited is False and rows["http://a.com/1"].queued_at is None
    assert fr.new_sites(_urls(spark, "http://a b/")).first().tld is None


def test_import_links(spark):
    known = _frontier(spark)
    batch = _urls(spark, "http://c.com", "http://a.com/1", "http://c.com")
    grown, new = fr.import_links(known, batch, at=T0)
    assert column(new, "url") == ["http://c.com"]
    assert grown.count() == 3 and fr.duplicate_urls(grown).count() == 0
    assert grown.schema.simpleString() == FRONTIER.simpleString()
    again, none = fr.import_links(grown, batch, at=T0)
    assert none.count() == 0 and again.count() == 3


def test_import_pages(spark):
    from pyspark.sql import functions as F

    known = _frontier(
        spark, message=F.lit("failed: x"), queued_at=F.lit(T0).cast("timestamp")
    )
    records = spark.createDataFrame(
        [
            _record("http://a.com/1", True, "", 1),
            _record("http://new.com", False, "failed: first", 2),
            _record("http://new.com", True, "", 3),
        ],
        RECORDS,
    )
    rows = _by_url(fr.import_pages(known, records, at=T0))
    a, b, new = rows["http://a.com/1"], rows["http://b.co.uk/2"], rows["http://new.com"]
    assert (a.visited, a.success, a.queued_at, a.message) == (True, True, None, "failed: x")
    assert (b.visited, b.success, b.queued_at, b.message) == (False, False, T0, "failed: x")
    assert (new.visited, new.success, new.message, new.tld) == (True, True, "failed: first", "new.com")
    touched = fr.import_pages(known, records, at=T0, touched_only=True)
    assert _by_url(touched) == {u: rows[u] for u in ("http://a.com/1", "http://new.com")}


def test_import_resolutions(spark):
    from pyspark.sql import functions as F

    known = _frontier(spark, message=F.lit("failed: x"))
    res = spark.createDataFrame(
        [
            ("http://a.com/1", "1.1.1.1", "c", "old", 1),
            ("http://a.com/1", "2.2.2.2", "", "", 2),
            ("http://zz.com", "3.3.3.3", "", "", 3),
        ],
        "Url string, IP string, Cname string, Message string, seq int",
    )
    out, unmatched = fr.import_resolutions(known, res, at=T0)
    rows = _by_url(out)
    assert (rows["http://a.com/1"].ip, rows["http://a.com/1"].message) == ("2.2.2.2", "")
    assert (rows["http://b.co.uk/2"].ip, rows["http://b.co.uk/2"].message) == (None, "failed: x")
    assert column(unmatched, "Url") == ["http://zz.com"]


def test_mark_queued(spark):
    known = _frontier(spark)
    ids = {r.url: r.id for r in known.collect()}
    lines = [
        f"{ids['http://a.com/1']}\thttp://a.com/1\t1.1.1.1",
        "5\thttp://zz.com\t",
        "x\thttp://yy.com\t2.2.2.2\textra",
        "short\tline",
    ]
    out, requests, short = fr.mark_queued(
        known, spark.createDataFrame([(x,) for x in lines], "value string"), T0
    )
    assert {u: r.queued_at for u, r in _by_url(out).items()} == {
        "http://a.com/1": T0,
        "http://b.co.uk/2": None,
    }
    assert column(requests, "value") == [
        "http://a.com/1\t1.1.1.1",
        "http://zz.com\t",
        "http://yy.com\t2.2.2.2",
    ]
    assert column(short, "line") == ["short\tline"]


def test_next_urls(spark):
    from pyspark.sql import functions as F

    df = _frontier(spark, visited=F.col("url") == "http://a.com/1")
    assert column(fr.next_urls(df), "url") == ["http://b.co.uk/2"]
    queued = df.withColumn("queued_at", F.lit(T0).cast("timestamp"))
    assert fr.next_urls(queued).count() == 1
    assert fr.next_urls(queued, exclude_queued=True).count() == 0
    many = fr.new_sites(spark.range(500).selectExpr("concat('http://x.com/', id) AS url"))
    first = column(fr.next_urls(many, 20, "s"), "url")
    assert first == column(fr.next_urls(many.repartition(9), 20, "s"), "url")
    assert first != column(fr.next_urls(many, 20, "t"), "url") and len(set(first)) == 20


def test_store(spark):
    store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4)
    assert store.load().count() == 0
    store.commit(_frontier(spark))
    assert store.compact() == 1
    fresh, _ = fr.import_links(store.load(), _urls(spark, "http://c.com"), at=T0, touched_only=True)
    assert store.commit(fresh, "links-0") == 2
    assert store.commit(fresh, "links-0") == 2
    records = spark.createDataFrame([_record("http://a.com/1", True, "", 1)], RECORDS)
    store.commit(fr.import_pages(store.load(), records, at=T0, touched_only=True))
    before = _by_url(store.load())
    assert {u: r.visited for u, r in before.items()} == {
        "http://a.com/1": True,
        "http://b.co.uk/2": False,
        "http://c.com": False,
    }
    assert store.compact() == 3 and store.compact() == 3
    other = FrontierStore(spark, store.path, buckets=4)
    assert _by_url(other.load()) == before
    assert other.load().schema.simpleString() == FRONTIER.simpleString()


def test_store_in_another_session(spark):
    store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4)
    store.commit(_frontier(spark))
    store.compact()
    for table in spark.catalog.listTables():
        if table.name.startswith("webspark_"):
            spark.sql(f"DROP TABLE {table.name}")
    assert store.load().count() == 2


def test_store_hides_deleted_and_refuses_repeats(spark):
    from pyspark.sql import functions as F

    store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4)
    store.commit(_frontier(spark))
    gone = _frontier(spark, deleted_at=F.lit(T0).cast("timestamp")).filter("url LIKE '%a.com%'")
    store.commit(gone)
    assert column(store.load(), "url") == ["http://b.co.uk/2"]
    with pytest.raises(ValueError):
        store.commit(_frontier(spark).unionByName(_frontier(spark)))


def test_failed_commit_leaves_nothing(spark):
    store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4)
    twice = _frontier(spark).unionByName(_frontier(spark))
    nameless = fr.new_sites(spark.createDataFrame([(None,)], "url string"))
    for rows in (twice, nameless, twice):
        with pytest.raises(ValueError):
            store.commit(rows, "batch-0")
        assert store.version() == 0 and store.load().count() == 0
    assert store.commit(_frontier(spark), "batch-0") == 1 and store.load().count() == 2


def test_records_without_url_are_left_out(spark):
    store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4)
    store.commit(_frontier(spark))
    rows = [_record(None, True, "", 1), _record("http://n.com", True, "", 2)]
    for _ in range(3):
        batch = spark.createDataFrame(rows, RECORDS)
        store.commit(fr.import_pages(store.load(), batch, at=T0, touched_only=True))
        store.compact()
    assert sorted(column(store.load(), "url")) == ["http://a.com/1", "http://b.co.uk/2", "http://n.com"]


def test_compaction_keeps_one_old_generation(spark):
    store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4)
    for k in range(4):
        store.commit(fr.new_sites(_urls(spark, f"http://x{k}.com")), f"b-{k}")
        store.compact()
    kinds = [(e["kind"], e["version"]) for e in store._entries()]
    assert kinds == [("base", 3), ("base", 4), ("changes", 4)]
    assert store.load().count() == 4 and store.committed("b-3") and store.committed("b-0")


def test_racing_writers_lose_nothing(spark):
    from concurrent.futures import ThreadPoolExecutor

    from pyspark.sql import functions as F

    path = fresh_path(spark, "frontier")
    FrontierStore(spark, path, buckets=4).commit(fr.new_sites(_urls(spark, "http://shared.com"), at=T0))

    def write(k):
        """New URLs of its own, one that all would add, and a mark on the one that all know."""

        def operation(frontier):
            fresh, _ = fr.import_links(frontier, _urls(spark, f"http://w{k}.com", "http://all.com"), at=T0, touched_only=True)
            known = frontier.filter("url = 'http://shared.com'")
            return fresh.unionByName(known.withColumn("message", F.concat("message", F.lit(f"<{k}>"))))

        return FrontierStore(spark, path, buckets=4, compact_every=5).update(operation, f"writer-{k}")

    with ThreadPoolExecutor(4) as pool:
        versions = list(pool.map(write, range(4)))
    store = FrontierStore(spark, path, buckets=4)
    rows = _by_url(store.load())
    assert sorted(versions) == [2, 3, 4, 5]
    assert set(rows) == {"http://shared.com", "http://all.com", *(f"http://w{k}.com" for k in range(4))}
    assert sorted(rows["http://shared.com"].message) == sorted("<0><1><2><3>")
    assert all(store.committed(f"writer-{k}") for k in range(4))


def test_conflicts_are_refused(spark):
    from webspark.sources.frontier_store import Conflict

    store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4)
    store.commit(_frontier(spark))
    store.commit(fr.new_sites(_urls(spark, "http://c.com"), at=T0))
    assert store.commit(fr.new_sites(_urls(spark, "http://d.com"), at=T0), read_version=1) == 3
    with pytest.raises(Conflict):
        store.commit(fr.new_sites(_urls(spark, "http://d.com"), at=T0), read_version=2)
    assert store.version() == 3 and store.load(1).count() == 2 and store.load(2).count() == 3


def test_manifest_entries_are_put_once(spark):
    from concurrent.futures import ThreadPoolExecutor

    from webspark.sources.manifest import ManifestLog

    log = ManifestLog(spark, fresh_path(spark, "manifest"))
    with ThreadPoolExecutor(8) as pool:
        won = list(pool.map(lambda k: log.put("changes-1", {"k": k}), range(32)))
    assert won.count(True) == 1 and log.entries() == {"changes-1": {"k": won.index(True)}}
    # The way of other file systems, on this one.
    assert log._put_by_rename("changes-2", '{"k": 5}', "draft-a")
    assert not log._put_by_rename("changes-2", '{"k": 6}', "draft-b")
    assert log.entries()["changes-2"] == {"k": 5}
    log.local = None
    assert log.entries() == {"changes-1": {"k": won.index(True)}, "changes-2": {"k": 5}}
    log.remove("changes-1")
    assert set(log.entries()) == {"changes-2"}


def test_commits_compact_by_themselves(spark):
    store = FrontierStore(spark, fresh_path(spark, "frontier"), buckets=4, compact_every=3)
    for k in range(7):
        store.commit(fr.new_sites(_urls(spark, f"http://x{k}.com"), at=T0), f"b-{k}")
    assert len(store._state()[1]) == 1 and store.load().count() == 7
    assert store.load()._jdf.queryExecution().analyzed().toString().count("Relation") == 2
