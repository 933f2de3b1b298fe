from conftest import column

from webspark.operators import frontier as fr
from webspark.operators import links
from webspark.plans import inputs
from webspark.sources.frontier_store import FrontierStore
from webspark.sources.shared import fresh_path
from webspark.streaming import streams


def _run(writer):
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()


def _source(pages, folder, parts=3):
    pages.repartition(parts).write.parquet(folder)
    return pages.sparkSession.readStream.schema(inputs.PAGES_SCHEMA).option(
        "maxFilesPerTrigger", 1
    ).parquet(folder)


def test_stream_of_links_goes_on_after_a_restart(spark, pages):
    base = fresh_path(spark, "restart")
    half = pages.filter("page_id % 2 = 0")
    stream = _source(half, f"{base}/in")

    def run():
        _run(
            streams.stream_extract(stream)
            .writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/cp")
        )
        return sorted(map(tuple, spark.read.parquet(f"{base}/out").collect()))

    assert run() == sorted(map(tuple, links.extract_links(half).collect()))
    pages.filter("page_id % 2 = 1").write.mode("append").parquet(f"{base}/in")
    assert run() == sorted(map(tuple, links.extract_links(pages).collect()))


def test_frontier_stream_equals_batch_and_replays_do_nothing(spark, pages):
    base = fresh_path(spark, "frontier-stream")
    store = FrontierStore(spark, f"{base}/frontier", buckets=4)
    found = streams.stream_extract(_source(pages, f"{base}/in"))
    new = []

    def emit(rows, outputs, batch_id):
        assert outputs == {}
        new.extend(column(rows, "url"))

    def run(checkpoint):
        _run(
            streams.run_frontier(
                found, streams.links_op("link"), store, checkpoint, "links", 2, emit
            )
        )

    run(f"{base}/cp")
    version = store.version()
    batch, _ = fr.import_links(
        spark.createDataFrame([], store.load().schema), links.extract_links(pages), "link"
    )
    assert sorted(column(store.load(), "url")) == sorted(column(batch, "url"))
    assert sorted(new) == sorted(column(batch, "url"))
    # A lost checkpoint makes the stream start over with the same batches: all are known.
    run(f"{base}/cp2")
    assert store.version() == version
    assert fr.duplicate_urls(store.load()).count() == 0


def test_page_and_queue_streams(spark, pages):
    base = fresh_path(spark, "pages-stream")
    store = FrontierStore(spark, f"{base}/frontier", buckets=4)
    urls = pages.select("url").distinct()
    store.commit(fr.new_sites(urls))
    lines = store.load().selectExpr("concat_ws('\t', id, url, '') AS value")
    lines.write.text(f"{base}/queue")
    _run(
        streams.run_frontier(
            spark.readStream.text(f"{base}/queue"),
            streams.queue_op(inputs_time()),
            store,
            f"{base}/cp1",
            "queue",
        )
    )
    assert store.load().filter("queued_at IS NULL").count() == 0
    records = pages.selectExpr(
        "named_struct('Url', url) AS Data", "page_id % 2 = 0 AS Success", "'failed: x' AS Message",
        "page_id AS seq",
    )
    records.write.parquet(f"{base}/records")
    stream = spark.readStream.schema(records.schema).parquet(f"{base}/records")
    _run(streams.run_frontier(stream, streams.pages_op(), store, f"{base}/cp2", "pages"))
    done = store.load()
    assert done.filter("visited AND queued_at IS NULL").count() == urls.count()
    assert done.filter("NOT success AND message = 'failed: x'").count() > 0
    found = pages.selectExpr(
        "page_id AS seq", "url AS Url", "'1.2.3.4' AS IP", "'c' AS Cname", "'' AS Message"
    )
    found.write.parquet(f"{base}/ips")
    stream = spark.readStream.schema(found.schema).parquet(f"{base}/ips")
    _run(streams.run_frontier(stream, streams.resolutions_op(), store, f"{base}/cp3", "ips"))
    assert store.load().filter("ip = '1.2.3.4' AND cname = 'c'").count() == urls.count()


def inputs_time():
    from datetime import datetime

    return datetime(2024, 2, 1)


def test_dedup_across_batches(spark, pages):
    base = fresh_path(spark, "dedup")
    stream = _source(pages, f"{base}/in").selectExpr(
        "url", "html", "_metadata.file_modification_time AS seen_at"
    )
    found = links.extract_links(stream, keep=["seen_at"])
    _run(
        streams.stream_dedup(found, "seen_at")
        .writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/cp")
    )
    got = column(spark.read.parquet(f"{base}/out"), "link")
    assert sorted(got) == sorted({r.link for r in links.extract_links(pages).collect()})


def test_stats_interval(spark, pages):
    base = fresh_path(spark, "stats")
    stream = _source(pages, f"{base}/in").selectExpr(*inputs.REQUEST_COLUMNS)
    told = {}

    def keep(batch, batch_id):
        told.update({(r.since, r.address): r.pending for r in batch.collect()})

    writer = streams.start_stats(stream, "asked_at", late="36500 days").foreachBatch(keep)
    query = writer.option("checkpointLocation", f"{base}/cp").start()
    query.processAllAvailable()
    query.stop()
    assert sum(told.values()) == pages.count()


def test_replayed_batches_hand_out_the_same_outputs(spark, pages):
    base = fresh_path(spark, "replay")
    store = FrontierStore(spark, f"{base}/frontier", buckets=4)
    store.commit(fr.new_sites(pages.filter("page_id % 2 = 0").select("url").distinct()))
    found = pages.selectExpr(
        "page_id AS seq", "url AS Url", "'1.2.3.4' AS IP", "'c' AS Cname", "'' AS Message"
    )
    found.repartition(3).write.parquet(f"{base}/ips")
    stream = spark.readStream.schema(found.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/ips")
    told = []

    def emit(rows, outputs, batch_id):
        told.append((batch_id, sorted(column(rows, "url")), sorted(column(outputs["unmatched"], "Url"))))

    for checkpoint in ("cp1", "cp2"):  # the second one starts over with the same batches
        _run(streams.run_frontier(stream, streams.resolutions_op(), store, f"{base}/{checkpoint}", "ips", emit=emit))
    assert len(told) == 6 and told[:3] == told[3:]
    assert sum(len(t[1]) for t in told[:3]) > 0 and sum(len(t[2]) for t in told[:3]) > 0


def test_addresses_across_batches(spark):
    """Time-ordered files, one a batch: every request once, with the answer that a table gives."""
    from pyspark.sql import functions as F

    from webspark.operators.resolution import attach_address

    base = fresh_path(spark, "address")
    minutes = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id)"
    asked = spark.range(240).selectExpr(
        "id", "if(id % 3 = 0, 'http://hot.com/', concat('http://h', id % 4, '.com/')) AS url", f"{minutes} AS at"
    )
    observed = spark.range(0, 240, 7).selectExpr(
        "if(id % 2 = 0, 'hot.com', concat('h', id % 4, '.com')) AS host",
        "if(id % 5 = 0, cast(array() AS array<string>), array(concat('10.0.0.', id))) AS ips",
        "'' AS cname", f"{minutes} AS observed_at", "if(id % 11 = 0, 'x', cast(null AS string)) AS error",
    )
    for k in range(4):
        low, high = k * 60, (k + 1) * 60
        part = f"BETWEEN timestamp'2024-01-01 {k:02}:00:00' AND timestamp'2024-01-01 {k:02}:59:59'"
        asked.filter(f"id >= {low} AND id < {high}").coalesce(1).write.mode("append").parquet(f"{base}/asked")
        observed.filter(f"observed_at {part}").coalesce(1).write.mode("append").parquet(f"{base}/seen")

    def stream(name, rows):
        return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(f"{base}/{name}")

    joined = streams.stream_address(stream("asked", asked), stream("seen", observed), "at", late="2 minutes")
    _run(
        joined.writeStream.format("parquet")
        .option("path", f"{base}/out")
        .option("checkpointLocation", f"{base}/cp")
    )
    got = {r.id: r.ip for r in spark.read.parquet(f"{base}/out").collect()}
    want = {r.id: r.ip for r in attach_address(asked, observed, as_of="at").collect()}
    # What the watermark has passed is out, once each; the rest waits for later rows.
    assert len(got) >= 230 and spark.read.parquet(f"{base}/out").count() == len(got)
    assert got == {i: want[i] for i in got}


def test_addresses_after_a_restart_in_another_time_zone(spark):
    """State of lists and timers is taken up again; requests keep their columns, whatever their types."""
    from pyspark.sql import functions as F

    from webspark.operators.resolution import attach_address

    base = fresh_path(spark, "address-restart")
    spark.conf.set("spark.sql.session.timeZone", "America/New_York")
    try:
        asked = spark.range(120).selectExpr(
            "id", "'http://hot.com/' AS url", "array(id, NULL) AS parts", "named_struct('a', id, 'b', 'x') AS pair",
            "if(id % 50 = 49, NULL, timestamp'2024-11-03 00:00:00' + make_dt_interval(0, 0, 2 * id)) AS at",
        )
        observed = spark.range(0, 120, 9).selectExpr(
            "'hot.com' AS host", "array(concat('10.0.0.', id)) AS ips", "if(id % 2 = 0, 'c', NULL) AS cname",
            "timestamp'2024-11-03 00:00:00' + make_dt_interval(0, 0, 2 * id) AS observed_at",
            "cast(null AS string) AS error",
        )

        def stream(name, rows):
            return spark.readStream.schema(rows.schema).parquet(f"{base}/{name}")

        def wave(low, high):
            asked.filter(f"id >= {low} AND id < {high}").write.mode("append").parquet(f"{base}/asked")
            near = f"observed_at >= timestamp'2024-11-03' + make_dt_interval(0, 0, {2 * low})"
            till = f"observed_at < timestamp'2024-11-03' + make_dt_interval(0, 0, {2 * high})"
            observed.filter(f"{near} AND {till}").write.mode("append").parquet(f"{base}/seen")
            joined = streams.stream_address(stream("asked", asked), stream("seen", observed), "at", late="1 minute")
            writer = joined.writeStream.format("parquet").option("path", f"{base}/out")
            _run(writer.option("checkpointLocation", f"{base}/cp"))

        wave(0, 50)
        wave(50, 100)
        wave(100, 120)
        rows = spark.read.parquet(f"{base}/out").orderBy("id").collect()
        got = {r.id: (r.ip, r.observed_at) for r in rows}
        as_of = attach_address(asked, observed, as_of="at").select("id", "ip", "at").collect()
        want = {r.id: r.ip for r in as_of}
        assert len(rows) == len(got) >= 100 and {49, 99} <= got.keys()
        assert {i: g[0] for i, g in got.items()} == {i: want[i] for i in got}
        times = {r.ips[0]: r.observed_at for r in observed.collect()}
        assert all(at == (times[ip] if ip else None) for ip, at in got.values())
        assert sum(ip is not None for ip, _ in got.values()) > 20
        kept = spark.read.parquet(f"{base}/out").drop("ip", "cname", "observed_at")
        known = F.col("id").isin(sorted(got))
        assert kept.exceptAll(asked.filter(known)).count() == 0 == asked.filter(known).exceptAll(kept).count()
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


def test_state_of_addresses_is_by_periods(spark):
    """An observation goes to two periods at most, and a batch sets one timer for a host's period."""
    from webspark.operators.resolution import attach_address

    base = fresh_path(spark, "address-periods")
    minutes = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, 7 * id{})"
    asked = spark.range(60).selectExpr("id", "concat('http://h', id, '.com/') AS url", f"{minutes.format(' + 10')} AS at")
    observed = spark.range(60).selectExpr(
        "concat('h', id, '.com') AS host", "array(concat('10.0.0.', id)) AS ips", "'' AS cname",
        f"{minutes.format('')} AS observed_at", "cast(null AS string) AS error",
    )

    def stream(name, rows):
        rows.write.parquet(f"{base}/{name}")
        return spark.readStream.schema(rows.schema).parquet(f"{base}/{name}")

    joined = streams.stream_address(stream("asked", asked), stream("seen", observed), "at", late="1 minute")
    writer = joined.writeStream.format("parquet").option("path", f"{base}/out").option("checkpointLocation", f"{base}/cp")
    query = writer.trigger(availableNow=True).start()
    query.awaitTermination()
    timers = [p["stateOperators"][0]["customMetrics"]["numRegisteredTimers"] for p in query.recentProgress]
    assert 60 <= sum(timers) <= 120
    got = {r.id: r.ip for r in spark.read.parquet(f"{base}/out").collect()}
    want = {r.id: r.ip for r in attach_address(asked, observed, as_of="at").collect()}
    assert len(got) >= 58 and got == {i: want[i] for i in got} and None not in got.values()


def test_addresses_of_a_period_go_out_slice_by_slice(spark, monkeypatch):
    """Files that overlap in time, in waves within a period: the requests that wait are kept in several lots,
    and each goes out once, as soon as its slice is passed."""
    from webspark.operators.resolution import attach_address

    monkeypatch.setattr(streams, "LOT", 3)
    base = fresh_path(spark, "address-slices")
    minutes = "timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, id)"
    asked = spark.range(100).selectExpr("id", "'http://hot.com/' AS url", f"{minutes} AS at")
    observed = spark.range(0, 100, 3).filter("id < 20 OR id > 50").selectExpr(
        "'hot.com' AS host", "array(concat('10.0.0.', id)) AS ips", "'' AS cname", f"{minutes} AS observed_at",
        "cast(null AS string) AS error",
    )

    def stream(name, rows):
        return spark.readStream.schema(rows.schema).parquet(f"{base}/{name}")

    out = []
    for wave in range(4):  # minute m comes with the wave of m or, if m is even, of ten minutes later
        own = "int((unix_seconds({0}) / 60 % 1440 + if(unix_seconds({0}) / 60 % 2 = 0, 10, 0)) / 28) = " + str(wave)
        asked.filter(own.format("at")).coalesce(1).write.mode("append").parquet(f"{base}/asked")
        observed.filter(own.format("observed_at")).coalesce(1).write.mode("append").parquet(f"{base}/seen")
        joined = streams.stream_address(stream("asked", asked), stream("seen", observed), "at", late="12 minutes")
        _run(
            joined.writeStream.format("parquet")
            .option("path", f"{base}/out")
            .option("checkpointLocation", f"{base}/cp")
        )
        out.append(spark.read.parquet(f"{base}/out").count())
    rows = spark.read.parquet(f"{base}/out").collect()
    got = {r.id: r.ip for r in rows}
    want = {r.id: r.ip for r in attach_address(asked, observed, as_of="at").collect()}
    assert out == sorted(set(out)) and out[0] >= 10 and len(rows) == len(got) >= 80
    assert got == {i: want[i] for i in got} and None in got.values()
