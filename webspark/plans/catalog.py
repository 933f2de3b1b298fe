"""The registered queries: every operator on inputs derived from the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webspark.functions import urls as U
from webspark.functions.domains import url_domain
from webspark.operators import fetched, hosts, links, resolution, robots, suffixes
from webspark.operators import frontier as fr
from webspark.plans import inputs
from webspark.sources import lines, records
from webspark.sources.frontier_store import FrontierStore
from webspark.sources.shared import fresh_path
from webspark.streaming import streams

Query = Callable[[SparkSession, str], DataFrame]

AS_OF = "2024-01-01 02:00:00"
QUEUED_AT = "2024-02-01 00:00:00"
BODY_LIMIT = 333
SEED = "seed"
# Distance of two values of a request order.
SPARSE = 1 << 21
# Files, and so micro-batches, of a stream that is made from derived records.
STREAM_FILES = 3
# Files of the pages in a micro-batch.
BATCH_FILES = 4
# Number of a page whose time is some 150 years after all others.
END_OF_TIME = 40_000_000


# A page's data as a record holds it, in JSON.
PAGE_DATA_TEXT = '{"Url":"x"}'


def _text_of(time: Column) -> Column:
    return F.date_format(time, "yyyy-MM-dd HH:mm:ss")


def _text(time: str) -> Column:
    return _text_of(F.col(time)).alias(time)


# --- sources and sinks -------------------------------------------------------------------------


def read_url_list(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "url-list")
    padded = inputs.page_urls(spark, d).select(
        F.explode(
            F.array(F.concat(F.lit("  "), "url", F.lit(" \t\r")), F.lit(" \t "), F.lit(""))
        ).alias("url")
    )
    lines.write_url_list(padded, path)
    return lines.read_url_list(spark, path)


def _in_order(rows: DataFrame, order: str, name: str) -> str:
    """Path of a text of ``value`` in the order of a column, in files of a few parts."""
    path = fresh_path(rows.sparkSession, name)
    # Columns of the order are no part of a text, so the rows are laid out before the text is taken.
    rows.orderBy(order).select("value").write.text(path)
    return path


def numbered_urls(spark: SparkSession, d: str) -> DataFrame:
    """A list with an empty line after every URL: numbers count all lines."""
    listed = inputs.page_urls(spark, d).select(
        (F.col("page_id") * 2).alias("place"), F.concat("url", F.lit("\n")).alias("value")
    )
    path = _in_order(listed, "place", "numbered-urls")
    return lines.read_numbered_urls(spark, path)


def fetch_order(spark: SparkSession, d: str) -> DataFrame:
    """The politeness plan of a list as it stands in its files."""
    asked = inputs.requests(spark, d).select(
        "page_id", F.concat_ws("\t", "url", "ip").alias("value")
    )
    hints = lines.read_fetch_hints(spark, _in_order(asked, "page_id", "fetch-list"))
    return hosts.politeness_plan(hints, "seq")[0].drop("ip")


def import_pages_file(spark: SparkSession, d: str) -> DataFrame:
    """:func:`import_pages` from a file of records, in the order of its lines."""
    known = inputs.frontier(spark, d).withColumn("message", F.lit("failed: before"))
    queued = known.withColumn("queued_at", F.lit(QUEUED_AT).cast("timestamp"))
    made = inputs.numbered_records(spark, d)
    text = made.select("seq", F.to_json(F.struct("Data", "Success", "Message")).alias("value"))
    judged = records.read_numbered_page_records(spark, _in_order(text, "seq", "page-records"))
    return _shown(fr.import_pages(queued, judged.filter(F.col(records.CORRUPT).isNull()), at=inputs.START))


def import_resolutions_file(spark: SparkSession, d: str) -> DataFrame:
    """:func:`import_resolutions` from a file of records, in the order of its lines."""
    known = inputs.frontier(spark, d).withColumn("message", F.lit("failed: before"))
    made = inputs.resolutions(spark, d)
    text = made.select("seq", F.to_json(F.struct("Url", "IP", "Cname", "Message")).alias("value"))
    judged = records.read_numbered_resolutions(spark, _in_order(text, "seq", "resolutions"))
    return _shown(fr.import_resolutions(known, judged.filter(F.col(records.CORRUPT).isNull()), at=inputs.START)[0])


def parse_fetch_hints(spark: SparkSession, d: str) -> DataFrame:
    hints = inputs.requests(spark, d).select(
        "page_id",
        F.expr(
            "CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN url || '\\t10.0.0.' || (page_id % 256) "
            "WHEN 2 THEN url || '\\tbad' WHEN 3 THEN url || '\\t10.0.0.1\\tz' "
            "ELSE url || '\\t2001:db8::' || (page_id % 10) END"
        ).alias("value"),
    )
    return lines.parse_fetch_hints(hints).select("page_id", "url", "ip")


# Lines that are no records, made from the number of a page: broken text, text after a record, a record
# without what it must have, fields that no record knows.
BAD_LINES = [
    "'{{broken ' || {id}",
    "'{{\"{key}\":{ok},\"Success\":true}} trailing ' || {id}",
    "'{{\"Success\":true,\"foo\":' || {id} || '}}'",
    "'[] ' || {id}",
]


def bad_lines(key: str, ok: str) -> list[str]:
    """SQL texts of the bad lines of a page, for Spark and for the check."""
    number = "cast(page_id AS varchar(20))"
    return [t.format(key=key, ok=ok, id=number) for t in BAD_LINES]


def _with_bad_lines(good: DataFrame, pages: DataFrame, key: str, ok: str) -> DataFrame:
    bad = pages.select(F.explode(F.array(*map(F.expr, bad_lines(key, ok)))).alias("value"))
    return records.to_json_lines(good).unionByName(bad)


def read_page_records(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "page-records")
    numbers = inputs.page_urls(spark, d)
    _with_bad_lines(inputs.page_records(spark, d), numbers, "Data", PAGE_DATA_TEXT).write.text(path)
    judged = records.judged_page_records(spark.read.text(path))
    bad = F.col(records.CORRUPT).isNotNull()

    def of_record(value: Column) -> Column:
        return F.when(~bad, value)

    return judged.select(
        F.when(bad, "bad").otherwise("record").alias("kind"),
        F.coalesce(F.col(records.CORRUPT), F.col("Data.Url")).alias("text"),
        of_record(F.md5("Data.Body")).alias("body_md5"),
        of_record(F.col("Data.StatusCode")).alias("status_code"),
        of_record(_text_of(records.record_time("Data.Timestamp"))).alias("time"),
        of_record(F.col("Success")).alias("success"),
        of_record(F.col("Message")).alias("message"),
    )


def read_resolutions(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "resolutions")
    numbers = inputs.page_urls(spark, d)
    good = inputs.resolutions(spark, d).drop("seq")
    _with_bad_lines(good, numbers, "Url", '"x"').write.text(path)
    judged = records.judged_resolutions(spark.read.text(path))
    bad = F.col(records.CORRUPT).isNotNull()
    return judged.select(
        F.coalesce(F.col(records.CORRUPT), F.col("Url")).alias("text"),
        F.when(~bad, F.col("IP")).alias("ip"),
        F.when(~bad, F.col("Cname")).alias("cname"),
        F.when(~bad, F.col("Message")).alias("message"),
    )


def page_record_json(spark: SparkSession, d: str) -> DataFrame:
    path = fresh_path(spark, "page-json")
    records.write_records(inputs.page_records(spark, d), path)

    def field(name: str) -> Column:
        return F.get_json_object("value", f"$.{name}")

    return spark.read.text(path).select(
        field("Data.Url").alias("url"),
        F.md5(field("Data.Body")).alias("body_md5"),
        field("Data.StatusCode").cast("int").alias("status_code"),
        field("Success").cast("boolean").alias("success"),
        field("Message").alias("message"),
        F.contains("value", F.lit('"Links":null')).alias("null_links"),
    )


def page_records(spark: SparkSession, d: str) -> DataFrame:
    made = fetched.to_page_records(inputs.pages(spark, d), F.lit(inputs.STAMP))
    return made.select(
        F.col("Data.Url").alias("url"),
        F.md5("Data.Body").alias("body_md5"),
        F.col("Data.Timestamp").alias("time"),
        F.col("Data.Status").alias("status"),
        F.col("Data.StatusCode").alias("status_code"),
        F.col("Data.Proto").alias("proto"),
        F.col("Success").alias("success"),
        F.col("Message").alias("message"),
    )


# --- URLs --------------------------------------------------------------------------------------


def _on_forms(column: Callable[[str], Column], name: str) -> Query:
    def query(spark: SparkSession, d: str) -> DataFrame:
        return inputs.url_forms(spark, d).select("page_id", "form", column("u").alias(name))

    return query


def strip_query(spark: SparkSession, d: str) -> DataFrame:
    return links.strip_queries(inputs.url_forms(spark, d), "u").select("page_id", "form", "stripped")


def url_parts(spark: SparkSession, d: str) -> DataFrame:
    return (
        inputs.url_forms(spark, d)
        .select("page_id", "form", U.url_parts("u").alias("parts"))
        .select("page_id", "form", "parts.*")
    )


def _once(value: Column, name: str) -> Column:
    """Generator of a computed column, nulls included: a filter on it is not pushed below and computed again."""
    return F.explode(F.array(value)).alias(name)


def _held(rows: DataFrame, name: str) -> DataFrame:
    """Rows written to the shared folder, for plans that read them on both sides of a join."""
    path = fresh_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.schema(rows.schema).parquet(path)


def _resolved(spark: SparkSession, d: str) -> DataFrame:
    return inputs.url_forms(spark, d).select(
        "page_id", "form", _once(U.resolve_reference("base", "u"), "link")
    )


def resolve_reference(spark: SparkSession, d: str) -> DataFrame:
    return _resolved(spark, d)


def _filtered(keep: Callable[[str], Column]) -> Query:
    return lambda spark, d: _resolved(spark, d).filter(keep("link"))


def registered_domain_table(spark: SparkSession, d: str) -> DataFrame:
    """:func:`registered_domain` by a list file of more rules, some of them outside ASCII."""
    rules = suffixes.load_suffix_table(spark, inputs.suffix_list(spark))
    hosts_of = inputs.url_forms(spark, d).select("page_id", "form", U.url_host("u").alias("host"))
    return suffixes.attach_domain(_held(hosts_of, "hosts"), rules).drop("host")


def filter_links_table(spark: SparkSession, d: str) -> DataFrame:
    rules = suffixes.load_suffix_table(spark, inputs.suffix_list(spark))
    return suffixes.filter_links(_held(_resolved(spark, d), "resolved"), rules)


def filter_links(spark: SparkSession, d: str) -> DataFrame:
    return links.filter_links(_resolved(spark, d).filter(F.col("link").isNotNull()))


def reject_reasons(spark: SparkSession, d: str) -> DataFrame:
    return (
        _resolved(spark, d)
        .filter(F.col("link").isNotNull())
        .groupBy(F.coalesce(links.link_reject_reason("link"), F.lit("kept")).alias("reason"))
        .agg(F.count(F.lit(1)).alias("links"))
    )


# --- links -------------------------------------------------------------------------------------


def _on_pages(operator: Callable[..., DataFrame], **options: object) -> Query:
    return lambda spark, d: operator(inputs.pages(spark, d), **options)


def pages_with_links(spark: SparkSession, d: str) -> DataFrame:
    return links.pages_with_links(inputs.pages(spark, d)).select(
        "page_id", "url", F.array_join("links", " ").alias("links")
    )


def _record_links(extracted: DataFrame) -> DataFrame:
    return extracted.select(
        F.col("Data.Url").alias("url"),
        F.md5("Data.Body").alias("body_md5"),
        F.col("Success").alias("success"),
        F.array_join("Links", " ").alias("links"),
    )


def record_links(spark: SparkSession, d: str) -> DataFrame:
    """JSON lines of page records to page records with their links."""
    path = fresh_path(spark, "records-in")
    records.write_records(inputs.page_records(spark, d), path)
    return _record_links(links.extract_records(records.read_page_records(spark, path)[0]))


def stream_record_links(spark: SparkSession, d: str) -> DataFrame:
    """:func:`record_links` on a stream of files."""
    path = fresh_path(spark, "records-in")
    records.write_records(inputs.page_records(spark, d).repartition(STREAM_FILES), path)
    lines_in = spark.readStream.option("maxFilesPerTrigger", 1).text(path)
    ok, _ = records.split_records(records.judged_page_records(lines_in))
    return _run(_record_links(links.extract_records(ok)), "record-links")


def links_per_site(spark: SparkSession, d: str) -> DataFrame:
    """Flagship: pages to links to the number of different links of every linked site."""
    return (
        links.extract_links(inputs.pages(spark, d))
        .select("link")
        .distinct()
        .groupBy(U.site_root("link").alias("site"))
        .agg(F.count(F.lit(1)).alias("links"))
    )


# --- fetch results and robots ------------------------------------------------------------------


def failed_records(spark: SparkSession, d: str) -> DataFrame:
    failed = fetched.failed_records(inputs.page_urls(spark, d), "timeout")
    return failed.select(
        F.col("Data.Url").alias("url"),
        F.col("Data.Body").alias("body"),
        F.col("Data.StatusCode").alias("status_code"),
        F.col("Data.Header").isNull().alias("no_header"),
        F.col("Success").alias("success"),
        F.col("Message").alias("message"),
    )


def limit_body(spark: SparkSession, d: str) -> DataFrame:
    return fetched.limit_body(inputs.pages(spark, d), BODY_LIMIT).select("page_id", "html")


def _rules(spark: SparkSession, d: str) -> DataFrame:
    return robots.parse_robots(inputs.robots_bodies(spark, d))


def robots_targets(spark: SparkSession, d: str) -> DataFrame:
    return robots.robots_targets(inputs.requests(spark, d))


def robots_allowed(spark: SparkSession, d: str) -> DataFrame:
    return robots.robots_allowed(inputs.requests(spark, d), _rules(spark, d))


def apply_robots(spark: SparkSession, d: str) -> DataFrame:
    judged = robots.judge_robots(inputs.requests(spark, d), _rules(spark, d))
    return judged.select("url", F.col("record.Message").alias("message"))


# --- addresses and hosts -----------------------------------------------------------------------


def attach_address(spark: SparkSession, d: str) -> DataFrame:
    asked = inputs.requests(spark, d).select("page_id", "url")
    return resolution.attach_address(asked, inputs.dns(spark, d))


def address_asof(spark: SparkSession, d: str) -> DataFrame:
    asked = inputs.requests(spark, d).select("page_id", "url", "asked_at")
    return resolution.attach_address(asked, inputs.dns(spark, d), as_of="asked_at").drop("asked_at")


def hosts_to_resolve(spark: SparkSession, d: str) -> DataFrame:
    return resolution.hosts_to_resolve(inputs.requests(spark, d), inputs.dns(spark, d), AS_OF)


def group_by_address(spark: SparkSession, d: str) -> DataFrame:
    return hosts.group_by_address(inputs.requests(spark, d), "page_id")


def run_batches(spark: SparkSession, d: str) -> DataFrame:
    # Addresses in runs of a few requests, some missing; order values far apart, some below zero.
    asked = inputs.page_urls(spark, d).select(
        ((F.col("page_id") - 100) * SPARSE).alias("place"),
        F.expr(
            "if(page_id % 11 = 0, NULL, '10.0.0.' || cast(floor(page_id / 3) % 7 AS string))"
        ).alias("ip"),
    )
    return hosts.run_batches(asked, "place")[0]


def politeness_plan(spark: SparkSession, d: str) -> DataFrame:
    asked = inputs.requests(spark, d).select(
        ((F.col("page_id") - 100) * SPARSE).alias("place"), "url", "ip"
    )
    return hosts.politeness_plan(asked, "place")[0].drop("ip")


def pending_stats(spark: SparkSession, d: str) -> DataFrame:
    return hosts.pending_stats(inputs.requests(spark, d))


def pending_totals(spark: SparkSession, d: str) -> DataFrame:
    return hosts.pending_totals(inputs.requests(spark, d))


# --- frontier ----------------------------------------------------------------------------------


def _shown(frontier: DataFrame) -> DataFrame:
    return frontier.select(
        "id", "url", "visited", "tld", _text("queued_at"), "success", "message", "ip", "cname"
    )


def new_sites(spark: SparkSession, d: str) -> DataFrame:
    return _shown(fr.new_sites(inputs.page_urls(spark, d), at=inputs.START))


def import_links(spark: SparkSession, d: str) -> DataFrame:
    grown, _ = fr.import_links(
        inputs.frontier(spark, d), inputs.import_urls(spark, d), at=inputs.START
    )
    return _shown(grown)


def import_links_new(spark: SparkSession, d: str) -> DataFrame:
    return fr.import_links(inputs.frontier(spark, d), inputs.import_urls(spark, d))[1]


def import_links_filtered(spark: SparkSession, d: str) -> DataFrame:
    """:func:`import_links_new` on a stored frontier: half of it in the base with its filter, half pending."""
    store = FrontierStore(spark, fresh_path(spark, "frontier"))
    known = inputs.frontier(spark, d)
    store.commit(known.filter("visited"))
    store.compact()
    store.commit(known.filter("NOT visited"))
    return store.unknown(inputs.import_urls(spark, d))


def _queued(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return fr.mark_queued(inputs.frontier(spark, d), inputs.queue_lines(spark, d), QUEUED_AT)


def import_pages(spark: SparkSession, d: str) -> DataFrame:
    known = inputs.frontier(spark, d).withColumn("message", F.lit("failed: before"))
    queued = known.withColumn("queued_at", F.lit(QUEUED_AT).cast("timestamp"))
    return _shown(fr.import_pages(queued, inputs.numbered_records(spark, d), at=inputs.START))


def _with_resolutions(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    known = inputs.frontier(spark, d).withColumn("message", F.lit("failed: before"))
    return fr.import_resolutions(known, inputs.resolutions(spark, d), at=inputs.START)


def import_resolutions(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_with_resolutions(spark, d)[0])


def import_resolutions_unmatched(spark: SparkSession, d: str) -> DataFrame:
    unmatched = _with_resolutions(spark, d)[1]
    return unmatched.select(F.col("seq"), F.col("Url").alias("url"), F.col("IP").alias("ip"))


def next_urls(spark: SparkSession, d: str) -> DataFrame:
    return fr.next_urls(inputs.frontier(spark, d), 10, SEED)


def mark_queued(spark: SparkSession, d: str) -> DataFrame:
    return _shown(_queued(spark, d)[0])


def mark_queued_requests(spark: SparkSession, d: str) -> DataFrame:
    return _queued(spark, d)[1]


def frontier_unique(spark: SparkSession, d: str) -> DataFrame:
    """URLs that stand more than once in the list to import, by the frontier's own check."""
    return fr.duplicate_urls(inputs.import_urls(spark, d))


def frontier_store(spark: SparkSession, d: str) -> DataFrame:
    """The operations one after the other on a stored frontier, with a compaction in between."""
    store = FrontierStore(spark, fresh_path(spark, "frontier"))
    store.commit(inputs.frontier(spark, d))
    store.compact()
    fresh, _ = fr.import_links(
        store.load(), inputs.import_urls(spark, d), at=inputs.START, touched_only=True
    )
    store.commit(fresh)
    visited = fr.import_pages(
        store.load(), inputs.numbered_records(spark, d), at=inputs.START, touched_only=True
    )
    store.commit(visited)
    gone = store.load().filter("startswith(url, 'http:')").withColumn(
        "deleted_at", F.lit(QUEUED_AT).cast("timestamp")
    )
    store.commit(gone)
    return _shown(store.load())


# --- streams -----------------------------------------------------------------------------------


def _page_stream(spark: SparkSession, d: str) -> DataFrame:
    """The pages, a few files each micro-batch."""
    # The pattern matches a single file as well as a folder of files.
    return (
        spark.readStream.schema(inputs.PAGES_SCHEMA)
        .option("maxFilesPerTrigger", BATCH_FILES)
        .parquet(f"{d}/pages.parquet*")
    )


def _derived_stream(rows: DataFrame, name: str, key: str) -> DataFrame:
    """Derived rows as a stream of a few files, a file each micro-batch. Rows of a key share a file, so
    their order does not depend on the order of files."""
    path = fresh_path(rows.sparkSession, name)
    rows.repartition(STREAM_FILES, key).write.parquet(path)
    return rows.sparkSession.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _stream_into_frontier(
    known: DataFrame, batches: DataFrame, op: streams.FrontierOp, name: str
) -> tuple[FrontierStore, Callable[[str, str], DataFrame]]:
    """The store after the stream, and a reader of an output of the operation, which every micro-batch
    wrote to a folder of its own, so that a replay overwrites it."""
    spark = known.sparkSession
    out = fresh_path(spark, name)
    store = FrontierStore(spark, f"{out}/frontier")
    store.commit(known)

    def emit(rows: DataFrame, outputs: dict[str, DataFrame], batch_id: int) -> None:
        for output, table in outputs.items():
            table.write.mode("overwrite").parquet(f"{out}/{output}/n={batch_id}")

    run = streams.run_frontier(batches, op, store, f"{out}/checkpoint", name, emit=emit)
    run.trigger(availableNow=True).start().awaitTermination()
    return store, lambda output, schema: spark.read.schema(schema).parquet(f"{out}/{output}/*")


def _run(stream: DataFrame, name: str) -> DataFrame:
    """All the data there is through a file sink, then the sink as a table."""
    return _drain(stream, fresh_path(stream.sparkSession, name))


def _drain(stream: DataFrame, out: str) -> DataFrame:
    """:func:`_run` with a folder that is gone on with."""
    spark = stream.sparkSession
    run = (
        stream.writeStream.format("parquet")
        .option("path", f"{out}/data")
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{out}/data")


def stream_extract(spark: SparkSession, d: str) -> DataFrame:
    return _run(streams.stream_extract(_page_stream(spark, d)), "stream-extract")


def stream_frontier(spark: SparkSession, d: str) -> DataFrame:
    out = fresh_path(spark, "stream-frontier")
    store = FrontierStore(spark, f"{out}/frontier")
    store.commit(inputs.frontier(spark, d))
    found = streams.stream_extract(_page_stream(spark, d))
    run = (
        streams.run_frontier(
            found, streams.links_op("link"), store, f"{out}/checkpoint", "links"
        )
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    return store.load().select("url", "visited", "tld")


def stream_import_pages(spark: SparkSession, d: str) -> DataFrame:
    known = (
        inputs.frontier(spark, d)
        .withColumn("message", F.lit("failed: before"))
        .withColumn("queued_at", F.lit(QUEUED_AT).cast("timestamp"))
    )
    found = inputs.numbered_records(spark, d).withColumn("url", F.col("Data.Url"))
    batches = _derived_stream(found, "page-records-in", "url").drop("url")
    op = streams.pages_op(at=inputs.START)
    return _shown(_stream_into_frontier(known, batches, op, "pages")[0].load())


def stream_import_resolutions(spark: SparkSession, d: str) -> DataFrame:
    """The frontier's rows, and the records that no row matched."""
    known = inputs.frontier(spark, d).withColumn("message", F.lit("failed: before"))
    batches = _derived_stream(inputs.resolutions(spark, d), "resolutions-in", "Url")
    op = streams.resolutions_op(at=inputs.START)
    store, read = _stream_into_frontier(known, batches, op, "resolutions")
    unmatched = read("unmatched", "seq BIGINT, Url STRING, IP STRING, Cname STRING, Message STRING")
    rows = store.load().select(F.lit("row").alias("kind"), "url", "ip", "message")
    return rows.unionByName(
        unmatched.select(F.lit("unmatched").alias("kind"), F.col("Url").alias("url"), F.col("IP").alias("ip"), F.col("Message").alias("message"))
    )


def stream_mark_queued(spark: SparkSession, d: str) -> DataFrame:
    """The frontier's rows that are queued, the requests, and the lines that are too short."""
    short = inputs.page_urls(spark, d).select(F.concat(F.lit("short "), "url").alias("value"))
    batches = _derived_stream(inputs.queue_lines(spark, d).unionByName(short), "queue-in", "value")
    store, read = _stream_into_frontier(
        inputs.frontier(spark, d), batches, streams.queue_op(QUEUED_AT), "queue"
    )
    queued = store.load().filter("queued_at IS NOT NULL").select(F.lit("row").alias("kind"), F.col("url").alias("value"))
    return queued.unionByName(
        read("requests", "value STRING").select(F.lit("request").alias("kind"), "value")
    ).unionByName(read("short", "line STRING").select(F.lit("short").alias("kind"), F.col("line").alias("value")))


def stream_dedup(spark: SparkSession, d: str) -> DataFrame:
    seen = _page_stream(spark, d).select(
        "url", "html", F.col("_metadata.file_modification_time").alias("seen_at")
    )
    found = links.extract_links(seen, keep=["seen_at"]).drop("url")
    return _run(streams.stream_dedup(found, "seen_at"), "stream-dedup").select("link")


def stream_stats(spark: SparkSession, d: str) -> DataFrame:
    """The statistics of a request stream, summed over its intervals. Every trigger writes the intervals
    that changed; the newest figure of each is its count at the end. The files come in any order of time,
    so nothing counts as late."""
    out = fresh_path(spark, "stream-stats")

    def keep(batch: DataFrame, batch_id: int) -> None:
        batch.withColumn("batch", F.lit(batch_id)).write.mode("overwrite").parquet(
            f"{out}/data/n={batch_id}"
        )

    asked = _page_stream(spark, d).selectExpr(*inputs.REQUEST_COLUMNS)
    run = (
        streams.stream_stats(asked, "asked_at", late="36500 days")
        .writeStream.outputMode("update")
        .foreachBatch(keep)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    run.awaitTermination()
    told = spark.read.schema("since TIMESTAMP, address STRING, pending BIGINT, batch INT")
    last = (
        told.parquet(f"{out}/data")
        .groupBy("since", "address")
        .agg(F.max_by("pending", "batch").alias("pending"))
    )
    return last.groupBy("address").agg(F.sum("pending").alias("pending"))


def stream_address(spark: SparkSession, d: str) -> DataFrame:
    """All requests, in whatever order the files come: nothing is late, and a last file, far in the
    future, lets every slice end."""
    out = fresh_path(spark, "stream-address")
    end = inputs.page_urls(spark, d).limit(0)
    end.write.parquet(f"{out}/end")
    last = spark.readStream.schema("page_id BIGINT, url STRING").parquet(f"{out}/end")
    found = _page_stream(spark, d).select("page_id", "url").unionByName(last)
    asked = found.selectExpr(*inputs.REQUEST_COLUMNS).drop("ip")
    observed = found.selectExpr(*inputs.DNS_COLUMNS)
    joined = streams.stream_address(asked, observed, "asked_at", late="36500 days")
    _drain(joined, out)
    far = spark.range(1).select(F.lit(END_OF_TIME).cast("bigint").alias("page_id"), F.lit("").alias("url"))
    far.write.mode("append").parquet(f"{out}/end")
    rows = _drain(joined, out)
    return rows.filter(F.col("page_id") < END_OF_TIME).select("page_id", "url", "ip")


QUERIES: dict[str, Query] = {
    "links_per_site": links_per_site,
    "read_url_list": read_url_list,
    "numbered_urls": numbered_urls,
    "fetch_order": fetch_order,
    "parse_fetch_hints": parse_fetch_hints,
    "read_page_records": read_page_records,
    "read_resolutions": read_resolutions,
    "page_record_json": page_record_json,
    "page_records": page_records,
    "normalize_url": _on_forms(U.normalize_url, "normal"),
    "canonicalize_url": _on_forms(U.canonicalize_url, "canonical"),
    "site_root": _on_forms(U.site_root, "root"),
    "registered_domain": _on_forms(url_domain, "domain"),
    "registered_domain_table": registered_domain_table,
    "robots_url": _on_forms(U.robots_url, "robots"),
    "resolve_reference": resolve_reference,
    "strip_query": strip_query,
    "url_parts": url_parts,
    "filter_scheme": _filtered(links.has_allowed_scheme),
    "filter_domain": _filtered(links.has_registrable_domain),
    "filter_port": _filtered(links.has_no_port),
    "filter_links": filter_links,
    "filter_links_table": filter_links_table,
    "reject_reasons": reject_reasons,
    "extract_hrefs": _on_pages(links.extract_hrefs),
    "resolve_links": _on_pages(links.resolve_links),
    "extract_links": _on_pages(links.extract_links),
    "extract_roots": _on_pages(links.extract_links, root=True),
    "page_dedup": _on_pages(links.dedup_links),
    "dedup_stats": _on_pages(links.dedup_stats),
    "pages_with_links": pages_with_links,
    "record_links": record_links,
    "failed_records": failed_records,
    "limit_body": limit_body,
    "apply_robots": apply_robots,
    "robots_targets": robots_targets,
    "robots_rules": _rules,
    "robots_allowed": robots_allowed,
    "attach_address": attach_address,
    "address_asof": address_asof,
    "hosts_to_resolve": hosts_to_resolve,
    "group_by_address": group_by_address,
    "run_batches": run_batches,
    "politeness_plan": politeness_plan,
    "pending_stats": pending_stats,
    "pending_totals": pending_totals,
    "new_sites": new_sites,
    "import_links": import_links,
    "import_links_new": import_links_new,
    "import_links_filtered": import_links_filtered,
    "import_pages": import_pages,
    "import_pages_file": import_pages_file,
    "import_resolutions": import_resolutions,
    "import_resolutions_file": import_resolutions_file,
    "import_resolutions_unmatched": import_resolutions_unmatched,
    "next_urls": next_urls,
    "mark_queued": mark_queued,
    "mark_queued_requests": mark_queued_requests,
    "frontier_unique": frontier_unique,
    "frontier_store": frontier_store,
    "stream_extract": stream_extract,
    "stream_frontier": stream_frontier,
    "stream_record_links": stream_record_links,
    "stream_import_pages": stream_import_pages,
    "stream_import_resolutions": stream_import_resolutions,
    "stream_mark_queued": stream_mark_queued,
    "stream_dedup": stream_dedup,
    "stream_stats": stream_stats,
    "stream_address": stream_address,
}
