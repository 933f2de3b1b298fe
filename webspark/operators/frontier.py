"""Operations on the frontier, the table of known URLs and their state.

Each operation is one join of the whole frontier with a batch; ``url`` is the key and is kept as
given. Batches are reduced to one row per URL before the join, with aggregates that combine within
each task, so a URL repeated in a third of the batch costs no more than any other. Operations return
the new frontier; with ``touched_only`` they return only the rows that are new or changed, which is
what :class:`webspark.sources.frontier_store.FrontierStore` commits.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspark.functions.domains import BUILT_IN, SuffixRules, url_domain
from webspark.schemas import FRONTIER

NEXT_LIMIT = 10


def site_id(url: str = "url") -> Column:
    """60-bit id made from the URL; the URL itself is the key."""
    return F.conv(F.substring(F.md5(url), 1, 15), 16, 10).cast("bigint")


def _time(at: datetime | str | Column | None) -> Column:
    if at is None:
        return F.current_timestamp()
    return at if isinstance(at, Column) else F.lit(at).cast("timestamp")


def new_sites(
    urls: DataFrame,
    url: str = "url",
    at: datetime | str | Column | None = None,
    rules: SuffixRules = BUILT_IN,
) -> DataFrame:
    """Frontier rows of URLs not seen before: URL, registered domain, the rest empty or false."""
    values = {
        "id": site_id(url),
        "url": F.col(url),
        "visited": F.lit(False),
        "tld": url_domain(url, rules),
        "success": F.lit(False),
        "message": F.lit(""),
        "cname": F.lit(""),
        "created_at": _time(at),
        "updated_at": _time(at),
    }
    return urls.select(
        *[values.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in FRONTIER]
    )


def import_links(
    frontier: DataFrame,
    urls: DataFrame,
    url: str = "url",
    at: datetime | str | Column | None = None,
    rules: SuffixRules = BUILT_IN,
    touched_only: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(frontier, new): URLs not in the table are added once each; ``new`` lists just these."""
    fresh = (
        urls.select(F.col(url).alias("url"))
        .filter(F.col("url").isNotNull())
        .distinct()
        .join(frontier.select("url"), "url", "left_anti")
    )
    rows = new_sites(fresh, "url", at, rules)
    return (rows if touched_only else frontier.unionByName(rows)), fresh


def import_pages(
    frontier: DataFrame,
    records: DataFrame,
    seq: str = "seq",
    at: datetime | str | Column | None = None,
    rules: SuffixRules = BUILT_IN,
    touched_only: bool = False,
) -> DataFrame:
    """Page records marked in the frontier: visited, no longer queued, success as in the last record.

    The message is overwritten by failures only, so the text of an old failure stays after a
    success. Records apply in the order of ``seq``; unknown URLs are added, records without a URL are not.
    """
    record = records.filter(F.col("Data.Url").isNotNull()).groupBy(F.col("Data.Url").alias("url")).agg(
        F.max_by("Success", seq).alias("r_success"),
        F.expr(f"max_by(Message, {seq}) FILTER (WHERE NOT Success)").alias("r_message"),
        F.lit(True).alias("r_hit"),
    )
    joined = frontier.withColumn("f_hit", F.lit(True)).join(
        record, "url", "right" if touched_only else "full"
    )
    hit, is_new = F.col("r_hit").isNotNull(), F.col("f_hit").isNull()
    values = {
        "id": F.when(is_new, site_id("url")).otherwise(F.col("id")),
        "visited": F.when(hit, True).otherwise(F.col("visited")),
        "tld": F.when(is_new, url_domain("url", rules)).otherwise(F.col("tld")),
        "queued_at": F.when(~hit, F.col("queued_at")),
        "success": F.when(hit, F.col("r_success")).otherwise(F.col("success")),
        "message": F.coalesce("r_message", "message", F.lit("")),
        "cname": F.coalesce("cname", F.lit("")),
        "created_at": F.when(is_new, _time(at)).otherwise(F.col("created_at")),
        "updated_at": F.when(hit, _time(at)).otherwise(F.col("updated_at")),
    }
    return joined.select(*[values.get(n, F.col(n)).alias(n) for n in FRONTIER.fieldNames()])


def import_resolutions(
    frontier: DataFrame,
    resolutions: DataFrame,
    seq: str = "seq",
    at: datetime | str | Column | None = None,
    touched_only: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """(frontier, unmatched): address, cname and message of known URLs overwritten by the last
    resolution record, empty texts included; records of unknown URLs are handed back."""
    last = (
        resolutions.groupBy(F.col("Url").alias("url"))
        .agg(F.max_by(F.struct("IP", "Cname", "Message"), seq).alias("r"))
    )
    joined = frontier.join(last, "url", "inner" if touched_only else "left")
    hit = F.col("r").isNotNull()
    values = {
        "ip": F.when(hit, F.nullif(F.col("r.IP"), F.lit(""))).otherwise(F.col("ip")),
        "cname": F.when(hit, F.col("r.Cname")).otherwise(F.col("cname")),
        "message": F.when(hit, F.col("r.Message")).otherwise(F.col("message")),
        "updated_at": F.when(hit, _time(at)).otherwise(F.col("updated_at")),
    }
    unmatched = resolutions.join(
        frontier.select(F.col("url").alias("Url")), "Url", "left_anti"
    ).select(*resolutions.columns)
    return (
        joined.select(*[values.get(n, F.col(n)).alias(n) for n in FRONTIER.fieldNames()]),
        unmatched,
    )


def next_urls(
    frontier: DataFrame, n: int = NEXT_LIMIT, seed: str = "", exclude_queued: bool = False
) -> DataFrame:
    """(url): ``n`` unvisited URLs in a random order fixed by ``seed``. The order is that of a hash,
    so it does not depend on partitions; only the ``n`` best of each task meet."""
    waiting = frontier.filter(~F.col("visited"))
    if exclude_queued:
        waiting = waiting.filter(F.col("queued_at").isNull())
    return (
        waiting.select("url").orderBy(F.md5(F.concat(F.lit(seed), F.col("url"))), "url").limit(n)
    )


def parse_queue_lines(lines: DataFrame, value: str = "value") -> tuple[DataFrame, DataFrame]:
    """((id, url, ip), short lines) of lines ``id<TAB>url<TAB>ip``. An id that is no number is 0."""
    fields = lines.withColumn("ws_f", F.split(F.col(value), "\t"))
    full = F.size("ws_f") >= 3
    return (
        fields.filter(full).select(
            F.coalesce(F.trim(F.col("ws_f")[0]).try_cast("bigint"), F.lit(0)).alias("id"),
            F.col("ws_f")[1].alias("url"),
            F.trim(F.col("ws_f")[2], F.lit("\r\n")).alias("ip"),
        ),
        fields.filter(~full).select(F.col(value).alias("line")),
    )


def mark_queued(
    frontier: DataFrame,
    lines: DataFrame,
    queued_at: datetime | str | Column,
    value: str = "value",
    touched_only: bool = False,
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frontier, requests, short lines): rows whose id is listed get ``queued_at``; ``requests``
    has a line ``url<TAB>ip`` for every full input line, known or not."""
    queue, short = parse_queue_lines(lines, value)
    # The id is a function of the URL, which is what a stored frontier is laid out by: ids meet the two
    # narrow columns, and the rows themselves are joined by URL, in place.
    listed = (
        frontier.select("id", "url")
        .join(queue.select("id").distinct(), "id", "left_semi")
        .select("url", F.lit(True).alias("q_hit"))
    )
    joined = frontier.join(listed, "url", "inner" if touched_only else "left")
    stamped = F.when(F.col("q_hit"), _time(queued_at)).otherwise(F.col("queued_at"))
    marked = joined.select(
        *[(stamped if n == "queued_at" else F.col(n)).alias(n) for n in FRONTIER.fieldNames()]
    )
    return marked, queue.select(F.concat_ws("\t", "url", "ip").alias("value")), short


def duplicate_urls(frontier: DataFrame) -> DataFrame:
    """(url, rows) of URLs that stand in the frontier more than once; empty when all is well."""
    return frontier.groupBy("url").agg(F.count(F.lit(1)).alias("rows")).filter(F.col("rows") > 1)
