"""Address resolution as joins with a table of observations ``(host, ips, cname, observed_at, error)``."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webspark.functions.binding import present
from webspark.functions.urls import url_hostname, url_hostname_sql
from webspark.operators.joins import lookup

# How long an observation serves, and the message of an empty answer.
TTL_SECONDS = 20 * 60
NO_RESULTS = "No results"


def _with_host(requests: DataFrame, url: str) -> DataFrame:
    return requests.withColumn("ws_host", url_hostname(url))


def _answer(found: Column) -> list[Column]:
    """(ip, cname, message) of an observation; all null without one."""
    empty = F.coalesce(F.size(found["ips"]), F.lit(0)) < 1
    failed = found["error"].isNotNull()
    return [
        F.when(~failed, F.try_element_at(found["ips"], F.lit(1))).alias("ip"),
        F.when(~failed, found["cname"]).alias("cname"),
        F.when(failed, found["error"])
        .when(found.isNotNull(), F.when(empty, F.lit(NO_RESULTS)).otherwise(F.lit("")))
        .alias("message"),
    ]


def attach_address(
    requests: DataFrame,
    dns: DataFrame,
    url: str = "url",
    as_of: str | None = None,
    ttl_seconds: int = TTL_SECONDS,
) -> DataFrame:
    """Requests with ``ip``, ``cname`` and ``message`` from the observation of their host.

    The first address of the newest observation counts. A failed observation gives its error as
    message, an empty answer ``No results``, a host never observed three nulls. With ``as_of``, the
    name of the request's time column, see :func:`attach_address_asof`.
    """
    if as_of is not None:
        return attach_address_asof(requests, dns, as_of, url, ttl_seconds)
    # max_by combines within each task, so a host with a great many observations stays cheap.
    newest = dns.groupBy(F.col("host").alias("ws_host")).agg(
        F.max_by(F.struct("ips", "cname", "error"), F.struct("observed_at", "error", "ips")).alias(
            "ws_found"
        )
    )
    kept = [c for c in requests.columns if c not in ("ip", "cname", "message")]
    return lookup(_with_host(requests, url), newest, ["ws_host"]).select(
        *kept, *_answer(F.col("ws_found"))
    )


def attach_address_asof(
    requests: DataFrame,
    dns: DataFrame,
    as_of: str,
    url: str = "url",
    ttl_seconds: int = TTL_SECONDS,
    slices_per_ttl: int = 4,
) -> DataFrame:
    """Requests with the newest address observed at or before their time and not more than the TTL
    before it (both bounds count). Failed observations and empty answers never serve, so an older answer
    goes on serving; where nothing serves and the newest answer within the TTL is empty, the message says
    ``No results``.

    Requests are reduced to their different (host, time) first, so any number of requests at one
    time is one question. Time is cut into slices of a fraction of the TTL, and the last observation
    of a host in a slice is copied into the few slices its TTL still reaches. One window per (host,
    slice) then sees all it needs, no pairs are formed, and a host that holds a large share of the
    rows is spread over its slices. The answers are joined back to the requests.
    """
    ttl = ttl_seconds * 1_000_000
    width = max(1, ttl // slices_per_ttl)
    kept = [c for c in requests.columns if c not in ("ip", "cname", "message")]

    def slice_of(micros: Column) -> Column:
        return F.call_function("div", micros, F.lit(width))

    own = (
        dns.filter(F.col("error").isNull() & F.col("host").isNotNull())
        .groupBy(F.col("host").alias("ws_host"), F.unix_micros("observed_at").alias("ws_at"))
        .agg(F.max(F.struct("ips", "cname", "error")).alias("ws_answer"))
        .select(
            "ws_host",
            "ws_at",
            slice_of(F.col("ws_at")).alias("ws_slice"),
            F.struct("ws_at", "ws_answer").alias("ws_found"),
        )
        .withColumn("ws_good", F.when(F.size("ws_found.ws_answer.ips") > 0, F.col("ws_found")))
    )
    # The last answer of a slice, and the last one that is not empty, in the slices each still reaches.
    both = F.when(F.col("ws_any") == F.col("ws_best"), F.array("ws_any")).otherwise(
        F.array_compact(F.array("ws_any", "ws_best"))
    )

    def reached(found: Column) -> Column:
        after = F.col("ws_slice") + 1
        return F.transform(
            F.sequence(after, F.greatest(slice_of(found["ws_at"] + F.lit(ttl)), after)),
            lambda at: F.struct(at.alias("at"), found.alias("found")),
        )

    carried = (
        own.groupBy("ws_host", "ws_slice")
        .agg(F.max("ws_found").alias("ws_any"), F.max("ws_good").alias("ws_best"))
        .select("ws_host", F.explode(F.flatten(F.transform(both, reached))).alias("ws_copy"))
        .select(
            "ws_host",
            F.col("ws_copy.found.ws_at").alias("ws_at"),
            F.col("ws_copy.at").alias("ws_slice"),
            F.col("ws_copy.found").alias("ws_found"),
            F.when(F.size("ws_copy.found.ws_answer.ips") > 0, F.col("ws_copy.found")).alias("ws_good"),
        )
    )
    timed = _with_host(requests.select(*kept), url).withColumn(
        "ws_at", F.unix_micros(F.col(as_of).cast("timestamp"))
    )
    asked = (
        timed.select("ws_host", "ws_at")
        .distinct()
        .withColumn("ws_slice", slice_of(F.col("ws_at")))
        .withColumn("ws_asks", F.lit(True))
    )
    events = own.unionByName(carried).withColumn("ws_asks", F.lit(False))
    # At one instant observations come before requests.
    so_far = (
        Window.partitionBy("ws_host", "ws_slice")
        .orderBy("ws_at", "ws_asks", "ws_found")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )

    def in_time(found: str) -> Column:
        return F.when(F.col(f"{found}.ws_at") >= F.col("ws_at") - F.lit(ttl), F.col(f"{found}.ws_answer"))

    served = (
        events.unionByName(asked, allowMissingColumns=True)
        .withColumn("ws_last", F.last("ws_found", ignorenulls=True).over(so_far))
        .withColumn("ws_serves", F.last("ws_good", ignorenulls=True).over(so_far))
        .filter(F.col("ws_asks"))
        .select("ws_host", "ws_at", F.coalesce(in_time("ws_serves"), in_time("ws_last")).alias("ws_answer"))
        .filter(F.col("ws_answer").isNotNull())
    )
    return lookup(timed, served, ["ws_host", "ws_at"]).select(
        *kept, *_answer(F.col("ws_answer"))
    )


def hosts_to_resolve(
    requests: DataFrame,
    dns: DataFrame,
    as_of: datetime | str,
    url: str = "url",
    ttl_seconds: int = TTL_SECONDS,
) -> DataFrame:
    """(host): hosts of the requests that no observation serves at the instant ``as_of``."""
    now = F.lit(as_of).cast("timestamp")
    valid = dns.filter(
        F.col("error").isNull()
        & (F.size("ips") > 0)
        & (F.col("observed_at") <= now)
        & (F.col("observed_at") >= now - F.make_dt_interval(secs=F.lit(ttl_seconds)))
    ).select("host").distinct()
    hosts = requests.select(present(url_hostname_sql(url), "host")).distinct()
    return hosts.join(valid, "host", "left_anti")
