"""Not-modified revisits of web archives, resolved to the response they stand for.

A revisit record says that a page had not changed; its body is that of an earlier full response. Each
revisit takes the latest earlier response of its canonical URL, the validators of the two are checked,
and the stored headers are brought up to date with those that a not-modified answer may change.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webspark.functions.urls import canonicalize_url
from webspark.llm.tables import written

# Slices of time, of about equal numbers of records: what one task orders of a URL, however hot.
SLICES = 64

# Headers that a not-modified answer doesn't change in a stored response (RFC 9111,
# 3.1 and 3.2): those of the connection, and those that describe the stored body.
NOT_MERGED = (
    "connection", "keep-alive", "proxy-authenticate", "proxy-authentication-info", "proxy-authorization",
    "proxy-connection", "te", "trailer", "transfer-encoding", "upgrade", "content-encoding",
    "content-length", "content-range",
)

VERDICTS = ("resolved", "changed", "unvalidated", "no_response")


def _tidy(headers: Column) -> Column:
    """Headers with lower-case names; of names that differ in case only, the greatest value (the entries
    of a map have no order)."""
    entries = F.coalesce(F.map_entries(headers), F.array().cast("array<struct<key:string,value:string>>"))
    names = F.array_distinct(F.transform(entries, lambda e: F.lower(F.trim(e["key"]))))
    return F.map_from_arrays(
        names,
        F.transform(
            names,
            lambda n: F.array_max(
                F.transform(
                    F.filter(entries, lambda e: F.lower(F.trim(e["key"])) == n), lambda e: e["value"]
                )
            ),
        ),
    )


def merge_headers(stored: Column, fresh: Column) -> Column:
    """Tidy stored headers, brought up to date. Names that ``connection`` lists aren't merged either."""
    listed = F.transform(F.split(F.lower(F.coalesce(fresh["connection"], F.lit(""))), ","), F.trim)
    barred = F.array_union(F.array(*map(F.lit, NOT_MERGED)), listed)
    merged = F.map_filter(fresh, lambda k, _: ~F.array_contains(barred, k))
    kept = F.map_filter(stored, lambda k, _: ~F.array_contains(F.map_keys(merged), k))
    return F.map_concat(kept, merged)


def _validators(headers: Column, digest: Column) -> list[Column]:
    etag = F.regexp_replace(F.trim(headers["etag"]), "^W/", "")
    return [etag.alias("etag"), F.trim(headers["last-modified"]).alias("modified"), digest.alias("digest")]


def _verdict(stored: Column, own: Column) -> Column:
    """Digests, tags (compared weakly), then dates if there were no two tags: one that differs decides,
    then one that agrees."""

    def same(name: str) -> Column:
        return stored[name] == own[name]  # null unless both are there

    tests = [same("digest"), same("etag"), F.when(same("etag").isNull(), same("modified"))]
    differs = [F.coalesce(~t, F.lit(False)) for t in tests]
    agrees = [F.coalesce(t, F.lit(False)) for t in tests]
    return (
        F.when(stored.isNull(), "no_response")
        .when(differs[0] | differs[1] | differs[2], "changed")
        .when(agrees[0] | agrees[1] | agrees[2], "resolved")
        .otherwise("unvalidated")
    )


def _key() -> Column:
    """Generator of the canonical URL as ``key``: no row where there is none. A filter would compute it twice."""
    return F.explode(F.filter(F.array(canonicalize_url("url")), lambda k: k.isNotNull())).alias("key")


def _slice(time: Column, bounds: list) -> Column:
    return F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b <= time))


def latest_before(asked: DataFrame, offered: DataFrame, slices: int = SLICES) -> DataFrame:
    """``(key, time, found)`` for the distinct ``(key, time)`` of ``asked``: the ``found`` of the latest
    row of ``offered(key, time, found)`` with an earlier time.

    Times fall into slices with bounds at quantiles. Within a slice a window walks over the rows of a
    key; between slices it walks over one row for each slice of the key, at most ``slices`` of them. So
    no task orders more of a hot key than its share of a slice, and no pairs are made. Several rows of
    ``offered`` at one time should be reduced to one before.
    """
    rows = asked.select("key", "time", F.lit(0).alias("turn")).distinct().unionByName(
        offered.select("key", "time", F.lit(1).alias("turn"), "found"), allowMissingColumns=True
    )
    steps = [k / slices for k in range(1, slices)]
    bounds = asked.select("time").union(offered.select("time")).agg(
        F.percentile_approx(F.unix_micros("time"), steps, 1000)
    ).first()[0] or []
    sliced = rows.withColumn("slice", _slice(F.unix_micros("time"), sorted(set(bounds))))
    inside = Window.partitionBy("key", "slice").orderBy("time", "turn")
    walked = sliced.withColumn("ws_here", F.last("found", True).over(inside.rowsBetween(Window.unboundedPreceding, 0)))
    # Partial aggregates first: one row for each key and slice.
    ends = sliced.groupBy("key", "slice").agg(F.max_by("found", F.when(F.col("turn") == 1, F.col("time"))).alias("ws_end"))
    over = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = ends.select("key", "slice", F.last("ws_end", True).over(over).alias("ws_carried"))
    return (
        walked.where("turn = 0")
        .select("key", "time", "slice", "ws_here")
        .join(carried, ["key", "slice"], "left")
        .select("key", "time", F.coalesce("ws_here", "ws_carried").alias("found"))
    )


def resolve_revisits(
    revisits: DataFrame, responses: DataFrame, slices: int = SLICES, payload: str | None = None
) -> DataFrame:
    """Every revisit with ``response_id, verdict, merged_headers``, and the body column ``payload`` of the
    response if one is named.

    Both tables have ``record_id, url, captured_at, headers`` (a map) and ``payload_digest``; responses
    are full ones. URLs meet in canonical form. Verdicts: ``resolved``, ``changed`` (a validator
    differs: digest, ETag by weak comparison, or Last-Modified where there are no two ETags),
    ``unvalidated`` (nothing to compare), ``no_response``. Only resolved revisits have merged headers and
    a payload; ``response_id`` names the candidate in any case but the last.

    "Earlier" is strictly earlier; of responses at one time the one with the largest id counts. A null
    or bad URL, or a null time, has no response. Null headers are none. Repeated revisits are returned
    as often, repeated responses count once. Columns of revisits with the names of the result are
    replaced; other columns stay. An empty table of responses leaves everything without a response.
    """
    made = ("response_id", "verdict", "merged_headers", "ws_key", payload)
    names = [c for c in revisits.columns if c not in made]
    own = revisits.select(*names, canonicalize_url("url").alias("ws_key"), _tidy(F.col("headers")).alias("ws_fresh"))
    # Keys are written once: a canonical URL is a large expression, and plans that repeat it fill the driver.
    stored = responses.where("captured_at IS NOT NULL").select(
        _key(),
        F.col("captured_at").alias("time"),
        F.struct(
            F.col("record_id").alias("id"),
            _tidy(F.col("headers")).alias("headers"),
            F.col("payload_digest").alias("digest"),
        ).alias("found"),
    )
    latest = stored.groupBy("key", "time").agg(F.max_by("found", F.col("found.id")).alias("found"))
    offered = written(latest, "revisit-responses")
    times = revisits.where("captured_at IS NOT NULL").select(_key(), F.col("captured_at").alias("time"))
    asked = written(times.distinct(), "revisit-times")
    answers = latest_before(asked, offered, slices).select(
        F.col("key").alias("ws_key"), F.col("time").alias("ws_time"), "found"
    )
    joined = own.join(answers, (own["ws_key"] == answers["ws_key"]) & (F.col("captured_at") == F.col("ws_time")), "left")
    theirs = F.when(F.col("found").isNotNull(), F.struct(*_validators(F.col("found.headers"), F.col("found.digest"))))
    mine = F.struct(*_validators(F.col("ws_fresh"), F.col("payload_digest")))
    judged = joined.withColumn("ws_theirs", theirs).withColumn("ws_mine", mine).withColumn(
        "verdict", _verdict(F.col("ws_theirs"), F.col("ws_mine"))
    )
    out = judged.select(
        *[F.col(f"`{c}`") for c in names],
        F.col("found.id").alias("response_id"),
        "verdict",
        F.when(F.col("verdict") == "resolved", merge_headers(F.col("found.headers"), F.col("ws_fresh"))).alias("merged_headers"),
    )
    if payload is None:
        return out
    bodies = responses.select(F.col("record_id").alias("ws_id"), F.col(payload)).dropDuplicates(["ws_id"])
    resolved = F.when(F.col("verdict") == "resolved", F.col("response_id"))
    return out.join(bodies, resolved == F.col("ws_id"), "left").drop("ws_id")
