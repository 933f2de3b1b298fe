"""Links of pages: extraction, per-page dedup and the link filter.

A page's links are worked on as one array inside its row. Extraction, resolution, dedup and filter
are therefore one narrow projection over the scan: no shuffle, no state, and the HTML column never
travels. Only the caller who wants links distinct across pages pays for an exchange.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspark.functions.binding import case, each, let, lit, matches, struct
from webspark.functions.domains import BUILT_IN, SuffixRules, has_domain_sql
from webspark.functions.html import anchor_hrefs, anchor_hrefs_sql
from webspark.functions.urls import (
    authority_host_sql,
    canonical_array_sql,
    canonical_of_sql,
    resolved_root_sql,
    resolved_sql,
    strip_query_sql,
    url_scheme_sql,
)

# Schemes a link may have, and a host text with an explicit port.
ALLOWED_SCHEMES = ("http", "https")
HOST_WITH_PORT = r"^(?:\[[^\]]*\]|[^:\[\]]*):[^:]*$"


def _as(name: str, alias: str) -> Column:
    return F.col(name) if name == alias else F.col(name).alias(alias)


# --- predicates --------------------------------------------------------------------------------


def _allowed_scheme_sql(url: str, allowed: Sequence[str]) -> str:
    return f"{url_scheme_sql(url)} IN ({', '.join(lit(s) for s in allowed)})"


def has_allowed_scheme(url: str, allowed: Sequence[str] = ALLOWED_SCHEMES) -> Column:
    return F.expr(_allowed_scheme_sql(url, allowed))


def has_registrable_domain(url: str, rules: SuffixRules = BUILT_IN) -> Column:
    """The host text of a canonical URL, port included, has a registrable domain."""
    return F.expr(let(authority_host_sql(url), "ws_h", lambda h: has_domain_sql(h, rules)))


def has_no_port(url: str) -> Column:
    """No explicit port. Canonical URLs have lost their scheme's default port, so any port that is
    left, 80 and 443 included, fails."""
    return F.expr(f"NOT {matches(authority_host_sql(url), HOST_WITH_PORT)}")


def reject_reason_sql(
    url: str, rules: SuffixRules = BUILT_IN, allowed: Sequence[str] = ALLOWED_SCHEMES
) -> str:
    by_host = let(
        authority_host_sql(url),
        "ws_h",
        lambda h: case(
            (f"NOT {has_domain_sql(h, rules)}", "'empty_host'"),
            (matches(h, HOST_WITH_PORT), "'port'"),
        ),
    )
    return case(
        (f"{url} IS NULL", "NULL"),
        (f"NOT {_allowed_scheme_sql(url, allowed)}", "'scheme'"),
        default=by_host,
    )


def link_reject_reason(
    url: str, rules: SuffixRules = BUILT_IN, allowed: Sequence[str] = ALLOWED_SCHEMES
) -> Column:
    """Why a canonical link is dropped: ``scheme``, ``empty_host`` or ``port``; null when kept."""
    return F.expr(reject_reason_sql(url, rules, allowed))


def filter_links(links: DataFrame, url: str = "link", rules: SuffixRules = BUILT_IN) -> DataFrame:
    """Rows whose link has an allowed scheme, a registrable domain and no port."""
    return links.filter(link_reject_reason(url, rules).isNull())


def strip_queries(urls: DataFrame, url: str = "url", into: str = "stripped") -> DataFrame:
    """Rows with the normalised URL without its query; texts that are no URL are dropped."""
    one_or_none = f"filter(array({strip_query_sql(url)}), ws_e -> ws_e IS NOT NULL)"
    return urls.select("*", F.expr(f"explode({one_or_none})").alias(into))


# --- array forms -------------------------------------------------------------------------------


def resolved_links_sql(url: str, html: str, root: bool = False) -> str:
    resolve = resolved_root_sql if root else resolved_sql

    def on_base(base: str) -> str:
        refs = canonical_array_sql(anchor_hrefs_sql(html))
        return case(
            (f"{base} IS NOT NULL", each(refs, "ws_ref", lambda ref: resolve(base, ref))),
            default="cast(array() AS array<string>)",
        )

    return let(canonical_of_sql(url), "ws_base", on_base)


def resolved_links(url: str, html: str, root: bool = False) -> Column:
    """Array of the page's links in document order, repeats included; empty when the page's own
    URL is no URL. With ``root`` each link is cut down to its site root."""
    return F.expr(resolved_links_sql(url, html, root))


def distinct_links(url: str, html: str, root: bool = False) -> Column:
    """:func:`resolved_links` with only the first of equal links."""
    return F.expr(f"array_distinct({resolved_links_sql(url, html, root)})")


def kept_links(
    url: str, html: str, root: bool = False, rules: SuffixRules = BUILT_IN
) -> Column:
    """:func:`distinct_links` that pass the link filter, which comes after the dedup."""
    return F.expr(
        f"filter(array_distinct({resolved_links_sql(url, html, root)}), "
        f"ws_l -> {reject_reason_sql('ws_l', rules)} IS NULL)"
    )


# --- tables ------------------------------------------------------------------------------------


def extract_hrefs(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, pos, href): every ``a[href]`` of every page, positions from 0."""
    return pages.select(_as(url, "url"), F.posexplode(anchor_hrefs(html)).alias("pos", "href"))


def extract_links(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    root: bool = False,
    rules: SuffixRules = BUILT_IN,
    keep: Sequence[str] = (),
) -> DataFrame:
    """(url, link): new links of every page; the same link may come from several pages."""
    return pages.select(
        *keep, _as(url, "url"), F.explode(kept_links(url, html, root, rules)).alias("link")
    )


def resolve_links(
    pages: DataFrame, url: str = "url", html: str = "html", root: bool = False
) -> DataFrame:
    """(url, pos, link): resolved links before dedup and filter."""
    return pages.select(
        _as(url, "url"),
        F.posexplode(resolved_links(url, html, root)).alias("pos", "link"),
    )


def dedup_links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, pos, link): links after the per-page dedup and before the filter."""
    return pages.select(
        _as(url, "url"), F.posexplode(distinct_links(url, html)).alias("pos", "link")
    )


def dedup_stats(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, links, removed): links per page and how many repeats the dedup removes."""
    counts = let(
        resolved_links_sql(url, html),
        "ws_links",
        lambda links: struct(
            links=f"cast(size({links}) AS bigint)",
            removed=f"cast(size({links}) - size(array_distinct({links})) AS bigint)",
        ),
    )
    return pages.select(_as(url, "url"), F.expr(f"inline(array({counts}))"))


def pages_with_links(
    pages: DataFrame, url: str = "url", html: str = "html", rules: SuffixRules = BUILT_IN
) -> DataFrame:
    """Pages with one more column, the array of their links in document order."""
    return pages.withColumn("links", kept_links(url, html, rules=rules))


def extract_records(
    records: DataFrame, root: bool = False, rules: SuffixRules = BUILT_IN
) -> DataFrame:
    """Page records with their ``Links`` filled from URL and body; every other field is passed on. A
    record without links, a failed one for instance, has an empty array. Works on streams too."""
    links = kept_links("Data.Url", "Data.Body", root, rules)
    filled = F.coalesce(links, F.array().cast("array<string>"))
    return records.select(*[filled.alias(c) if c == "Links" else F.col(c) for c in records.columns])
