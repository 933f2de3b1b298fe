"""Registered domains by a suffix list that is a table, for lists of any length.

:mod:`webspark.functions.domains` holds a few rules as literals of an expression, which also suits streams. Here
the whole published list is a table of rules, and plans keep their size whatever its length. Every different host
meets the rules once: each of its endings is looked up, and the best match per host is joined back to the rows.
Texts other than hosts never travel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webspark.functions.addresses import is_ip_sql
from webspark.functions.binding import matches
from webspark.functions.domains import EMPTY_LABEL, MAX_RULES
from webspark.functions.idna import ascii_host_sql
from webspark.functions.urls import authority_host_sql
from webspark.operators.joins import lookup
from webspark.operators.links import HOST_WITH_PORT, has_allowed_scheme
from webspark.sources.lines import numbered_lines

# The line that begins a section of the published list, and the names of the sections.
SECTION = r"^//\s*===BEGIN (ICANN|PRIVATE) DOMAINS==="
ICANN, PRIVATE = "icann", "private"


def suffix_rules(lines: DataFrame, seq: str = "seq", value: str = "value") -> DataFrame:
    """(rule, kind, section): the rules of numbered lines of the published format.

    ``kind`` is ``plain``, ``wildcard`` (``rule`` is then what follows ``*.``) or ``exception``. A rule outside
    ASCII has a row in both of its forms. Lines before any section count as ``icann``; of rules that stand in
    both sections the one in ``icann`` counts. Nulls, comments and empty lines are no rules.
    """
    # One task, of at most MAX_RULES lines where the list was read by load_suffix_table.
    so_far = Window.orderBy(seq).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    marker = F.nullif(F.lower(F.regexp_extract(value, SECTION, 1)), F.lit(""))
    written = (
        lines.select(
            F.lower(F.regexp_extract(value, r"^\s*(\S+)", 1)).alias("written"),
            F.coalesce(F.last(marker, ignorenulls=True).over(so_far), F.lit(ICANN)).alias("section"),
        )
        .filter("written != '' AND NOT startswith(written, '//')")
        .select(
            F.expr(
                "CASE WHEN startswith(written, '*.') THEN 'wildcard' WHEN startswith(written, '!') THEN 'exception' "
                "ELSE 'plain' END"
            ).alias("kind"),
            F.regexp_replace("written", r"^(\*\.|!)", "").alias("name"),
            "section",
        )
    )
    both = F.explode(F.array_distinct(F.array("name", F.expr(ascii_host_sql("name")))))
    return (
        written.select(both.alias("rule"), "kind", "section")
        .groupBy("rule", "kind")
        .agg(F.min("section").alias("section"))
    )


def load_suffix_table(spark: SparkSession, path: str, most: int = MAX_RULES) -> DataFrame:
    """:func:`suffix_rules` of a list file. Rules go to every task, so a file of more than ``most`` lines is
    refused, not cut."""
    lines = numbered_lines(spark, path)
    if lines.limit(most + 1).count() > most:
        raise ValueError(f"{path} has more than {most} lines: not a suffix list")
    return F.broadcast(suffix_rules(lines))


def host_domains(
    rows: DataFrame, rules: DataFrame, host: str = "host", sections: Sequence[str] = (ICANN, PRIVATE)
) -> DataFrame:
    """(host, suffix, section, domain): each different host of ``rows`` once, without nulls.

    ``domain`` is the public suffix and one label, empty where the host is a suffix itself, a single label, or
    has an empty label; ``suffix`` is null for the latter two. An exception beats a longer match, a longer match a
    shorter one; without a match the last label is the suffix and ``section`` null. The host is taken as text:
    a port or an address is not treated apart.
    """
    hosts = rows.select(F.col(host).alias("host")).filter(F.col("host").isNotNull()).distinct()
    labels = F.size(F.split("host", "[.]"))
    valid = F.expr(f"contains(host, '.') AND NOT {matches('host', EMPTY_LABEL)}")
    # Endings are cut after the numbers are rows, so a host of many labels is no large array.
    endings = (
        hosts.withColumn("labels", labels)
        .select("host", "labels", F.explode(F.expr("sequence(1, labels)")).alias("size"))
        .withColumn("rule", F.expr("substring_index(host, '.', -size)"))
    )
    used = rules.filter(F.col("section").isin(list(sections)))
    # Size of the suffix that a rule stands for: one label more for a wildcard, one less for an exception.
    size = F.expr("size + CASE kind WHEN 'wildcard' THEN 1 WHEN 'exception' THEN -1 ELSE 0 END")
    rank = F.struct((F.col("kind") == "exception").alias("first"), size.alias("size"), "section")
    best = (
        endings.join(used, "rule", "left")
        .groupBy("host", "labels")
        .agg(F.max(F.when(F.col("kind").isNotNull() & (size <= F.col("labels")), rank)).alias("best"))
        .withColumn("size", F.coalesce("best.size", F.lit(1)))
    )
    return best.select(
        "host",
        F.when(valid, F.expr("substring_index(host, '.', -size)")).alias("suffix"),
        F.when(valid, F.col("best.section")).alias("section"),
        F.when(valid & (F.col("size") < F.col("labels")), F.expr("substring_index(host, '.', -(size + 1))"))
        .otherwise("")
        .alias("domain"),
    )


def attach_domain(
    rows: DataFrame, rules: DataFrame, host: str = "host", into: str = "domain", sections: Sequence[str] = (ICANN, PRIVATE)
) -> DataFrame:
    """``rows`` with the registered domain of a host: :func:`host_domains`, an address its own domain, null for
    a null host. A host may stand in any share of the rows."""
    table = host_domains(rows, rules, host, sections).select(F.col("host").alias(host), F.col("domain").alias("ws_domain"))
    found = lookup(rows, table, [host])
    domain = F.when(F.expr(is_ip_sql(f"`{host}`")), F.col(host)).otherwise(F.col("ws_domain"))
    return found.select(*[F.col(c) for c in rows.columns if c != into], domain.alias(into))


def filter_links(links: DataFrame, rules: DataFrame, url: str = "link") -> DataFrame:
    """:func:`webspark.operators.links.filter_links` by a table of rules."""
    hosts = links.filter(has_allowed_scheme(url)).withColumn("ws_host", F.expr(authority_host_sql(url)))
    no_port = hosts.filter(f"NOT {matches('ws_host', HOST_WITH_PORT)}")
    table = host_domains(no_port, rules, "ws_host").filter("domain != ''").select(F.col("host").alias("ws_host"))
    kept = lookup(no_port, table.withColumn("ws_kept", F.lit(True)), ["ws_host"])
    return kept.filter("ws_kept").select(*links.columns)
