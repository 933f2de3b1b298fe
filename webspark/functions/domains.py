"""Registered domain of a host: public suffix plus one label.

The rule set is a published list of some ten thousand lines, so its size is bounded and it travels
inside the expression as literal sets (hash lookups). No table is joined and nothing is shuffled,
however many hosts there are.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from webspark.functions.addresses import is_ip_sql
from webspark.functions.binding import case, let, lit, matches, sub
from webspark.functions.urls import url_host_sql

# Rules used when no list is given; every other suffix falls under the default rule
# (the last label is the public suffix).
BUILT_IN_RULES = """
com
net
org
edu
gov
co.uk
org.uk
ac.uk
gov.uk
com.au
net.au
org.au
co.nz
co.jp
ne.jp
or.jp
ac.jp
com.br
com.cn
co.in
co.za
*.ck
!www.ck
"""

MAX_RULES = 100_000


@dataclass(frozen=True)
class SuffixRules:
    """Plain suffixes, parents of wildcard rules (``ck`` for ``*.ck``) and exceptions."""

    plain: frozenset[str] = field(default_factory=frozenset)
    wildcard: frozenset[str] = field(default_factory=frozenset)
    exception: frozenset[str] = field(default_factory=frozenset)

    @staticmethod
    def parse(lines: Iterable[str]) -> SuffixRules:
        """Lines of the published format: one rule a line, ``//`` starts a comment line."""
        rules = [line.split()[0].lower() for line in lines if line.split()]
        rules = [r for r in rules if not r.startswith("//")]
        return SuffixRules(
            plain=frozenset(r for r in rules if r[0] not in "*!"),
            wildcard=frozenset(r[2:] for r in rules if r.startswith("*.")),
            exception=frozenset(r[1:] for r in rules if r.startswith("!")),
        )


BUILT_IN = SuffixRules.parse(BUILT_IN_RULES.splitlines())


def load_suffix_rules(
    source: SparkSession | DataFrame, path: str | None = None, most: int = MAX_RULES
) -> SuffixRules:
    """Rules of a suffix list: a text file, or a table whose first column has a line per row.

    The published list is not part of the library; :data:`BUILT_IN` knows a few suffixes only, and takes
    the last label of any other host as its suffix. Rules are literals of every expression that uses
    them, so a list of more than ``most`` lines is refused, not cut.
    """
    table = source if isinstance(source, DataFrame) else source.read.text(path)
    lines = table.limit(most + 1).collect()
    if len(lines) > most:
        raise ValueError(f"{path or 'the table'} has more than {most} lines: not a suffix list")
    return SuffixRules.parse(r[0] or "" for r in lines)


def _in(text: str, values: frozenset[str]) -> str:
    return f"{text} IN ({', '.join(lit(v) for v in sorted(values))})" if values else "false"


def _parent(suffix: str) -> str:
    """The text after the first label."""
    return sub(suffix, r"^[^.]*\.?", "")


EMPTY_LABEL = r"^\.|\.$|\.\.|^$"


def effective_domain_sql(host: str, rules: SuffixRules = BUILT_IN) -> str:
    """Public suffix of ``host`` plus one label, empty when there is none.

    An exception rule beats a longer match, which beats a shorter one; without a match the last
    label is the suffix. The host is taken as text: a port or an address is not treated apart.
    """
    labels = f"size(split({host}, '[.]'))"
    suffixes = f"transform(sequence({labels}, 1, -1), ws_k -> substring_index({host}, '.', -ws_k))"

    def pick(sufs: str) -> str:
        excepted = f"filter({sufs}, ws_s -> {_in('ws_s', rules.exception)})"
        public = (
            f"filter({sufs}, ws_s -> {_in('ws_s', rules.plain)} "
            f"OR {_in(_parent('ws_s'), rules.wildcard)})"
        )
        return (
            f"coalesce({_parent(f'try_element_at({excepted}, 1)')}, "
            f"try_element_at({public}, 1), substring_index({host}, '.', -1))"
        )

    def domain(suffix: str) -> str:
        return case(
            (f"{suffix} = {host}", "''"),
            default=f"substring_index({host}, '.', -(size(split({suffix}, '[.]')) + 1))",
        )

    return case(
        (f"{matches(host, EMPTY_LABEL)} OR NOT contains({host}, '.')", "''"),
        default=let(let(suffixes, "ws_sufs", pick), "ws_suffix", domain),
    )


def registered_domain_sql(host: str, rules: SuffixRules = BUILT_IN) -> str:
    return let(
        host,
        "ws_h",
        lambda h: case(
            (f"{h} IS NULL", "NULL"), (is_ip_sql(h), h), default=effective_domain_sql(h, rules)
        ),
    )


def registered_domain(host: str, rules: SuffixRules = BUILT_IN) -> Column:
    """Public suffix of a host plus one label, empty when there is none; an address literal is its
    own domain; a null host gives null."""
    return F.expr(registered_domain_sql(host, rules))


def url_domain(url: str, rules: SuffixRules = BUILT_IN) -> Column:
    """:func:`registered_domain` of the host of a URL."""
    return F.expr(registered_domain_sql(url_host_sql(url), rules))


def has_domain_sql(host: str, rules: SuffixRules = BUILT_IN) -> str:
    """Host has a registrable domain; false for empty hosts, single labels and bare suffixes."""
    is_suffix = (
        f"({_in(host, rules.plain)} OR ({_in(_parent(host), rules.wildcard)} "
        f"AND NOT {_in(host, rules.exception)}))"
    )
    return f"(contains({host}, '.') AND NOT {matches(host, EMPTY_LABEL)} AND NOT {is_suffix})"


def has_domain(host: str, rules: SuffixRules = BUILT_IN) -> Column:
    """Host has a registrable domain; false for empty hosts, single labels and bare suffixes."""
    return F.expr(has_domain_sql(host, rules))
