"""Building blocks of SQL expression text.

Deep expressions are put together as SQL text and parsed once. Built call by call through the
Column API they cost thousands of round trips to the JVM, seconds before a query even starts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def lit(text: str) -> str:
    """SQL literal of a text."""
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def let(value: str, name: str, body: Callable[[str], str]) -> str:
    """Hand ``value`` to ``body`` as the variable ``name``, computed once per row.

    URL expressions use each intermediate text several times; written inline, every use would
    repeat the whole sub-expression and the text would grow exponentially with the nesting. The
    lambda variable of ``transform`` over a one-element array is the variable SQL lacks, and it
    works inside other lambdas, where staged ``select`` steps cannot.
    """
    return f"transform(array({value}), {name} -> {body(name)})[0]"


def each(array: str, name: str, body: Callable[[str], str]) -> str:
    """``body`` of every element of ``array``, which goes by ``name``."""
    return f"transform({array}, {name} -> {body(name)})"


def not_null(array: str) -> str:
    return f"filter({array}, ws_e -> ws_e IS NOT NULL)"


def case(*branches: tuple[str, str], default: str = "NULL") -> str:
    """``CASE`` over (condition, value) pairs."""
    whens = " ".join(f"WHEN {condition} THEN {value}" for condition, value in branches)
    return f"(CASE {whens} ELSE {default} END)"


def matches(text: str, pattern: str) -> str:
    return f"rlike({text}, {lit(pattern)})"


def group(text: str, pattern: str, n: int = 1) -> str:
    """Group ``n`` of the first match, empty without a match."""
    return f"regexp_extract({text}, {lit(pattern)}, {n})"


def tokens(text: str, pattern: str) -> str:
    """Array of group 1 of all matches."""
    return f"regexp_extract_all({text}, {lit(pattern)}, 1)"


def sub(text: str, pattern: str, replacement: str) -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(replacement)})"


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def tidy_lines(text: str, meant: str) -> str:
    """Text of the lines that match ``meant``, comments and surrounding space removed, each with a
    line end."""
    line = "trim(BOTH ' \\t\\r\\n\\f' FROM regexp_replace(ws_line, '#.*$', ''))"
    lines = f"transform(split({text}, '\\\\r\\\\n|\\\\r|\\\\n'), ws_line -> {line})"
    kept = f"filter({lines}, ws_line -> {matches('ws_line', meant)})"
    spaced = each(kept, "ws_line", lambda x: f"concat({sub(x, '^([A-Za-z-]+)[ ]*:', '$1:')}, '\\n')")
    return f"array_join({spaced}, '')"


def present(value: str, name: str) -> Column:
    """Generator of the rows whose ``value`` is neither null nor empty, as column ``name``.

    A filter on a computed column is pushed below the projection and computes the column a second
    time; exploding an array of one or no element computes it once.
    """
    return F.expr(f"explode(filter(array({value}), ws_e -> ws_e != ''))").alias(name)
