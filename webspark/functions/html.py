"""Anchors of an HTML text, found with one pass of a tokenising pattern.

The pattern follows the tokeniser of the HTML standard as far as links need it: comments, elements
whose content is text, quoted attribute values and tags cut off by the end of the text each match
as one token, so an ``<a href>`` inside any of them is not taken for markup. Every repetition is
possessive: matching is linear and never recurses on long tags.
"""

from __future__ import annotations

from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

from webspark.functions.binding import case, each, lit, matches, sub, tokens

# Elements whose content is text up to their end tag, and the attribute grammar.
TEXT_ELEMENTS = "script|style|textarea|title|xmp|iframe|noembed|noframes|noscript"
SPACE = r"[\t\n\f\r ]"
NAME = r"(?:=[^\t\n\f\r />=]*+|[^\t\n\f\r />=]++)"
VALUE = r"""(?:"[^"]*+"|'[^']*+'|[^\t\n\f\r >"'][^\t\n\f\r >]*+|["'].*+)"""
ATTRIBUTE = rf"(?:{NAME}(?:{SPACE}*+={SPACE}*+{VALUE}?+)?+)"
SEPARATOR = r"[\t\n\f\r /]++"
HREF = rf"href(?=[\t\n\f\r />=])(?:{SPACE}*+={SPACE}*+{VALUE}?+)?+"
HREF_VALUE = rf"""(?is)^href{SPACE}*+=?+{SPACE}*+(?:"(.*)"|'(.*)'|(.*))$"""
ATTRIBUTES = rf"(?:{SEPARATOR}|{ATTRIBUTE})*+"
ATTRIBUTES_BEFORE_HREF = rf"(?:{SEPARATOR}|(?!{HREF}){ATTRIBUTE})*+"

TOKEN = (
    r"(?is)<(?:"
    r"!--(?:-?>|.*?(?:--!?>|\z))"
    r"|[!?][^>]*+(?:>|\z)"
    r"|/(?![a-z])[^>]*+(?:>|\z)"
    rf"|a(?=[\t\n\f\r /])(?:{ATTRIBUTES_BEFORE_HREF})({HREF}){ATTRIBUTES}>"
    rf"|({TEXT_ELEMENTS})(?=[\t\n\f\r />]){ATTRIBUTES}>.*?(?:</\2(?=[\t\n\f\r />])|\z)"
    r"|plaintext(?=[\t\n\f\r />]).*+"
    rf"|/?[a-z][^\t\n\f\r />]*+{ATTRIBUTES}(?:>|\z)"
    r")"
)

# What the numeric references 128 to 159 stand for (windows-1252).
WINDOWS_1252 = [bytes([n]).decode("cp1252", "replace") for n in range(128, 160)]
C1 = [w if w != "\ufffd" else chr(128 + i) for i, w in enumerate(WINDOWS_1252)]

REFERENCE = (
    r"(?s)(&#[xX][0-9A-Fa-f]++;?+|&#[0-9]++;?+|&[A-Za-z][A-Za-z0-9]*+(?:;|(?!=))|&|[^&]++)"
)


def _character(code: str) -> str:
    """Character of a numeric reference; codes that stand for none give the replacement mark."""
    return case(
        (
            f"{code} IS NULL OR {code} = 0 OR {code} > 1114111 OR {code} BETWEEN 55296 AND 57343",
            "'\ufffd'",
        ),
        (f"{code} BETWEEN 128 AND 159", f"substr({lit(''.join(C1))}, cast({code} - 127 AS int), 1)"),
        default=f"decode(unhex(lpad(hex({code}), 8, '0')), 'UTF-32')",
    )


def decode_entities_sql(text: str) -> str:
    # The name table of the HTML standard as one literal: name, unit separator, text, and so on.
    table = "\x1e".join(f"{name}\x1f{html5[name]}" for name in sorted(html5))
    names = f"str_to_map({lit(table)}, {lit(chr(0x1E))}, {lit(chr(0x1F))})"
    digits = sub("ws_x", "[&#xX;]", "")
    # More than eight hexadecimal digits are no character, nor a number conv takes.
    number = case(
        (f"NOT {matches('ws_x', '^&#[xX]')}", f"try_cast({digits} AS bigint)"),
        (
            f"length(trim(LEADING '0' FROM {digits})) <= 8",
            f"try_cast(conv({digits}, 16, 10) AS bigint)",
        ),
    )
    decoded = case(
        ("ws_x = '&' OR NOT startswith(ws_x, '&')", "ws_x"),
        ("ws_x IN ('&amp;', '&amp', '&AMP;', '&AMP')", "'&'"),
        ("startswith(ws_x, '&#')", _character(number)),
        default=f"coalesce(try_element_at({names}, substr(ws_x, 2)), ws_x)",
    )
    return case(
        (
            f"contains({text}, '&')",
            f"array_join(transform({tokens(text, REFERENCE)}, ws_x -> {decoded}), '')",
        ),
        default=text,
    )


def decode_entities(text: str) -> Column:
    """Character references of an attribute value replaced by what they stand for.

    A name without its semicolon counts only when it is one of the old names and no ``=`` follows,
    so ``?a=1&copy=2`` keeps its text.
    """
    return F.expr(decode_entities_sql(text))


def anchor_hrefs_sql(html: str) -> str:
    tags = f"filter({tokens(html, TOKEN)}, ws_t -> ws_t != '')"
    values = each(tags, "ws_t", lambda t: sub(t, HREF_VALUE, "$1$2$3"))
    return each(values, "ws_v", decode_entities_sql)


def anchor_hrefs(html: str) -> Column:
    """Array of the decoded ``href`` values of all anchors of an HTML text, in document order.

    The first ``href`` of a tag counts; an empty or missing value is an empty text. The array is
    null for a null text.
    """
    return F.expr(anchor_hrefs_sql(html))
