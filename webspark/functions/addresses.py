"""Network addresses as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from webspark.functions.binding import case, matches

# Textual forms of IPv4 and IPv6 addresses (RFC 4291 section 2.2), no zone.
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
IPV4 = rf"(?:{OCTET}\.){{3}}{OCTET}"
GROUP = r"[0-9A-Fa-f]{1,4}"
LAST32 = rf"(?:{GROUP}:{GROUP}|{IPV4})"
IPV6 = "|".join(
    [
        rf"(?:{GROUP}:){{6}}{LAST32}",
        rf"::(?:{GROUP}:){{0,5}}{LAST32}",
        *(
            rf"{GROUP}(?::{GROUP}){{{n}}}::(?:(?:{GROUP}:){{0,{4 - n}}}{LAST32}|{GROUP})?"
            for n in range(5)
        ),
        rf"{GROUP}(?::{GROUP}){{5}}::{GROUP}",
        rf"{GROUP}(?::{GROUP}){{5,6}}::",
        rf"::{GROUP}",
        "::",
    ]
)
IP = rf"^(?:{IPV4}|{IPV6})$"


def is_ip_sql(text: str) -> str:
    return f"({matches(text, '^[0-9A-Fa-f:][0-9A-Fa-f:.]*$')} AND {matches(text, IP)})"


def is_ip(text: str) -> Column:
    """True for the text of an IPv4 or IPv6 address."""
    return F.expr(is_ip_sql(text))


def ip_or_null(text: str) -> Column:
    """The address when the text is one, else null."""
    return F.expr(case((is_ip_sql(text), text)))
