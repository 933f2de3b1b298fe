"""Page records made from bodies that are already there: success, failure and the body limit."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from webspark.functions.binding import case, let
from webspark.schemas import PAGE_RECORD

# Fields of records as the fetcher writes them.
FAILED_STATUS_CODE = -1
FAILED_PREFIX = "failed: "
STATUS_TEXT = {200: "200 OK"}
PROTOCOL = "HTTP/1.1"


def _record(data: Column, success: bool, message: Column) -> list[Column]:
    return [
        data.cast(PAGE_RECORD["Data"].dataType).alias("Data"),
        F.lit(success).alias("Success"),
        message.alias("Message"),
        F.lit(None).cast(PAGE_RECORD["Links"].dataType).alias("Links"),
    ]


def to_page_records(
    pages: DataFrame,
    fetched_at: Column | str,
    url: str = "url",
    html: str = "html",
    status: int = 200,
) -> DataFrame:
    """Successful page records of a table of bodies. ``fetched_at`` is the text of the time."""
    headers = PAGE_RECORD["Data"].dataType["Header"].dataType
    data = F.struct(
        F.col(url).alias("Url"),
        F.col(html).alias("Body"),
        (F.col(fetched_at) if isinstance(fetched_at, str) else fetched_at).alias("Timestamp"),
        F.lit(STATUS_TEXT.get(status, str(status))).alias("Status"),
        F.lit(status).alias("StatusCode"),
        F.lit(PROTOCOL).alias("Proto"),
        F.create_map().cast(headers).alias("Header"),
        F.create_map().cast(headers).alias("Trailer"),
    )
    return pages.select(*_record(data, True, F.lit("")))


def failed_columns(
    reason: Column | str, failed_at: Column | None = None, url: str = "url"
) -> list[Column]:
    """The fields of :func:`failed_records`."""
    headers = PAGE_RECORD["Data"].dataType["Header"].dataType
    why = F.lit(reason) if isinstance(reason, str) else reason
    data = F.struct(
        F.col(url).alias("Url"),
        F.lit("").alias("Body"),
        (F.lit(None) if failed_at is None else failed_at).cast("string").alias("Timestamp"),
        F.lit("").alias("Status"),
        F.lit(FAILED_STATUS_CODE).alias("StatusCode"),
        F.lit("").alias("Proto"),
        F.lit(None).cast(headers).alias("Header"),
        F.lit(None).cast(headers).alias("Trailer"),
    )
    return _record(data, False, F.concat(F.lit(FAILED_PREFIX), why))


def failed_records(
    requests: DataFrame,
    reason: Column | str,
    failed_at: Column | None = None,
    url: str = "url",
) -> DataFrame:
    """Failed page records: empty body, status code -1, no headers, ``failed: `` and the reason.

    A text ``reason`` is the reason of all rows.
    """
    return requests.select(*failed_columns(reason, failed_at, url))


def limit_body(pages: DataFrame, n: int, html: str = "html") -> DataFrame:
    """Bodies cut to their first ``n`` bytes; ``n`` of 0 or less is no limit. Of a character that the
    cut splits, every byte left becomes a replacement mark."""
    if n <= 0:
        return pages
    cut = f"cast(substring(encode({html}, 'UTF-8'), 1, {n}) AS string)"
    whole = let(
        f"make_valid_utf8({cut})", "ws_v", lambda v: f"substr({v}, 1, length({v}) - 1)"
    )
    split = let(
        whole, "ws_w", lambda w: f"concat({w}, repeat('\ufffd', {n} - octet_length({w})))"
    )
    body = case(
        (f"octet_length({html}) <= {n}", html), (f"is_valid_utf8({cut})", cut), default=split
    )
    return pages.withColumn(html, F.expr(body))
