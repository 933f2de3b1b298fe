"""Lookup join for keys of very uneven weight."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lookup(rows: DataFrame, table: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join of ``rows`` with a ``table`` that has at most one row per key.

    One key may hold a large share of ``rows``. The adaptive skew join splits it, but only when both
    sides come straight from an exchange, and a table that was aggregated by its key is already
    partitioned by it and gets none. Joining on a digest of the key as well makes the optimizer
    exchange the table, the small side, once more. The table is broadcast only when its measured
    size is below the optimizer's threshold.
    """
    digest = F.xxhash64(*keys)
    return (
        rows.withColumn("ws_digest", digest)
        .join(table.withColumn("ws_digest", digest), ["ws_digest", *keys], "left")
        .drop("ws_digest")
    )
