"""A filter over the stored URLs that says of a URL whether it may be there: never a wrong no.

The filter is a table of bit blocks of one fixed size, ``(block, bits)``. A URL belongs to one block and sets
:data:`PROBES` bits of it, so a batch is tested by an equi-join on the block; no bitmap passes through the
driver or one task. The number of blocks is a power of two that grows with the URLs, so the share of wrong
answers stays bounded, whatever the size of the frontier. Blocks are made by an aggregate that combines
inside each task, and two filters of one size are merged by the union of their bits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Bits of a block, the size of Spark's bitmaps, and as a power of two.
BLOCK_BITS, BLOCK_POWER = 1 << 15, 15
PROBES = 4
# At least this many bits a URL: at most some 0.9 % of unknown URLs are taken for known ones.
BITS_PER_URL = 11
SCHEMA = "block INT, bits BINARY"


def blocks_for(urls: int) -> int:
    """Blocks of a filter of so many URLs: a power of two, so that most compactions merge."""
    need = max(1, -(-urls * BITS_PER_URL // BLOCK_BITS))
    return 1 << (need - 1).bit_length()


def block_of(url: str, blocks: int) -> Column:
    return F.pmod(F.xxhash64(F.col(url)), F.lit(blocks)).cast("int")


def _positions(url: str) -> list[Column]:
    """Bit positions of a URL within its block: pieces of a second hash."""
    bits = F.xxhash64(F.lit("bits"), F.col(url))
    return [F.shiftrightunsigned(bits, BLOCK_POWER * k).bitwiseAND(F.lit(BLOCK_BITS - 1)) for k in range(PROBES)]


def build_filter(urls: DataFrame, blocks: int, url: str = "url") -> DataFrame:
    """(block, bits) of all URLs; blocks without a URL have no row."""
    return (
        urls.filter(F.col(url).isNotNull())
        .select(block_of(url, blocks).alias("block"), F.explode(F.array(*_positions(url))).alias("ws_bit"))
        .groupBy("block")
        .agg(F.bitmap_construct_agg("ws_bit").alias("bits"))
    )


def merge_filters(one: DataFrame, other: DataFrame) -> DataFrame:
    """The filter of the URLs of both; both must have the same number of blocks."""
    return one.unionByName(other).groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits"))


def _is_set(position: Column) -> Column:
    byte = F.conv(F.hex(F.substring("bits", (position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.getbit(byte, (position % 8).cast("int")) == 1


def probe(batch: DataFrame, table: DataFrame, blocks: int, url: str = "url") -> DataFrame:
    """``batch`` with ``ws_maybe``: false where the URL is certainly not among those of the filter."""
    every = F.lit(True)
    for position in _positions(url):
        every = every & _is_set(position)
    return (
        batch.withColumn("block", block_of(url, blocks))
        .join(table, "block", "left")
        .withColumn("ws_maybe", F.col("bits").isNotNull() & F.coalesce(every, F.lit(False)))
        .drop("block", "bits")
    )
