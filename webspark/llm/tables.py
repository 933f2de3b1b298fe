"""Intermediate tables and small helpers of the operators."""

from __future__ import annotations

from functools import wraps
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import webspark
from webspark.sources.shared import fresh_path


def written(frame: DataFrame, name: str) -> DataFrame:
    """The frame as a table in the folder all executors share. It cuts the lineage: a lost executor
    costs the tasks in hand, not what came before."""
    path = fresh_path(frame.sparkSession, name)
    frame.write.parquet(path)
    return frame.sparkSession.read.schema(frame.schema).parquet(path)


def with_package(query):
    """The query, after telling Python workers where the package is, for sessions that were started from
    another folder without a PYTHONPATH. Where executors have the package installed, or where it was sent
    with the job, this changes nothing."""

    @wraps(query)
    def run(spark: SparkSession, *rest):
        root = str(Path(webspark.__file__).resolve().parents[1])
        known = spark.sparkContext.environment.get("PYTHONPATH", "")
        if root not in known.split(":"):
            spark.sparkContext.environment["PYTHONPATH"] = f"{root}:{known}".rstrip(":")
        return query(spark, *rest)

    return run


# Bits of a sieve: a bound of its size, whatever the number of keys.
SIEVE_BITS = 1 << 23


def sieved(frame: DataFrame, column: str, keys: DataFrame, key: str, bits: int = SIEVE_BITS) -> DataFrame:
    """The rows of ``frame`` whose ``column`` may be among ``keys``, to be joined with these afterwards.

    One hash of every key marks a bit. The marks are at most ``bits / 64`` rows of 64 bits, and are
    broadcast for that bound; rows without a mark go before a shuffle would carry them. Too many keys
    only let more rows pass. Rows with a null pass never, as in a join.
    """
    marks = (
        keys.select(F.pmod(F.xxhash64(F.col(key)), F.lit(bits)).alias("ws_at"))
        .groupBy(F.floor(F.col("ws_at") / 64).alias("ws_word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(ws_at % 64 as int)))").alias("ws_bits"))
    )
    at = F.pmod(F.xxhash64(F.col(column)), F.lit(bits))
    tested = frame.withColumn("ws_at", at).join(F.broadcast(marks), F.floor(F.col("ws_at") / 64) == F.col("ws_word"))
    return tested.where("(shiftrightunsigned(ws_bits, cast(ws_at % 64 as int)) & 1) = 1").select(*frame.columns)
