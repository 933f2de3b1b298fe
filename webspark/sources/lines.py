"""URL lists and fetch hints: text files with one item a line, with the numbers of lines where order counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from webspark.functions.addresses import is_ip
from webspark.sources.shared import fresh_path

# Characters trimmed from both ends of a line.
TRIMMED = r"'\n \t\r'"


def trimmed_lines(lines: DataFrame, value: str = "value") -> DataFrame:
    """Lines without surrounding white space; empty ones dropped. Works on streams too."""
    return lines.withColumn(value, F.expr(f"trim(BOTH {TRIMMED} FROM {value})")).filter(
        F.col(value) != ""
    )


def read_url_list(spark: SparkSession, path: str) -> DataFrame:
    """(url): one row per non-empty line, a last line without line end included."""
    return trimmed_lines(spark.read.text(path)).withColumnRenamed("value", "url")


def write_url_list(urls: DataFrame, path: str, url: str = "url", mode: str = "errorifexists") -> None:
    """One URL a line."""
    urls.select(url).write.mode(mode).text(path)


def parse_fetch_hints(lines: DataFrame, value: str = "value") -> DataFrame:
    """(url, ip) of fetch requests: two fields apart by one tab are URL and address, any other line
    is a URL as a whole. A text that is no address gives a null ip."""
    line = F.col(value)
    fields = F.split(line, "\t")
    two = F.size(fields) == 2
    hint: Column = fields[1]
    return (
        lines.withColumn("url", F.when(two, fields[0]).otherwise(line))
        .withColumn("ip", F.when(two, hint))
        .withColumn("ip", F.when(is_ip("ip"), F.col("ip")))
    )


def read_queue_lines(spark: SparkSession, path: str) -> DataFrame:
    """(value): lines ``id<TAB>url<TAB>ip``. Tabs are kept, as the last field may be empty."""
    return spark.read.text(path).filter(F.trim("value") != "")


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(seq, value): all lines of the files under ``path`` with gapless numbers from 0 in the order of the
    input: files by their full path (code points), lines as they stand. Empty lines count.

    A line's number is the lines of the files before its own, of the parts of its file before its own, and
    before it in its part. The lines are written to the shared folder with their place in the part, once, so
    that counts and lines are of the same reading, whatever executors come and go; only a row per part of a
    file (some 128 MB of it) is numbered, and a row per file in one task.
    """
    placed = fresh_path(spark, "lines")
    # Ids rise by one along the rows of a task, which reads a part from its start to its end.
    spark.read.text(path).select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("start"),
        F.monotonically_increasing_id().alias("place"),
        "value",
    ).write.parquet(placed)
    lines = spark.read.schema("file STRING, start BIGINT, place BIGINT, value STRING").parquet(placed)
    parts = lines.groupBy("file", "start").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("lines"))
    files = parts.groupBy("file").agg(F.sum("lines").alias("lines"))

    def before(*keys: str, order: str) -> Column:
        window = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum("lines").over(window), F.lit(0))

    of_file = files.select("file", before(order="file").alias("ws_files"))
    of_part = parts.select("file", "start", "first", before("file", order="start").alias("ws_parts")).join(of_file, "file")
    offsets = of_part.select("file", "start", (F.col("ws_files") + F.col("ws_parts") - F.col("first")).alias("ws_offset"))
    return lines.join(offsets, ["file", "start"]).select((F.col("place") + F.col("ws_offset")).alias("seq"), "value")


def read_numbered_urls(spark: SparkSession, path: str) -> DataFrame:
    """(seq, url): :func:`read_url_list` with the number of each line; numbers of empty lines are left out."""
    return trimmed_lines(numbered_lines(spark, path)).withColumnRenamed("value", "url")


def read_fetch_hints(spark: SparkSession, path: str) -> DataFrame:
    """(seq, url, ip): fetch requests of a list, in the order that runs and politeness plans take."""
    return parse_fetch_hints(trimmed_lines(numbered_lines(spark, path))).select("seq", "url", "ip")
