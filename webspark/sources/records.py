"""Page records and resolution records: JSON, one record a line.

A line that does not parse goes to a second table instead of stopping the job.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from webspark.schemas import PAGE_RECORD, RESOLUTION
from webspark.sources.lines import numbered_lines, trimmed_lines

CORRUPT = "_corrupt_record"
LINE = "ws_line"

# Fixed value: default text form of a timestamp in page records, e.g.
# "2017-03-01 10:11:12.123456789 -0500 EST m=+0.001": date, time, fraction, offset, zone.
TIMESTAMP_TEXT = r"^(\d{4}-\d\d-\d\d) (\d\d:\d\d:\d\d)(\.\d{1,6})?\d* ([+-]\d\d)(\d\d)"


def parse_records(lines: DataFrame, schema: T.StructType, keep: Sequence[str] = ()) -> DataFrame:
    """One column per field of ``schema``, ``_corrupt_record``, which is not null when the line is not
    one JSON object of that form, ``ws_line``, the line as it was, and the columns of ``keep``, such as the number
    of a line. Works on streams too."""
    with_corrupt = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    options = {
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": CORRUPT,
        "allowSingleQuotes": "false",
    }
    # The parser stops at the end of the object; text after it shows in the line as a list of one.
    alone = F.json_array_length(F.concat(F.lit("["), "value", F.lit("]"))) == 1
    return (
        lines.select(*keep, F.col("value").alias(LINE), "value")
        .transform(trimmed_lines)
        .select(*keep, LINE, F.from_json("value", with_corrupt, options).alias("record"), alone.alias("ws_alone"))
        .select(
            *keep,
            *[f"record.{f.name}" for f in schema.fields],
            F.when(
                F.col(f"record.{CORRUPT}").isNotNull() | ~F.coalesce("ws_alone", F.lit(False)), F.col(LINE)
            ).alias(CORRUPT),
            LINE,
        )
    )


def judged_records(
    lines: DataFrame, schema: T.StructType, required: Column, keep: Sequence[str] = ()
) -> DataFrame:
    """The columns of :func:`parse_records`, ``_corrupt_record`` null exactly for records; ``required``
    must hold for a record. One table, so that a sink that splits it parses once."""
    parsed = parse_records(lines, schema, keep)
    good = F.col(CORRUPT).isNull() & F.coalesce(required, F.lit(False))
    return parsed.withColumn(CORRUPT, F.when(~good, F.col(LINE)))


def split_records(judged: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(records, lines that are none, as they were)."""
    ok = judged.filter(F.col(CORRUPT).isNull()).drop(CORRUPT, LINE)
    return ok, judged.filter(F.col(CORRUPT).isNotNull()).select(F.col(CORRUPT).alias("line"))


def judged_page_records(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """:func:`judged_records` of page records. A record without ``Data`` is a bad line."""
    return judged_records(lines, PAGE_RECORD, F.col("Data.Url").isNotNull(), keep)


def judged_resolutions(lines: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """:func:`judged_records` of resolutions. An empty address reads as null."""
    judged = judged_records(lines, RESOLUTION, F.col("Url").isNotNull(), keep)
    return judged.withColumn("IP", F.nullif(F.col("IP"), F.lit("")))


def read_page_records(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(page records, bad lines). Whoever needs both should write :func:`judged_page_records` and split
    that."""
    return split_records(judged_page_records(spark.read.text(path)))


def read_resolutions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(resolution records, bad lines)."""
    return split_records(judged_resolutions(spark.read.text(path)))


def read_numbered_page_records(spark: SparkSession, path: str) -> DataFrame:
    """:func:`judged_page_records` with ``seq``, the number of each line in the input: the order in which
    :func:`webspark.operators.frontier.import_pages` applies records."""
    return judged_page_records(numbered_lines(spark, path), keep=["seq"])


def read_numbered_resolutions(spark: SparkSession, path: str) -> DataFrame:
    """:func:`judged_resolutions` with ``seq``, for :func:`webspark.operators.frontier.import_resolutions`."""
    return judged_resolutions(numbered_lines(spark, path), keep=["seq"])


def to_json_lines(records: DataFrame) -> DataFrame:
    """(value): every row as one JSON text, null fields written out."""
    return records.select(
        F.to_json(F.struct(*[F.col(c) for c in records.columns]), {"ignoreNullFields": "false"}).alias(
            "value"
        )
    )


def write_records(records: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """JSON lines. Page and resolution records keep their capitalised field names."""
    to_json_lines(records).write.mode(mode).text(path)


def record_time(text: Column | str) -> Column:
    """Timestamp of a record's ``Timestamp`` text, cut to microseconds; null when it is none."""
    t = F.col(text) if isinstance(text, str) else text
    iso = F.regexp_replace(t, TIMESTAMP_TEXT + ".*$", r"$1T$2$3$4:$5")
    return F.when(F.regexp_like(t, F.lit(TIMESTAMP_TEXT)), iso.try_cast("timestamp"))
