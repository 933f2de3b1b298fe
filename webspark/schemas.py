"""Fixed schemas of the records; nothing is ever inferred. Field names of the JSON records are part
of the exchange format, so they keep their capitals."""

from __future__ import annotations

from pyspark.sql import types as T

_HEADERS = T.MapType(T.StringType(), T.ArrayType(T.StringType()))

PAGE_DATA = T.StructType(
    [
        T.StructField("Url", T.StringType()),
        T.StructField("Body", T.StringType()),
        T.StructField("Timestamp", T.StringType()),
        T.StructField("Status", T.StringType()),
        T.StructField("StatusCode", T.IntegerType()),
        T.StructField("Proto", T.StringType()),
        T.StructField("Header", _HEADERS),
        T.StructField("Trailer", _HEADERS),
    ]
)

PAGE_RECORD = T.StructType(
    [
        T.StructField("Data", PAGE_DATA),
        T.StructField("Success", T.BooleanType()),
        T.StructField("Message", T.StringType()),
        T.StructField("Links", T.ArrayType(T.StringType())),
    ]
)

RESOLUTION = T.StructType(
    [
        T.StructField("Url", T.StringType()),
        T.StructField("IP", T.StringType()),
        T.StructField("Cname", T.StringType()),
        T.StructField("Message", T.StringType()),
    ]
)

FRONTIER = T.StructType(
    [
        T.StructField("id", T.LongType()),
        T.StructField("url", T.StringType()),
        T.StructField("visited", T.BooleanType()),
        T.StructField("tld", T.StringType()),
        T.StructField("queued_at", T.TimestampType()),
        T.StructField("success", T.BooleanType()),
        T.StructField("message", T.StringType()),
        T.StructField("ip", T.StringType()),
        T.StructField("cname", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("updated_at", T.TimestampType()),
        T.StructField("deleted_at", T.TimestampType()),
    ]
)

DNS = T.StructType(
    [
        T.StructField("host", T.StringType()),
        T.StructField("ips", T.ArrayType(T.StringType())),
        T.StructField("cname", T.StringType()),
        T.StructField("observed_at", T.TimestampType()),
        T.StructField("error", T.StringType()),
    ]
)

ROBOTS_RULES = T.StructType(
    [
        T.StructField("site", T.StringType()),
        T.StructField("agent", T.StringType()),
        T.StructField("pattern", T.StringType()),
        T.StructField("allow", T.BooleanType()),
    ]
)
