"""The operators as Structured Streaming jobs.

Links need no state (a page's links are one array in its row), the frontier takes micro-batches
through ``foreachBatch`` with labelled commits, and what needs state bounds it with a watermark.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from datetime import datetime

from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter, StatefulProcessor
from pyspark.sql.types import LongType, StringType, StructField, StructType

from webspark.functions.domains import BUILT_IN, SuffixRules
from webspark.functions.urls import url_hostname
from webspark.operators.frontier import import_links, import_pages, import_resolutions, mark_queued
from webspark.operators.hosts import address_key
from webspark.operators.links import extract_links
from webspark.operators.resolution import TTL_SECONDS
from webspark.sources.frontier_store import FrontierStore

# Fixed value: seconds between two statistics.
STATS_INTERVAL = "3 seconds"

SLICES_PER_TTL = 4
# A host's state is kept by periods of so many TTLs.
TTLS_PER_PERIOD = 4

# Rows that go to a list of the state in one call.
LOT = 1000

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
MAPS = "HDFSBackedStateStoreProvider"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"

_ANSWER = StructType(
    [*(StructField(c, StringType()) for c in ("request", "ip", "cname")), StructField("seen", LongType())]
)

# Times keep their microseconds and, where they are moments, the offset that makes them one.
JSON_TIMES = {
    "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX",
    "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS",
}


def stream_extract(
    pages: DataFrame,
    url: str = "url",
    html: str = "html",
    root: bool = False,
    rules: SuffixRules = BUILT_IN,
) -> DataFrame:
    """(url, link) of a stream of pages; stateless, for append mode."""
    return extract_links(pages, url, html, root, rules)


def stream_dedup(
    links: DataFrame, event_time: str, link: str = "link", keep: str = "1 hour"
) -> DataFrame:
    """Links not seen within ``keep``. State is one digest per link; it is a prefilter that spares
    the frontier work, exact dedup stays with the frontier."""
    return (
        links.withColumn("url_md5", F.md5(link))
        .withWatermark(event_time, keep)
        .dropDuplicatesWithinWatermark(["url_md5"])
        .drop("url_md5")
    )


def stream_stats(
    requests: DataFrame,
    event_time: str,
    ip: str = "ip",
    every: str = "1 hour",
    late: str = "10 minutes",
) -> DataFrame:
    """(since, address, pending): requests of each address per interval, for update or append mode. State
    is a count for each address of the intervals that the watermark has not passed. Requests without a
    time are in no interval."""
    since = F.window(event_time, every)["start"].alias("since")
    return (
        requests.withWatermark(event_time, late)
        .groupBy(since, address_key(ip).alias("address"))
        .agg(F.count(F.lit(1)).alias("pending"))
    )


def start_stats(requests: DataFrame, event_time: str, ip: str = "ip", **options: str) -> DataStreamWriter:
    """:func:`stream_stats` in update mode, every three seconds; add a sink and start it."""
    return (
        stream_stats(requests, event_time, ip, **options)
        .writeStream.outputMode("update")
        .trigger(processingTime=STATS_INTERVAL)
    )


def keep_state_in_rocksdb(spark: SparkSession) -> None:
    """Lets streams that start from now on keep their state in RocksDB, as state with lists and timers needs;
    a setting of the session's own for the provider stays. Running streams, and restarts from a checkpoint,
    keep the provider they began with."""
    if spark.conf.get(PROVIDER, MAPS).endswith(MAPS):
        spark.conf.set(PROVIDER, ROCKSDB)
        spark.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")


def _address_server(width: int, period: int, ttl: int) -> StatefulProcessor:
    """The state of a host's period: its requests and the observations that reach it, as lists that are
    appended to. A timer at the end of a slice that has requests hands out those that the watermark has
    passed and is set anew for the others; the one at the end of the period drops the state."""

    answer = Row(*_ANSWER.names)
    asking = StructType([StructField("at", LongType()), StructField("request", StringType())])
    seen = StructType([StructField("seen", LongType()), *_ANSWER.fields[1:3]])

    # Nested, so that workers get it with the plan and need no module.
    def rank(observation: tuple) -> tuple:
        return observation[0], observation[1] or ""

    def end_of_slice(at: int) -> int:
        return (at // width + 1) * width

    # First watermark, in milliseconds, that has passed all before a time.
    def passes(end: int) -> int:
        return end // 1000 + 1

    class Server(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.asks = handle.getListState("asks", asking)
            self.found = handle.getListState("found", seen)

        def handleInputRows(self, key, rows, timerValues):
            if key[1] is None:  # requests without a time
                for row in rows:
                    if row["request"] is not None:
                        yield answer(row["request"], None, None, None)
                return
            start = key[1] * period
            asks, found, before, due = [], [], None, start + period
            for row in rows:
                if row["request"] is not None:
                    due = min(due, end_of_slice(row["micros"]))
                    asks.append((row["micros"], row["request"]))
                    if len(asks) == LOT:
                        self.asks.appendList(asks)
                        asks = []
                elif row["micros"] >= start:
                    found.append((row["micros"], row["ip"], row["cname"]))
                    if len(found) == LOT:
                        self.found.appendList(found)
                        found = []
                else:
                    one = (row["micros"], row["ip"], row["cname"])
                    before = one if before is None else max(before, one, key=rank)
            if before is not None:
                found.append(before)
            if asks:
                self.asks.appendList(asks)
            if found:
                self.found.appendList(found)
            self.handle.registerTimer(passes(due))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            end = (key[1] + 1) * period
            watermark = timerValues.getCurrentWatermarkInMs()
            found, times, rest, due = None, [], [], end
            for at, asked in self.asks.get():
                if at >= watermark * 1000:
                    rest.append((at, asked))
                    due = min(due, end_of_slice(at))
                    continue
                if found is None:
                    found = sorted(self.found.get(), key=rank)
                    times = [o[0] for o in found]
                place = bisect_right(times, at)
                if place and times[place - 1] >= at - ttl:
                    moment, ip, cname = found[place - 1]
                    yield answer(asked, ip, cname, moment)
                else:
                    yield answer(asked, None, None, None)
            if found is not None:  # some are answered
                self.asks.clear()
                for k in range(0, len(rest), LOT):
                    self.asks.appendList(rest[k : k + LOT])
            if passes(end) <= watermark:
                self.found.clear()
            else:
                self.handle.registerTimer(passes(due))

    return Server()


def stream_address(
    requests: DataFrame,
    observations: DataFrame,
    asked_at: str,
    url: str = "url",
    ttl_seconds: int = TTL_SECONDS,
    late: str = "10 minutes",
) -> DataFrame:
    """(request columns, ip, cname, observed_at): every request once, with the newest observation at or
    before its time and within the TTL, or three nulls.

    State is kept per host and period of four TTLs, so a busy host's state is spread over its periods and an
    observation is handed to two of them at most, one and a quarter on average; of those from before a period only the newest of a
    batch is held. Requests of a batch are appended to their period's state, which is not read before the watermark has
    passed a slice of it, a quarter of the TTL, that has requests: then a timer hands out one by one the requests that
    the watermark has passed, and the others are written again. At the end of the period the state is dropped.
    Requests are held as JSON of their columns' types (maps need text as keys). No pairs are formed. Failed observations and empty answers serve nobody. Rows later than ``late`` are dropped,
    as by every watermark. The session's streams keep their state in RocksDB from here on
    (:func:`keep_state_in_rocksdb`).
    """
    keep_state_in_rocksdb(requests.sparkSession)
    width = max(1, ttl_seconds * 1_000_000 // SLICES_PER_TTL)
    period = width * SLICES_PER_TTL * TTLS_PER_PERIOD

    def period_of(micros: Column) -> Column:
        return F.call_function("div", micros, F.lit(period))

    kept = [c for c in requests.columns if c not in ("ip", "cname")]
    asked = requests.select(
        url_hostname(url).alias("ws_host"),
        period_of(F.unix_micros(asked_at)).alias("ws_period"),
        F.col(asked_at).alias("ws_at"),
        F.unix_micros(asked_at).alias("micros"),
        F.to_json(F.struct(*kept), JSON_TIMES).alias("request"),
    )
    seen = F.unix_micros("observed_at")
    served = observations.filter(F.col("error").isNull() & (F.size("ips") > 0)).select(
        F.col("host").alias("ws_host"),
        F.explode(
            F.sequence(period_of(seen), period_of(seen + F.lit(ttl_seconds * 1_000_000)))
        ).alias("ws_period"),
        F.col("observed_at").alias("ws_at"),
        seen.alias("micros"),
        F.element_at("ips", 1).alias("ip"),
        "cname",
    )
    both = asked.unionByName(served, allowMissingColumns=True).withWatermark("ws_at", late)
    request = StructType([StructField(c, requests.schema[c].dataType) for c in kept])
    answered = both.groupBy("ws_host", "ws_period").transformWithState(
        _address_server(width, period, ttl_seconds * 1_000_000), _ANSWER, "append", "eventTime"
    )
    asked_for = F.from_json("request", request, JSON_TIMES).alias("request")
    return answered.select(asked_for, "ip", "cname", F.timestamp_micros("seen").alias("observed_at")).select(
        "request.*", "ip", "cname", "observed_at"
    )


# --- frontier ----------------------------------------------------------------------------------

# Stored frontier and micro-batch to (rows that are new or changed, further outputs by name). Further
# outputs depend on the batch and on the URLs known before it, not on what the batch changes in them.
FrontierOp = Callable[[DataFrame, DataFrame], tuple[DataFrame, dict[str, DataFrame]]]
Emit = Callable[[DataFrame, dict[str, DataFrame], int], None]


def links_op(
    url: str = "url", at: datetime | Column | None = None, rules: SuffixRules = BUILT_IN
) -> FrontierOp:
    """The new rows are the new links; no further outputs."""
    return lambda frontier, batch: (
        import_links(frontier, batch, url, at, rules, touched_only=True)[0],
        {},
    )


def pages_op(
    seq: str = "seq", at: datetime | Column | None = None, rules: SuffixRules = BUILT_IN
) -> FrontierOp:
    return lambda frontier, batch: (
        import_pages(frontier, batch, seq, at, rules, touched_only=True),
        {},
    )


def resolutions_op(seq: str = "seq", at: datetime | Column | None = None) -> FrontierOp:
    """Further output: ``unmatched``, the records of unknown URLs."""

    def op(frontier: DataFrame, batch: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
        rows, unmatched = import_resolutions(frontier, batch, seq, at, touched_only=True)
        return rows, {"unmatched": unmatched}

    return op


def queue_op(queued_at: datetime | str | Column, value: str = "value") -> FrontierOp:
    """Further outputs: ``requests``, a line for every full line, and ``short``, the other lines."""

    def op(frontier: DataFrame, batch: DataFrame) -> tuple[DataFrame, dict[str, DataFrame]]:
        rows, requests, short = mark_queued(frontier, batch, queued_at, value, touched_only=True)
        return rows, {"requests": requests, "short": short}

    return op


def run_frontier(
    stream: DataFrame,
    op: FrontierOp,
    store: FrontierStore,
    checkpoint: str,
    name: str,
    compact_every: int = 20,
    emit: Emit | None = None,
) -> DataStreamWriter:
    """Apply ``op`` to the stored frontier per micro-batch; add a trigger and start it.

    A commit is labelled with ``name`` and the batch's number, so a batch that is replayed after a
    failure changes nothing. Other programs may write the store meanwhile: a batch that meets a change of one
    of its URLs is applied again to the newer state. ``emit`` gets the rows each batch
    has added or changed, the further outputs of ``op``, and the batch's number; a replay hands it the
    same again.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        own = FrontierStore(batch.sparkSession, store.path, store.buckets, compact_every)
        label = f"{name}-{batch_id}"
        outputs: dict[str, DataFrame] = {}

        def rows(frontier: DataFrame) -> DataFrame:
            touched, more = op(frontier, batch)
            outputs.update(more)
            return touched

        own.update(rows, label)
        if emit is not None:
            emit(own.changes(label), outputs, batch_id)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
