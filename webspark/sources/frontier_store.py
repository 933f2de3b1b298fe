"""The stored frontier: a bucketed base table and the change sets committed since.

``load`` is the base with the newest change of each URL laid over it. A commit writes only new and
changed rows, so a small batch does not rewrite a large table; ``compact`` folds the changes into a
new base, by itself after ``compact_every`` commits. The base is bucketed by URL: laying changes over it, and
joining it on the URL while no changes are pending, read it in place, without a shuffle of the big side. All
pending change sets are one scan, however many there are.

Files are written to folders of random names and count once the manifest names them. An entry of the manifest is
a version, published only if no other writer has published it. So programs may write side by side: a writer
that was not first takes the next version, after a check that what came in between holds none of its URLs. Rows
that were made from an older state of a URL are refused (:class:`Conflict`), not laid over the newer one;
:meth:`FrontierStore.update` makes them again. Commits are checked before they count, so neither a bad batch
nor a lost executor or driver leaves anything that readers see. Compaction removes what is older than the base
before the new one, which is kept for readers, and remembers the labels of what it removes.

A base has a filter of its URLs beside it (:mod:`webspark.sources.url_filter`), merged with the changes at each
compaction and made anew when the frontier outgrows it. :meth:`FrontierStore.unknown` asks it first: what it
doesn't know meets the pending changes only, and the rest is looked up, so the answer is exact.
"""

from __future__ import annotations

from collections.abc import Callable
from hashlib import md5
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webspark.operators.frontier import duplicate_urls
from webspark.schemas import FRONTIER
from webspark.sources.manifest import ManifestLog
from webspark.sources.shared import fresh_path
from webspark.sources.url_filter import SCHEMA, blocks_for, build_filter, merge_filters, probe

COLUMNS = FRONTIER.fieldNames()
COMPACT_EVERY = 64
# Labels of removed commits that a base remembers; a replay is of the last batches.
LABELS_KEPT = 1000


class Conflict(Exception):
    """Another writer has changed a URL since the state that the rows were made from."""


class FrontierStore:
    """Frontier under ``path``. ``buckets`` is fixed when the first base is written; it should be at
    least ``spark.sql.shuffle.partitions``, its default, for joins to keep the base in place."""

    def __init__(
        self, spark: SparkSession, path: str, buckets: int | None = None, compact_every: int = COMPACT_EVERY
    ):
        self.spark = spark
        self.path = path.rstrip("/")
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.compact_every = compact_every
        self.log = ManifestLog(spark, f"{self.path}/manifest")

    # --- manifest ---

    def _entries(self) -> list[dict]:
        """Entries ``(kind, version, label, folder, ..)``, by version and kind."""
        return sorted(self.log.entries().values(), key=lambda e: (e["version"], e["kind"]))

    def _state(self, upto: int | None = None) -> tuple[dict | None, list[dict]]:
        """The last base and the changes after it."""
        entries = [e for e in self._entries() if upto is None or e["version"] <= upto]
        base = max((e for e in entries if e["kind"] == "base"), key=lambda e: e["version"], default=None)
        since = base["version"] if base else 0
        return base, [e for e in entries if e["kind"] == "changes" and e["version"] > since]

    def version(self) -> int:
        """Newest version, 0 before the first commit."""
        return max((e["version"] for e in self._entries()), default=0)

    def committed(self, label: str) -> bool:
        """A commit with this label is there already."""
        return any(e.get("label") == label or label in e.get("labels", ()) for e in self._entries())

    # --- reading ---

    def _folder(self, entry: dict) -> str:
        return f"{self.path}/data/{entry['folder']}"

    def _table(self, entry: dict) -> str:
        return f"webspark_{md5(self._folder(entry).encode()).hexdigest()[:16]}"

    def _base_table(self, entry: dict) -> DataFrame:
        table = self._table(entry)
        if not self.spark.catalog.tableExists(table):
            columns = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in FRONTIER)
            self.spark.sql(
                f"CREATE TABLE {table} ({columns}) USING parquet "
                f"CLUSTERED BY (url) INTO {entry['buckets']} BUCKETS LOCATION '{self._folder(entry)}'"
            )
        return self.spark.table(table)

    def _changed(self, entries: list[dict]) -> DataFrame:
        """Rows of change sets with their version, in one scan."""
        rows = self.spark.read.schema(FRONTIER).parquet(*[self._folder(e) for e in entries])
        # As many pairs as there are pending commits, which compaction bounds.
        pairs = [F.lit(x) for e in entries for x in (e["folder"], e["version"])]
        folder = F.regexp_extract(F.col("_metadata.file_path"), "/data/([^/]+)/", 1)
        return rows.withColumn("ws_version", F.element_at(F.create_map(*pairs), folder))

    def _stored(self, upto: int | None = None) -> DataFrame:
        entry, pending = self._state(upto)
        base = self._base_table(entry) if entry else self.spark.createDataFrame([], FRONTIER)
        if not pending:
            return base
        values = [c for c in COLUMNS if c != "url"]
        newest = self._changed(pending).groupBy("url").agg(F.max_by(F.struct(*values), "ws_version").alias("ws_new"))
        picked = [
            F.when(F.col("ws_new").isNull(), F.col(c)).otherwise(F.col(f"ws_new.{c}")).alias(c)
            if c != "url"
            else F.col(c)
            for c in COLUMNS
        ]
        return base.join(newest, "url", "full").select(*picked)

    def load(self, version: int | None = None) -> DataFrame:
        """The frontier without soft-deleted rows, as it is now or was at a version that is still there.
        Straight after :meth:`compact` this is a bare scan, which filters such as ``NOT visited`` reach."""
        return self._stored(version).filter(F.col("deleted_at").isNull())

    def unknown(self, urls: DataFrame, url: str = "url") -> DataFrame:
        """(url): the URLs of a batch that the frontier doesn't hold, once each; what
        :func:`webspark.operators.frontier.import_links` calls new, nulls left out. Most of the new ones are known
        to be new from the filter of the base alone. Soft-deleted URLs count as not held. The answers of the
        filter are written to the shared folder at once; the rest is done when the result is used."""
        batch = urls.select(F.col(url).alias("url")).filter(F.col("url").isNotNull()).distinct()
        base, pending = self._state()
        held = self._held(base, pending)
        if base is None or "filter" not in base:
            return batch.join(held, "url", "left_anti")
        # Written, so that the batch, such as the links of many pages, is made once for both answers.
        path = fresh_path(self.spark, "probed")
        probe(batch, self._filter_table(base), base["filter_blocks"]).write.parquet(path)
        probed = self.spark.read.schema("url STRING, ws_maybe BOOLEAN").parquet(path)
        asked = probed.filter("ws_maybe").select("url")
        # Few candidates are broadcast to the base by the optimizer, many go to its buckets.
        maybe = asked.join(held.join(asked, "url", "left_semi"), "url", "left_anti")
        absent = probed.filter("NOT ws_maybe").select("url")
        if pending:
            absent = absent.join(self._newest_state(pending).filter("NOT ws_gone").select("url"), "url", "left_anti")
        return maybe.unionByName(absent)

    def _newest_state(self, pending: list[dict]) -> DataFrame:
        """(url, ws_gone) of the newest pending change of each URL."""
        gone = F.col("deleted_at").isNotNull()
        return self._changed(pending).groupBy("url").agg(F.max_by(gone, "ws_version").alias("ws_gone"))

    def _held(self, base: dict | None, pending: list[dict]) -> DataFrame:
        """(url) of :meth:`load`, from two columns of the base."""
        stored = self._base_table(base) if base else self.spark.createDataFrame([], FRONTIER)
        held = stored.filter(F.col("deleted_at").isNull()).select("url")
        if not pending:
            return held
        newest = self._newest_state(pending)
        return (
            held.withColumn("ws_base", F.lit(True))
            .join(newest, "url", "full")
            .filter(~F.coalesce("ws_gone", F.lit(False)))
            .select("url")
        )

    def _filter_table(self, entry: dict) -> DataFrame:
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/data/{entry['filter']}")

    def _write_filter(self, base: dict | None, pending: list[dict], stored: DataFrame) -> dict:
        """The filter of a new base, as fields of its entry: that of the last base with the bits of the changes,
        or, where the URLs have outgrown it, one of all URLs."""
        blocks = blocks_for(stored.count())
        if base and base.get("filter_blocks") == blocks:
            fresh = build_filter(self._changed(pending), blocks)
            table = merge_filters(self._filter_table(base), fresh)
        else:
            table = build_filter(stored, blocks)
        folder = f"filter-{uuid4().hex}"
        table.write.parquet(f"{self.path}/data/{folder}")
        return {"filter": folder, "filter_blocks": blocks}

    def changes(self, label: str) -> DataFrame:
        """The rows a labelled commit has written."""
        found = [e for e in self._entries() if e["kind"] == "changes" and e["label"] == label]
        return self.spark.read.schema(FRONTIER).parquet(self._folder(found[-1]))

    # --- writing ---

    def commit(self, touched: DataFrame, label: str = "manual", read_version: int | None = None) -> int:
        """Write new and changed rows as the next version and return it. With a ``label`` of its own
        (other than ``manual``) a commit that is repeated does nothing. Rows made from the state of
        ``read_version`` raise :class:`Conflict` if a later version holds one of their URLs; without it, they
        are laid over whatever is there."""
        if label != "manual" and self.committed(label):
            return self.version()
        entry = {"kind": "changes", "label": label, "folder": f"changes-{uuid4().hex}"}
        folder = self._folder(entry)
        touched.select(*COLUMNS).write.parquet(folder)
        rows = self.spark.read.schema(FRONTIER).parquet(folder)
        self._check(rows, folder)
        seen = read_version
        while True:
            version = self.version() + 1
            if seen is not None:
                self._refuse_overlap(rows, seen, version)
                seen = version - 1
            if label != "manual" and self.committed(label):
                return self.version()
            if self.log.put(f"changes-{version:08d}", entry | {"version": version}):
                break
        if len(self._state()[1]) >= self.compact_every:
            self.compact()
        return version

    def _refuse_overlap(self, rows: DataFrame, seen: int, version: int) -> None:
        """Changes after version ``seen`` and before ``version`` must hold none of the rows' URLs."""
        base, pending = self._state()
        between = [e for e in pending if seen < e["version"] < version]
        # A compaction may have folded in what was pending: then its rows are not apart any more.
        if base is not None and base["version"] > seen:
            raise Conflict(f"{self.path} was compacted after version {seen}")
        if between and not rows.join(self._changed(between).select("url"), "url", "left_semi").isEmpty():
            raise Conflict(f"{self.path}: a URL was changed after version {seen}")

    def update(
        self, operation: Callable[[DataFrame], DataFrame], label: str = "manual", attempts: int = 20
    ) -> int:
        """Commit what ``operation`` makes of the frontier: its new and changed rows. If another writer has
        changed one of the URLs meanwhile, it is made again from the newer state, so no change is lost."""
        for _ in range(attempts - 1):
            version = self.version()
            try:
                return self.commit(operation(self.load(version)), label, version)
            except Conflict:
                continue
        version = self.version()
        return self.commit(operation(self.load(version)), label, version)

    def _check(self, rows: DataFrame, target: str) -> None:
        """Every row of a commit has a URL, and a URL stands once. Checked on the rows as written."""
        if not rows.filter(F.col("url").isNull()).isEmpty():
            raise ValueError(f"{target}: a row has no url")
        twice = duplicate_urls(rows).limit(1).collect()
        if twice:
            raise ValueError(f"{target}: {twice[0].url} is there {twice[0].rows} times")

    def compact(self) -> int:
        """Write a new base that holds all changes up to now and return its version. Commits that come
        meanwhile stay changes on top of it."""
        version = self.version()
        base, pending = self._state(version)
        if not pending:
            return version
        labels = [*(base["labels"] if base else []), *(e["label"] for e in pending if e["label"] != "manual")]
        entry = {"kind": "base", "version": version, "folder": f"base-{uuid4().hex}", "buckets": self.buckets}
        (
            self.load(version)
            .repartition(self.buckets, "url")
            .write.format("parquet")
            .bucketBy(self.buckets, "url")
            .option("path", self._folder(entry))
            .saveAsTable(self._table(entry))
        )
        entry |= self._write_filter(base, pending, self._base_table(entry))
        self.log.put(f"base-{version:08d}", entry | {"labels": labels[-LABELS_KEPT:]})
        self._drop_old()
        return version

    def _drop_old(self) -> None:
        """Remove what only readers from before the last two bases could need."""
        entries = self._entries()
        bases = [e["version"] for e in entries if e["kind"] == "base"]
        if len(bases) < 2:
            return
        kept = bases[-2]
        for e in entries:
            if e["version"] < kept or (e["kind"] == "changes" and e["version"] == kept):
                self.log.remove(f"{e['kind']}-{e['version']:08d}")
                self.spark.sql(f"DROP TABLE IF EXISTS {self._table(e)}")
                self._remove(self._folder(e))
                if "filter" in e:
                    self._remove(f"{self.path}/data/{e['filter']}")

    def _remove(self, folder: str) -> None:
        fs = self.spark._jvm.org.apache.hadoop.fs.Path(folder)
        fs.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(fs, True)
