"""Similarity join of documents on word shingles with prefix trees (tries).

A document's set of shingles is written in one global order: shingles known to be frequent last, by
hash otherwise. Two sets of a Jaccard similarity of at least t share a shingle among the first
``n - ceil(t * n) + 1`` of each, so a shuffle on those few finds every candidate; how many of them two
sets share bounds what they can have in common, and drops most candidates. The rest hangs together in
blocks. In a block the sets are stored in a trie: one walk over it meets all its sets, what a path has
in common with each probing set is counted once and shared by everything below, and a probe leaves a
subtree as soon as the shingles left can't reach the similarity any more.

Equal sets are one class from the start, so copies cost nothing. Blocks have no bound, tasks have:
see :func:`link_classes`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webspark.llm.components import components
from webspark.llm.tables import sieved, written
from webspark.llm.words import shingle_sets

SHINGLE_WORDS = 5
PERCENT = 80
# Shingles that the order puts last: so many at most, the most frequent. They decide how much work
# the join is, never its result.
FREQUENT = 1 << 20
# Documents that share a shingle: up to so many are compared pair by pair in their counts, more hang
# together in a chain.
FEW = 16
# Parts into which the sets of one size under a frequent shingle are dealt.
SALTS = 64
# Shingles of a batch that goes back to Spark.
BATCH_SHINGLES = 1 << 18
# Shingles and sets that one task of the join holds of its slice, and again of the sets it compares.
SLICE_SHINGLES = 1_000_000
SLICE_SETS = 1024
# Sets of a block that every slice of it gets, to join the slices' parts.
PIVOTS = 16


def least_shared(n, m, percent: int = PERCENT):
    """Least number of shared shingles of sets of ``n`` and ``m`` that link."""
    return -(-percent * (n + m) // (100 + percent))


def prefix_size(n, percent: int = PERCENT):
    """A linked set of any size shares one of so many first shingles."""
    return n - -(-percent * n // 100) + 1


def frequent_shingles(docs: DataFrame, text: str, size: int, percent: int = PERCENT, most: int = FREQUENT) -> np.ndarray:
    """The shingles of more than FEW documents, the most frequent ``most`` of them, ascending.

    Counted are, over all documents, the shingles that stand first by hash, half as many again as a
    prefix has: the others don't come into a prefix but by way of very many frequent ones. The driver
    gets at most ``most`` numbers.
    """

    def lowest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, sets in _runs(batch.column(0), size):
                first = [s[: prefix_size(len(s), percent) * 3 // 2] for s in sets if len(s)]
                found, n = np.unique(np.concatenate([np.zeros(0, np.uint64), *first]), return_counts=True)
                yield pa.RecordBatch.from_pydict({"shingle": found.view(np.int64), "n": n.astype(np.int32)})

    counts = docs.select(text).mapInArrow(lowest, "shingle long, n int")
    top = (
        counts.groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") > FEW).orderBy(F.desc("n"), "shingle").limit(most)
    )
    found = top.select("shingle").toPandas()["shingle"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def in_order(found: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """Distinct ascending hashes in the global order."""
    if len(frequent) == 0 or len(found) == 0:
        return found
    at = np.minimum(np.searchsorted(frequent, found), len(frequent) - 1)
    late = frequent[at] == found
    return np.concatenate([found[~late], found[late]])


def _rank(ordered: np.ndarray, frequent: np.ndarray) -> int:
    """Place of the last shingle in the global order, as a number."""
    if len(ordered) == 0:
        return 0
    last = ordered[-1:]
    late = len(frequent) > 0 and frequent[min(int(np.searchsorted(frequent, last)[0]), len(frequent) - 1)] == last[0]
    return int(last[0] >> np.uint64(2)) + (1 << 62) * int(late)


def _identity(found: np.ndarray) -> int:
    """Hash of a set; with the set's size it stands for the set."""
    if len(found) == 0:
        return 0
    with np.errstate(over="ignore"):
        return int(np.bitwise_xor.reduce(found * np.uint64(0xD6E8FEB86659FD93) ^ found >> np.uint64(29)).view(np.int64))


def _runs(texts: pa.Array, size: int) -> Iterator[tuple[int, list[np.ndarray]]]:
    """(first text, sets) of runs of texts with about BATCH_SHINGLES shingles."""
    held, total, first, k = [], 0, 0, 0
    for k, found in enumerate(shingle_sets(texts, size), 1):
        held.append(found)
        total += len(found)
        if total >= BATCH_SHINGLES:
            yield first, held
            held, total, first = [], 0, k
    if held:
        yield first, held


def _lists(sets: list[np.ndarray]) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.uint64), *sets]).view(np.int64)))


def shingle_prefixes(
    docs: DataFrame, frequent: np.ndarray, size: int, percent: int, id_column: str, text_column: str
) -> DataFrame:
    """``(doc_id, n, hash, last, prefix)`` of every row; prefix in the global order, ``last`` the rank of
    its last shingle in that order (coarsely: equal ranks may be different shingles)."""
    key = docs.schema[id_column].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _runs(batch.column(1), size):
                made = [in_order(s, frequent)[: prefix_size(len(s), percent) if len(s) else 0] for s in sets]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([_identity(s) for s in sets], pa.int64()),
                        pa.array([_rank(m, frequent) for m in made], pa.int64()),
                        _lists(made),
                    ],
                    names=["doc_id", "n", "hash", "last", "prefix"],
                )

    return docs.select(id_column, text_column).mapInArrow(
        rows, f"doc_id {key}, n long, hash long, last long, prefix array<long>"
    )


# --- the trie of a block -----------------------------------------------------------------------


class Trie:
    """Sets in one order, each a path from the root; a node holds the run of shingles up to the next
    branch."""

    def __init__(self, sets: list[np.ndarray]):
        self.sets = sets
        self.order = sorted(range(len(sets)), key=lambda k: sets[k].astype(">u8").tobytes())
        ordered = [sets[k] for k in self.order]
        self.shared = [self._common(a, b) for a, b in zip(ordered, ordered[1:], strict=False)]
        self.sizes = np.array([len(s) for s in ordered], np.int64)

    @staticmethod
    def _common(a: np.ndarray, b: np.ndarray) -> int:
        n = min(len(a), len(b))
        other = np.flatnonzero(a[:n] != b[:n])
        return int(other[0]) if len(other) else n

    def nodes(self) -> Iterator[tuple[int, int, int, int]]:
        """(first set, last set + 1, start, end) of every node from the root down: the positions
        ``start`` to ``end`` are common to its sets. Parents come before their children, whose start
        is the parent's end."""
        todo = [(0, len(self.order), 0)]
        while todo:
            first, last, start = todo.pop()
            if last - first == 1:
                yield first, last, start, int(self.sizes[first])
                continue
            end = min(self.shared[first : last - 1])
            yield first, last, start, end
            cuts = [k + 1 for k in range(first, last - 1) if self.shared[k] == end]
            bounds = [first, *cuts, last]
            todo += [(a, b, end) for a, b in zip(bounds[::-1][1:], bounds[::-1][:-1], strict=True)]


def trie_links(
    stored: list[np.ndarray], probes: list[np.ndarray], percent: int = PERCENT
) -> Iterator[tuple[int, np.ndarray]]:
    """(k, linked probes) for every stored set ``k``.

    One walk over the trie of the stored sets serves all probes. ``overlap`` of a node is what its
    path has in common with every probe still in play; a child adds only its own run of shingles.
    A probe leaves when its overlap and what either side has left stay below the least that links.
    """
    if not stored or not probes:
        return
    trie = Trie(stored)
    sizes = np.array([len(p) for p in probes], np.int64)
    flat = np.concatenate(probes)
    owner = np.repeat(np.arange(len(probes)), sizes)
    by = np.argsort(flat, kind="stable")
    owner = owner[by]
    tokens, begin, many = np.unique(flat[by], return_index=True, return_counts=True)
    path: list[tuple[int, np.ndarray, np.ndarray]] = []  # (last set + 1, overlap, in play)
    for first, last, start, end in trie.nodes():
        while path and path[-1][0] <= first:
            path.pop()
        overlap, alive = path[-1][1:] if path else (np.zeros(len(probes), np.int64), np.ones(len(probes), bool))
        if not alive.any():
            path.append((last, overlap, alive))
            continue
        run = trie.sets[trie.order[first]][start:end]
        at = np.searchsorted(tokens, run)
        at = at[tokens[np.minimum(at, len(tokens) - 1)] == run] if len(run) else at
        if len(at):
            n = many[at]
            steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            overlap = overlap + np.bincount(owner[np.repeat(begin[at], n) + steps], minlength=len(probes))
        below = trie.sizes[first:last]
        left = np.minimum(int(below.max()) - end, sizes - overlap)
        least = int(below.min())
        alive = alive & (overlap + left >= least_shared(least, sizes, percent))
        path.append((last, overlap, alive))
        if last - first == 1:
            yield trie.order[first], np.flatnonzero(alive)


class Groups:
    """Union of sets, by label per set."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def join(self, k: int, others: np.ndarray) -> None:
        labels = np.unique(self.label[others])
        least = min(int(self.label[k]), int(labels[0])) if len(labels) else int(self.label[k])
        for other in {int(self.label[k]), *labels.tolist()} - {least}:
            self.label[self.label == other] = least


def _slice_edges(rows: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Edges (rep, root) that span the linked groups of a slice; the slice's probes may be fewer than
    its sets (those with ``probe`` set)."""
    rows = rows.sort_values("rep", ignore_index=True)
    sets = [np.asarray(s, np.int64).view(np.uint64) for s in rows["shingles"]]
    asked = np.flatnonzero(rows["probe"].to_numpy())
    groups = Groups(len(sets))
    for k, linked in trie_links(sets, [sets[a] for a in asked], percent):
        groups.join(k, asked[linked])
    reps = rows["rep"].to_numpy()
    return pd.DataFrame({"block": rows["block"], "rep": reps, "root": reps[groups.label]})


def candidate_blocks(rows: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """``(rep, block)`` of the classes that may link with another one.

    Of two sets, let ``a`` be the one whose prefix ends first. What it has in its prefix the other has in
    its own prefix or not at all, so they share at most what the prefixes share and what ``a`` has after
    its prefix. That number is counted for all pairs under a shingle of at most FEW sets; shingles of
    more sets count as shared. Sets under such a frequent shingle stand in order of size, and
    neighbours are joined unless one is too small for the other; then it is too small for everything
    beyond as well. So they hang together with one edge for each row, and no pairs are made of a large
    group.
    """
    own = rows.join(classes.select("hash", "n", "rep"), ["hash", "n"]).where("doc_id = rep")
    tokens = own.select("rep", "n", "last", F.explode("prefix").alias("shingle"))
    # Counted by an aggregate and joined back, so that a frequent shingle is no hot key.
    held = written(tokens.groupBy("shingle").agg(F.count("*").alias("sets")).where("sets > 1"), "shingle-counts")
    shared = written(sieved(tokens, "shingle", held, "shingle").join(held, "shingle"), "shared-shingles")
    few = shared.where(F.col("sets") <= FEW).groupBy("shingle").agg(F.array_sort(F.collect_set("rep")).alias("reps"))
    pairs = few.select(
        F.explode(F.flatten(F.transform("reps", lambda a, i: F.transform(F.slice("reps", i + 2, F.lit(FEW)), lambda b: F.struct(a.alias("a"), b.alias("b")))))).alias("pair")
    )
    counted = pairs.groupBy("pair.a", "pair.b").agg(F.count("*").alias("c"))
    many = F.sum(F.when(F.col("sets") > FEW, 1).otherwise(0)).alias("many")
    about = shared.groupBy("rep").agg(F.max("n").alias("n"), F.max("last").alias("last"), many)

    def side(x: str) -> DataFrame:
        return about.select(F.col("rep").alias(x), *[F.col(c).alias(f"{c}_{x}") for c in ("n", "last", "many")])

    both = counted.join(side("a"), "a").join(side("b"), "b")
    after = {x: F.ceil(F.lit(percent) * F.col(f"n_{x}") / 100) - 1 for x in "ab"}
    rest = F.when(F.col("last_a") < F.col("last_b"), after["a"]).when(F.col("last_a") > F.col("last_b"), after["b"]).otherwise(F.greatest(after["a"], after["b"]))
    least = F.ceil(F.lit(percent) * (F.col("n_a") + F.col("n_b")) / (100 + percent))
    fit = F.lit(100) * F.least("n_a", "n_b") >= F.lit(percent) * F.greatest("n_a", "n_b")
    likely = both.where(fit & (F.col("c") + F.least("many_a", "many_b") + rest >= least)).select("a", "b")
    # Chains in two levels: within the sets of one size, dealt over SALTS parts, and along the parts.
    frequent = shared.where(F.col("sets") > FEW).select(
        "shingle", "n", F.pmod(F.xxhash64("rep"), F.lit(SALTS)).alias("salt"), "rep"
    )
    part = ["shingle", "n", "salt"]
    inside = Window.partitionBy(*part).orderBy("rep")
    near = frequent.select(F.col("rep").alias("a"), F.lag("rep").over(inside).alias("b"))
    along = Window.partitionBy("shingle").orderBy("n", "salt")
    heads = frequent.groupBy(*part).agg(F.min("rep").alias("rep"))
    far = heads.select(
        F.col("rep").alias("a"), F.lag("rep").over(along).alias("b"), F.lag("n").over(along).alias("m"), "n"
    ).where(F.lit(100) * F.col("m") >= F.lit(percent) * F.col("n"))
    chain = near.union(far.select("a", "b")).where("b IS NOT NULL AND a <> b")
    edges = likely.union(chain.distinct())
    return components(edges, "candidate-blocks").select(
        F.col("node").alias("rep"), F.col("root").alias("block")
    )


def _with_shingles(members: DataFrame, docs: DataFrame, frequent: np.ndarray, size: int, id_column: str, text_column: str) -> DataFrame:
    """``members(rep, ...)`` with the shingles of the document of that id, in the global order."""
    texts = docs.select(F.col(id_column).alias("rep"), F.col(text_column).alias("ws_text")).dropna()
    named = members.columns
    joined = members.join(sieved(texts, "rep", members, "rep"), "rep").select(*named, "ws_text")

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, sets in _runs(batch.column(len(named)), size):
                own = [c.slice(first, len(sets)) for c in batch.columns[:-1]]
                made = _lists([in_order(s, frequent) for s in sets])
                full = pa.array([len(s) > 0 for s in sets], pa.bool_())
                yield pa.RecordBatch.from_arrays([*own, made], names=[*named, "shingles"]).filter(full)

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in members.schema.fields)
    return joined.mapInArrow(rows, f"{kinds}, shingles array<long>")


def link_classes(
    blocks: DataFrame, classes: DataFrame, docs: DataFrame, frequent: np.ndarray, size: int, percent: int, id_column: str, text_column: str
) -> DataFrame:
    """``(rep, root)``: the linked groups of classes, exact, root the smallest class.

    A block is dealt over slices of bounded size, by a hash; most blocks are one slice. Every slice
    also gets the block's pivots, and joins its own sets in its own trie. Parts that hold the same
    pivot grow together over all slices. What then is outside the block's largest part is compared
    with every slice of the block in chunks of bounded size. So a pair in different slices is known
    to be linked over others, or compared; a group of near copies, however large, is joined slice by
    slice, and no task holds more than two slices.
    """
    sized = blocks.join(classes.select("rep", "n"), "rep")
    totals = sized.groupBy("block").agg(F.sum("n").alias("ws_n"), F.count("*").alias("ws_k"))
    totals = totals.select(
        "block",
        F.greatest(
            F.ceil(F.col("ws_n") / SLICE_SHINGLES), F.ceil(F.col("ws_k") / SLICE_SETS), F.lit(1)
        ).cast("int").alias("slices"),
    )
    lone = sized.join(totals, "block").withColumn("salted", F.xxhash64(F.lit(1), "rep"))
    dealt = written(
        lone.select("block", "rep", "slices", "salted", F.pmod("salted", "slices").cast("int").alias("slice")),
        "block-slices",
    )
    split = dealt.where("slices > 1")
    # The least PIVOTS of a block by salt: each slice offers its own, then the block chooses.
    near = split.withColumn(
        "ws_place", F.row_number().over(Window.partitionBy("block", "slice").orderBy("salted", "rep"))
    ).where(F.col("ws_place") <= PIVOTS)
    pivots = near.withColumn(
        "ws_place", F.row_number().over(Window.partitionBy("block").orderBy("salted", "rep"))
    ).where(F.col("ws_place") <= PIVOTS)
    everywhere = pivots.select(
        "block", "rep", F.explode(F.expr("sequence(0, slices - 1)")).alias("slice")
    )
    members = dealt.select("block", "rep", "slice").union(everywhere).distinct()

    def edges(pdf: pd.DataFrame) -> pd.DataFrame:
        return _slice_edges(pdf, percent)

    local = written(
        _with_shingles(members.withColumn("probe", F.lit(True)), docs, frequent, size, id_column, text_column)
        .groupBy("block", "slice")
        .applyInPandas(edges, "block long, rep long, root long"),
        "slice-links",
    )
    links = local.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b"))
    if split.isEmpty():
        return local.groupBy("rep").agg(F.min("root").alias("root"))
    parts = components(links, "joined-slices").withColumnRenamed("node", "rep")
    placed = split.join(parts, "rep", "left").select(
        "block", "rep", "slice", "slices", F.coalesce("root", "rep").alias("root")
    )
    sizes = placed.groupBy("block", "root").count()
    largest = sizes.groupBy("block").agg(F.max_by("root", F.struct("count", "root")).alias("largest"))
    apart = placed.join(largest, "block").where("root <> largest")
    # Chunks of what is apart, each with every slice of the block.
    apart = written(
        apart.join(sizes.join(largest, "block").where("root <> largest").groupBy("block").agg(F.sum("count").alias("ws_k")), "block")
        .select("block", "rep", "slices", F.pmod(F.xxhash64(F.lit(2), "rep"), F.ceil(F.col("ws_k") / SLICE_SETS).cast("int")).alias("chunk"), F.ceil(F.col("ws_k") / SLICE_SETS).cast("int").alias("chunks")),
        "apart",
    )
    asked = apart.select("block", "rep", F.explode(F.expr("sequence(0, slices - 1)")).alias("slice"), "chunk")
    chunks = apart.groupBy("block").agg(F.max("chunks").alias("chunks"))
    stored = split.join(chunks, "block").select("block", "rep", "slice", F.explode(F.expr("sequence(0, chunks - 1)")).alias("chunk"))
    both = (
        asked.withColumn("probe", F.lit(True))
        .unionByName(stored.withColumn("probe", F.lit(False)).withColumn("chunk", F.col("chunk").cast("long")))
        .groupBy("block", "rep", "slice", "chunk")
        .agg(F.max("probe").alias("probe"))
    )
    across = _with_shingles(both, docs, frequent, size, id_column, text_column).groupBy("block", "slice", "chunk").applyInPandas(edges, "block long, rep long, root long")
    more = written(across.where("rep <> root").select(F.col("rep").alias("a"), F.col("root").alias("b")), "slice-links")
    return components(links.union(more), "linked-classes").select(F.col("node").alias("rep"), "root")


def ngram_join(
    docs: DataFrame,
    size: int = SHINGLE_WORDS,
    percent: int = PERCENT,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of every row.

    A set is a text's distinct shingles of ``size`` words, A-Z lower-cased; with fewer words the whole
    sequence is the only one. Two documents link when ``100 * shared >= percent * united``;
    ``component_id`` is the smallest id that links reach, the own id included. A document without
    words (null, empty, white space) has an empty set and is linked with nothing. Rows that share an
    id stand for themselves and are returned as often. A null id keeps its row: it joins the group of
    its text, and where the group has no id ``component_id`` is null. An empty table gives an empty
    one. Other columns are not read. Ids are whole numbers.
    """
    frequent = frequent_shingles(docs, text_column, size, percent)
    rows = written(shingle_prefixes(docs, frequent, size, percent, id_column, text_column), "shingle-prefixes")
    classes = written(
        rows.where("n > 0").groupBy("hash", "n").agg(F.min("doc_id").alias("rep")), "shingle-classes"
    )
    known = classes.where("rep IS NOT NULL")
    blocks = candidate_blocks(rows.where("n > 0"), known, percent)
    linked = link_classes(blocks, known, docs, frequent, size, percent, id_column, text_column)
    roots = classes.join(linked, "rep", "left").select("hash", "n", F.coalesce("root", "rep").alias("root"))
    # Copies share a class, so this side may be one hot key: a plain join, which Spark can split.
    return rows.select("doc_id", "n", "hash").join(roots, ["hash", "n"], "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", F.when(F.col("n") == 0, F.col("doc_id"))).alias("component_id")
    )
