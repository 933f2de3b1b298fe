"""A manifest of a dataset: a Merkle tree over its rows, with a witness for every row.

Each tree (of one source, say) takes its leaves in order, and every 16 consecutive nodes become their
digest, until one is left; the roots of the trees form one more tree. Leaves are appended to aligned
blocks, as a stream: a task keeps, for each level of a block, the run of nodes that is still open, which is
the partial witness of everything below it, and each node that a completed run yields extends the run
above. The root of a block is then appended to the tree of blocks in the same way, round after round, each
with a 256th of the nodes. A witness is stored once per run, not once per leaf, so a manifest is little
more than the digests; ``proofs`` puts the witnesses of the rounds together, and ``append`` opens only the
last block of every tree that grows.

Nodes are dealt by block, so a tree with a third of all rows is as many groups as it has blocks, and its
leaves are numbered by ranges, with a prefix sum over the partitions. The driver sees counts alone.

Rows with a null tree form a tree of their own, the first one; a null order value comes first. Rows that
agree in tree and order value are ordered by their digest, so repeated rows are leaves of their own with
any order among equals. An empty table has no leaves and no root. Columns other than the named ones are
not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webspark.llm.tables import written

FAN = 16
# Levels that a task builds above the nodes of a block.
LEVELS = 2
BLOCK = FAN**LEVELS
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(values: list[bytes]) -> bytes:
    """Digest of child digests, as hexadecimal text one after the other."""
    return sha256("".join(v.hex() for v in values).encode()).digest()


def row_digest(*values: Column | str) -> Column:
    """Digest of a row: of every value ``-`` if it is null, else its length in bytes, ``:`` and its text."""

    def field(value: Column | str) -> Column:
        text = (F.col(value) if isinstance(value, str) else value).cast("string")
        return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))

    return F.unhex(F.sha2(F.concat(*map(field, values)), 256))


@dataclass
class Manifest:
    """Blocks of every round: of the trees, and of the tree of their roots. Block rows are ``(tree, block,
    total, root, levels, keys, folded)``: ``total`` nodes are in the tree at this round, ``levels`` holds the
    digests of the nodes that were hashed, level by level, ``keys`` and ``folded`` belong to the nodes."""

    trees: list[DataFrame]
    top: list[DataFrame]

    def root(self) -> DataFrame:
        """``root`` of the manifest, one row; none if it has no leaves."""
        return self.top[-1].select(F.lower(F.hex("root")).alias("root"))

    def subroots(self) -> DataFrame:
        """``(tree, root)`` of every tree."""
        return _tops(self.trees).select("tree", F.lower(F.hex("root")).alias("root"))


def _tops(rounds: list[DataFrame]) -> DataFrame:
    found = rounds[0].where(f"total <= {BLOCK}")
    for blocks in rounds[1:]:
        found = found.unionByName(blocks.where(f"total <= {BLOCK}"), allowMissingColumns=True)
    return found


def _same(*pairs: tuple[Column, Column]) -> Column:
    out = F.lit(True)
    for a, b in pairs:
        out = out & a.eqNullSafe(b)
    return out


def numbered(nodes: DataFrame, before: DataFrame | None = None) -> DataFrame:
    """``nodes`` ``(tree, key, digest, folded)``, a written table, with ``pos`` from 0 within the tree and
    the tree's ``total``. ``before`` ``(tree, total)`` counts leaves that the trees have already."""
    dealt = nodes.withColumn("ws_row", F.monotonically_increasing_id())
    dealt = dealt.repartitionByRange("tree", "key", "digest", "ws_row").drop("ws_row")
    dealt = dealt.sortWithinPartitions("tree", "key", "digest").withColumn("ws_at", F.monotonically_increasing_id())
    dealt = written(dealt.withColumn("ws_part", F.shiftright("ws_at", 33)), "merkle-nodes")
    # One row per tree and partition: few, whatever the size of a tree.
    parts = dealt.groupBy(F.col("tree").alias("ws_tree"), F.col("ws_part").alias("ws_p")).agg(
        F.min("ws_at").alias("ws_first"), F.count("*").alias("ws_n")
    )
    earlier = Window.partitionBy("ws_tree").orderBy("ws_p").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.withColumns(
        {
            "ws_skip": F.coalesce(F.sum("ws_n").over(earlier), F.lit(0)),
            "ws_total": F.sum("ws_n").over(Window.partitionBy("ws_tree")),
        }
    )
    if before is not None:
        old = before.select(F.col("tree").alias("ws_old"), F.col("total").alias("ws_base"))
        parts = parts.join(old, _same((F.col("ws_tree"), F.col("ws_old"))), "left").drop("ws_old")
    else:
        parts = parts.withColumn("ws_base", F.lit(0))
    parts = parts.fillna(0, ["ws_base"])
    met = dealt.join(parts, _same((F.col("tree"), F.col("ws_tree"))) & (F.col("ws_part") == F.col("ws_p")))
    return met.select(
        *nodes.columns,
        F.expr("ws_at - ws_first + ws_skip + ws_base").alias("pos"),
        F.expr("ws_total + ws_base").alias("total"),
    )


class _OpenBlock:
    """The open runs of a block, level by level, and what was hashed so far."""

    def __init__(self) -> None:
        self.runs: list[list[bytes]] = [[] for _ in range(LEVELS)]
        self.levels: list[list[bytes]] = [[] for _ in range(LEVELS)]
        self.root: bytes | None = None

    def append(self, node: bytes, level: int = 0) -> None:
        if level == LEVELS:
            self.root = node
            return
        self.levels[level].append(node)
        self.runs[level].append(node)
        if len(self.runs[level]) == FAN:
            self.close(level)

    def close(self, level: int) -> None:
        run, self.runs[level] = self.runs[level], []
        self.append(digest(run), level + 1)

    def finish(self, whole: bool) -> tuple[bytes, list[bytes]]:
        """Root and hashed levels. A tree of its own (``whole``) ends where one node is left; a block
        below others has the full height."""
        for level in range(LEVELS):
            if whole and len(self.levels[level]) == 1:
                return self.levels[level][0], [b"".join(x) for x in self.levels[:level]]
            if self.runs[level]:
                self.close(level)
        return self.root, [b"".join(x) for x in self.levels]


def _blocks(nodes: DataFrame) -> DataFrame:
    """Blocks of ``(tree, key, digest, folded, pos, total)``, every block whole."""
    kinds = {f.name: f.dataType.simpleString() for f in nodes.schema}
    schema = (
        f"tree {kinds['tree']}, block long, total long, root binary, levels array<binary>, "
        f"keys array<{kinds['key']}>, folded array<binary>"
    )

    def append(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        at, opened, keys, folded, total = None, None, [], [], 0

        def finished() -> tuple:
            root, levels = opened.finish(total <= BLOCK)
            return (*at, total, root, levels, keys, folded)

        kind = None
        for batch in batches:
            kind = kind or [batch.schema.field(c).type for c in ("tree", "key")]
            for tree, block, key, node, fold, total_here in zip(
                *(batch.column(c).to_pylist() for c in ("tree", "block", "key", "digest", "folded", "total"))
            ):
                if opened is None or (tree, block) != at:
                    if opened is not None:
                        done.append(finished())
                    at, opened, keys, folded, total = (tree, block), _OpenBlock(), [], [], total_here
                opened.append(node)
                keys.append(key)
                folded.append(fold)
            if len(done) >= 256:
                yield _batch(done, kind)
                done = []
        if opened is not None:
            done.append(finished())
            yield _batch(done, kind)

    dealt = nodes.withColumn("block", F.floor(F.col("pos") / BLOCK))
    dealt = dealt.repartition("tree", "block").sortWithinPartitions("tree", "block", "pos")
    return dealt.select("tree", "block", "key", "digest", "folded", "total").mapInArrow(append, schema)


def _batch(rows: list[tuple], kind: list[pa.DataType]) -> pa.RecordBatch:
    names = ["tree", "block", "total", "root", "levels", "keys", "folded"]
    kinds = [kind[0], pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.binary()), pa.list_(kind[1]), pa.list_(pa.binary())]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names)


def _as_nodes(blocks: DataFrame) -> DataFrame:
    """Roots of blocks below others as nodes of the next round."""
    return blocks.where(f"total > {BLOCK}").select(
        "tree",
        F.col("block").alias("key"),
        F.col("root").alias("digest"),
        F.lit(None).cast("binary").alias("folded"),
        F.col("block").alias("pos"),
        F.ceil(F.col("total") / BLOCK).alias("total"),
    )


def _rounds(nodes: DataFrame) -> list[DataFrame]:
    """Tables of blocks, round after round, until every tree has one block. Few rounds: a 256th of the
    nodes goes into the next one."""
    out = []
    while True:
        out.append(written(_blocks(nodes), "merkle-blocks"))
        nodes = _as_nodes(out[-1])
        if nodes.isEmpty():
            return out


def _top(trees: list[DataFrame]) -> list[DataFrame]:
    tops = _tops(trees).select(
        F.lit(None).cast("string").alias("tree"),
        F.col("tree").alias("key"),
        F.col("root").alias("digest"),
        F.lit(None).cast("binary").alias("folded"),
    )
    return _rounds(numbered(written(tops, "merkle-tops")))


def build(leaves: DataFrame) -> Manifest:
    """Manifest of leaves ``(tree, key, digest, folded)``: a digest per row, in the order of ``key`` within
    each ``tree``. ``folded`` is another digest to be tested in the leaf's place, or null."""
    trees = _rounds(numbered(written(leaves.select("tree", "key", "digest", "folded"), "merkle-leaves")))
    return Manifest(trees, _top(trees))


def append(old: Manifest, leaves: DataFrame) -> Manifest:
    """The manifest with more leaves, each after all that its tree has already (else ValueError).

    Only blocks that were open, and what is new, are hashed: the last block of a tree that grows is
    opened again with its nodes, and of a round the blocks whose root changed.
    """
    fresh = written(leaves.select("tree", "key", "digest", "folded"), "merkle-leaves")
    last = old.trees[0].groupBy("tree").agg(F.max(F.array_max("keys")).alias("ws_last"), F.max("total").alias("total"))
    first = fresh.groupBy(F.col("tree").alias("ws_tree")).agg(
        F.min("key").alias("ws_key"), F.expr("bool_or(key IS NULL)").alias("ws_null")
    )
    if not first.join(last, _same((F.col("ws_tree"), F.col("tree")))).where("ws_key < ws_last OR ws_null").isEmpty():
        raise ValueError("leaves must come after those their tree has already")
    nodes, trees = numbered(fresh, last), []
    for k in range(len(old.trees) + 64):
        before = old.trees[k] if k < len(old.trees) else None
        # From this node on a tree has changed.
        grown = nodes.groupBy(F.col("tree").alias("ws_tree")).agg(
            F.min("pos").alias("ws_from"), F.max("total").alias("ws_total")
        )
        grown = written(grown, "merkle-grown")
        if before is None:
            blocks = written(_blocks(nodes), "merkle-blocks")
            was = blocks.select(F.col("tree").alias("ws_t")).limit(0).withColumn("ws_was", F.lit(0))
        else:
            met = before.join(grown, _same((F.col("tree"), F.col("ws_tree"))), "left")
            open_ = met.where(f"block = floor(ws_from / {BLOCK})")
            inside = open_.selectExpr(
                "tree", "ws_from", f"block * {BLOCK} AS ws_start", "ws_total AS total", "root", "levels",
                "posexplode(keys) AS (ws_i, key)", "folded AS ws_folded",
            ).where("ws_start + ws_i < ws_from")
            inside = inside.select(
                "tree",
                "key",
                # A lone leaf is its own root, with nothing hashed.
                F.expr("if(size(levels) = 0, root, substring(levels[0], ws_i * 32 + 1, 32))").alias("digest"),
                F.expr("ws_folded[ws_i]").alias("folded"),
                F.expr("ws_start + ws_i").alias("pos"),
                "total",
            )
            kept = met.where(f"ws_from IS NULL OR block < floor(ws_from / {BLOCK})")
            kept = kept.withColumn("total", F.coalesce("ws_total", "total")).select(before.columns)
            blocks = written(kept.unionByName(_blocks(nodes.unionByName(inside))), "merkle-blocks")
            was = before.groupBy(F.col("tree").alias("ws_t")).agg(F.max("total").alias("ws_was"))
        trees.append(blocks)
        # A tree of one block so far has no nodes in the next round yet.
        changed = blocks.join(grown, _same((F.col("tree"), F.col("ws_tree"))))
        changed = changed.join(was, _same((F.col("tree"), F.col("ws_t"))), "left")
        changed = changed.where(
            f"block >= CASE WHEN coalesce(ws_was, 0) > {BLOCK} THEN floor(ws_from / {BLOCK}) ELSE 0 END"
        )
        nodes = _as_nodes(changed.select(blocks.columns))
        if k + 1 >= len(old.trees) and nodes.isEmpty():
            break
    return Manifest(trees, _top(trees))


_WITNESS = "array<struct<left:binary,right:binary>>"
_STEPS = pa.list_(pa.struct([("left", pa.binary()), ("right", pa.binary())]))


def _small(batches: Iterator[pa.RecordBatch], rows: int = 32) -> Iterator[pa.RecordBatch]:
    """Batches of a few blocks each, since each block becomes many rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def _steps(levels: list[bytes], at: int) -> list[tuple[bytes, bytes]]:
    """Siblings to the left and right of node ``at`` of a block, level by level."""
    out = []
    for nodes in levels:
        start, end = at // FAN * FAN * 32, min((at // FAN + 1) * FAN * 32, len(nodes))
        out.append((nodes[start : at * 32], nodes[at * 32 + 32 : end]))
        at //= FAN
    return out


def _below(rounds: list[DataFrame], above: DataFrame) -> DataFrame:
    """Blocks of the first round with the witness ``above`` of their root, extended round by round;
    ``above`` ``(tree, above)`` is the witness of the trees' roots."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            out: dict[str, list] = {"ws_tree": [], "ws_block": [], "above": []}
            for row in batch.to_pylist():
                for at, key in enumerate(row["keys"]):
                    out["ws_tree"].append(row["tree"])
                    out["ws_block"].append(key)
                    own = [{"left": a, "right": b} for a, b in _steps(row["levels"], at)]
                    out["above"].append(own + row["above"])
            kinds = [batch.schema.field("tree").type, pa.int64(), _STEPS]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), kinds)], list(out))

    over = None
    for blocks in reversed(rounds):
        tops = above.select(F.col("tree").alias("ws_tree"), "above")
        met = blocks.where(f"total <= {BLOCK}").join(tops, _same((F.col("tree"), F.col("ws_tree"))))
        met = met.select(*blocks.columns, "above")
        if over is not None:
            lower = blocks.where(f"total > {BLOCK}").join(
                over, _same((F.col("tree"), F.col("ws_tree"))) & (F.col("block") == F.col("ws_block"))
            )
            met = met.unionByName(lower.select(*blocks.columns, "above"))
        kind = blocks.schema["tree"].dataType.simpleString()
        over = met.select("tree", "keys", "levels", "above").mapInArrow(
            spread, f"ws_tree {kind}, ws_block long, above {_WITNESS}"
        ) if blocks is not rounds[0] else met
    return over


def proofs(manifest: Manifest, with_witness: bool = True) -> DataFrame:
    """Per leaf ``(tree, key, leaf, subroot, root, proof_sha256, folded_root, verified[, witness])``.

    ``witness`` has the siblings of every level, from the leaf to the root, as ``left`` and ``right`` of the
    node, each the hexadecimal digests one after the other. ``proof_sha256`` is the digest of all siblings
    from left to right, level by level; ``folded_root`` is recomputed from the witness and the leaf's
    ``folded`` digest (its own where that is null), and ``verified`` says whether it is the root.
    """
    first = manifest.root().head()
    root = first.root if first is not None else ""
    none = F.array().cast(_WITNESS)
    over = _below(manifest.top, manifest.top[-1].select("tree", none.alias("above")))
    kinds = {f.name: f.dataType for f in manifest.trees[0].schema}
    tree, key = kinds["tree"].simpleString(), kinds["keys"].elementType.simpleString()

    def per_tree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            rows = [
                (k, [{"left": a, "right": b} for a, b in _steps(r["levels"], i)] + r["above"])
                for r in batch.to_pylist()
                for i, k in enumerate(r["keys"])
            ]
            kind = batch.schema.field("keys").type.value_type
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], kind), pa.array([r[1] for r in rows], _STEPS)], ["tree", "above"]
            )

    above = over.select("keys", "levels", "above").mapInArrow(per_tree, f"tree {tree}, above {_WITNESS}")
    schema = f"tree {tree}, key {key}, leaf string, subroot string, root string, proof_sha256 string"
    schema += ", folded_root string, verified boolean"
    schema += ", witness array<struct<left:string,right:string>>" if with_witness else ""

    def per_leaf(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _small(batches):
            kind = [batch.schema.field("tree").type, batch.schema.field("keys").type.value_type]
            kinds = [*kind, *[pa.string()] * 5, pa.bool_()]
            names = ["tree", "key", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
            if with_witness:
                kinds.append(pa.list_(pa.struct([("left", pa.string()), ("right", pa.string())])))
                names.append("witness")
            out = []
            for row in batch.to_pylist():
                inside = len(row["levels"])
                upper = [(s["left"].hex(), s["right"].hex()) for s in row["above"]]
                for at, (key, fold) in enumerate(zip(row["keys"], row["folded"])):
                    own = [(a.hex(), b.hex()) for a, b in _steps(row["levels"], at)]
                    leaf = row["levels"][0][at * 32 : at * 32 + 32].hex() if inside else row["root"].hex()
                    steps = own + upper
                    proof = sha256("".join(a + b for a, b in steps).encode()).hexdigest()
                    # Steps above the subroot are as many as the witness of the tree has.
                    subroot, folded = _fold(leaf, steps, len(steps) - row["tree_steps"])
                    if fold is not None:
                        _, folded = _fold(fold.hex(), steps, 0)
                    made = (row["tree"], key, leaf, subroot, root, proof, folded, folded == root)
                    out.append((*made, [{"left": a, "right": b} for a, b in steps]) if with_witness else made)
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], names)

    steps = above.select("tree", F.size("above").alias("tree_steps"), "above")
    blocks = _below(manifest.trees, steps.select("tree", "above"))
    sizes = steps.select(F.col("tree").alias("ws_tree"), "tree_steps")
    blocks = blocks.join(sizes, _same((F.col("tree"), F.col("ws_tree")))).drop("ws_tree")
    return blocks.mapInArrow(per_leaf, schema)


def _fold(node: str, steps: list[tuple[str, str]], inner: int) -> tuple[str, str]:
    """Nodes reached from ``node`` after ``inner`` steps of its witness, and after all of them."""
    mid = node
    for k, (left, right) in enumerate(steps):
        if k == inner:
            mid = node
        node = sha256((left + node + right).encode()).hexdigest()
    return (node if inner >= len(steps) else mid), node
