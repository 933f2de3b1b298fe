"""Collocations: phrases of words that stand together more often than their parts explain.

The phrases of a corpus are the nodes of a suffix tree over its words, cut at the longest length asked
for, and a phrase's frequency is the number of leaves below its node. The tree is partitioned vertically:
word prefixes are gathered into groups of at most a budget of suffixes, and the subtree of each group is
built on its own by one task that sorts the group's suffixes and adds up their leaves. Depth grows with
the frequent nodes only: a suffix is extended by a word where both nodes it would join are frequent, so
the rare majority of suffixes is never shuffled. This is exact, since a part of a frequent phrase is
frequent.

Equal suffixes of a task are one row with a count before they are shuffled, so a pair that a third of all
texts repeat is a few rows; prefixes beyond the budget are split by their continuations. Words are 64-bit
ids with their language in it; ids that two words share are detected, and the ids drawn anew.

Words are runs without white space inside pieces of text; A-Z are lower-cased, a null text is empty, a
null language is ``und``. Empty and repeated rows count as they are; an empty table has no phrases. Other
columns are not read, whatever their names. Long texts are taken in parts that end with a piece.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from webspark.llm.tables import written
from webspark.llm.words import BYTE_VALUES, CHUNK_BYTES, LOWER, chunks, mix, powers_for

MAX_WORDS = 3
LEAST = 10
TOP = 2000
# A phrase goes if a longer one that holds it has at least this share of its occurrences.
WITHIN_PERCENT = 50
SCALE = 1_000_000
# Suffixes of a group of prefixes: the memory of a subtree.
GROUP_SUFFIXES = 1 << 18
# Suffixes that a task gathers before it counts equal ones.
GATHER = 1 << 19
# Parts of the space of first words that groups are made of; bounds what the driver sees.
BUCKET_BITS = 16
# A sieve has 16 bits a key up to this bound; more keys only let more suffixes through.
SIEVE_BITS = 1 << 27
# Rows of a table by language that may go to every task.
MANY_LANGUAGES = 1 << 15

_ODD = np.uint64(0x9E3779B97F4A7C15)
_WORD, _WHITE, _END = 0, 1, 2
_KINDS = np.zeros(256, np.uint8)
_KINDS[[0x20, 0x09]] = _WHITE
_KINDS[[*map(ord, ".,;:!?"), *range(0x0A, 0x0E)]] = _END


def _parts(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bytes, offsets) of a run of texts; a text far beyond the size of a run in parts that end with a
    piece, so no phrase is cut."""
    if len(offsets) > 2 or len(data) <= 4 * CHUNK_BYTES:
        yield data, offsets
        return
    ends = np.flatnonzero(_KINDS[data] == _END) + 1
    at = 0
    while at < len(data):
        k = int(np.searchsorted(ends, at + CHUNK_BYTES))
        end = int(ends[k]) if k < len(ends) else len(data)
        yield data[at:end], np.array([0, end - at])
        at = end


def _word_ids(batch: pa.RecordBatch, seed: int) -> Iterator[tuple]:
    """Per run of texts: ids of the words, whether the next word follows in the same piece, starts, ends,
    lower-cased bytes, and the words' languages as places in a list of names."""
    langs = batch.column(0).cast(pa.string()).fill_null("und").dictionary_encode()
    names = langs.dictionary.to_pylist()
    keys = np.array([_lang_key(n, seed) for n in names], np.uint64)
    codes = langs.indices.to_numpy(zero_copy_only=False)
    for first, last, whole, spans in chunks(batch.column(1)):
        for data, offsets in _parts(whole, spans):
            low, kind = LOWER[data], _KINDS[data]
            inside = np.zeros(len(low) + 2, bool)
            inside[1:-1] = kind == _WORD
            edge = np.diff(inside.astype(np.int8))
            starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
            cut = offsets[1:-1]
            cut = cut[(cut > 0) & (cut < len(low))]
            cut = np.unique(cut[inside[cut] & inside[cut + 1]])
            starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
            power, back = powers_for(len(low))
            total = np.zeros(len(low) + 1, np.uint64)
            np.cumsum(BYTE_VALUES[low] * power[: len(low)], out=total[1:])
            ids = (total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64)
            row = np.searchsorted(offsets, starts, "right") - 1
            lang = codes[first:last][row]
            ids = mix(mix(ids) ^ keys[lang])
            pieces = np.zeros(len(low) + 1, np.int32)
            np.cumsum(kind == _END, out=pieces[1:], dtype=np.int32)
            follows = np.zeros(len(ids), bool)
            follows[:-1] = (pieces[ends[:-1]] == pieces[starts[1:]]) & (row[:-1] == row[1:])
            yield ids, follows, starts, ends, low, lang, names


def _lang_key(name: str, seed: int) -> int:
    return int.from_bytes(blake2b(f"{seed} {name}".encode(), digest_size=8).digest(), "little")


def _path(keys: np.ndarray, nexts: np.ndarray) -> np.ndarray:
    """Keys of paths one word longer."""
    return mix(keys * _ODD + nexts)


def _segments(columns: list[np.ndarray], order: np.ndarray) -> np.ndarray:
    """Starts of runs of rows that agree in all columns, in the given order."""
    new = np.ones(len(order), bool)
    if len(order):
        new[1:] = False
        for c in columns:
            new[1:] |= c[order][1:] != c[order][:-1]
    return np.flatnonzero(new)


def _signed(a: np.ndarray) -> pa.Array:
    return pa.array(a.view(np.int64))


def _count_words(seed: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Words of a task with their counts, and per language a row without a word for all of them."""

    def flush(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        totals: dict[str, int] = {}
        for ids, lang, names, *_ in held:
            for code, n in enumerate(np.bincount(lang, minlength=len(names))):
                totals[names[code]] = totals.get(names[code], 0) + int(n)
        sizes = np.cumsum([0] + [len(h[5]) for h in held])
        ids = np.concatenate([h[0] for h in held])
        starts = np.concatenate([h[3] + s for h, s in zip(held, sizes)])
        ends = np.concatenate([h[4] + s for h, s in zip(held, sizes)])
        which = np.repeat(np.arange(len(held)), [len(h[0]) for h in held])
        data = np.concatenate([h[5] for h in held]).tobytes()
        uniq, at, counts = np.unique(ids, return_index=True, return_counts=True)
        words = [data[s:e].decode() for s, e in zip(starts[at].tolist(), ends[at].tolist())]
        code = np.concatenate([h[1] for h in held])[at]
        langs = [held[w][2][c] for w, c in zip(which[at].tolist(), code.tolist())]
        keys = np.array([_lang_key(n, seed) for n in totals], np.uint64)
        yield pa.RecordBatch.from_arrays(
            [
                _signed(np.concatenate([uniq, keys])),
                pa.array(langs + list(totals), pa.string()),
                pa.array(words + [None] * len(totals), pa.string()),
                pa.array(np.concatenate([counts, list(totals.values())]).astype(np.int64)),
            ],
            ["w0", "lang", "phrase", "f"],
        )

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for ids, _, starts, ends, low, lang, names in _word_ids(batch, seed):
                if len(ids):
                    held.append((ids, lang, names, starts, ends, low))
                    n += len(ids)
                if n >= GATHER:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return count


def words(docs: DataFrame, least: int, lang_column: str, text_column: str) -> tuple[DataFrame, DataFrame, int]:
    """Frequent words ``(w0, lang, phrase, f)``, all words per language ``(lang, n)``, and the seed of the
    ids. A seed under which a frequent word shares its id is given up."""
    texts = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    for seed in range(64):
        rows = texts.mapInArrow(_count_words(seed), "w0 long, lang string, phrase string, f long")
        counted = rows.groupBy("w0").agg(
            F.max("lang").alias("lang"), F.max("phrase").alias("phrase"), F.sum("f").alias("f"),
            F.expr("min(phrase) <> max(phrase) OR min(lang) <> max(lang) OR count(phrase) NOT IN (0, count(*))").alias("shared"),
        )
        counted = written(counted.where((F.col("f") >= least) | F.col("phrase").isNull()), "collocation-words")
        if counted.where("shared").isEmpty():
            break
    frequent = counted.where("phrase IS NOT NULL").select("w0", "lang", "phrase", "f")
    return frequent, counted.where("phrase IS NULL").select("lang", F.col("f").alias("n")), seed


@dataclass
class _Sieve:
    """Bits of keys, two per key, of a fixed size at most."""

    bits: int
    marks: np.ndarray

    def may_have(self, keys: np.ndarray) -> np.ndarray:
        out = np.ones(len(keys), bool)
        for p in _places(keys, self.bits):
            out &= (self.marks[p >> np.uint64(6)] >> (p & np.uint64(63))) & np.uint64(1) == 1
        return out


def _places(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return keys & mask, (keys >> np.uint64(32)) & mask


def _sieve(nodes: DataFrame, depth: int, count: int) -> _Sieve:
    """Sieve of the paths of a table of nodes."""
    bits = 1 << 12
    while bits < min(16 * count, SIEVE_BITS):
        bits *= 2

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        marks = np.zeros(bits // 64, np.uint64)
        for batch in batches:
            columns = [c.to_numpy(zero_copy_only=False).view(np.uint64) for c in batch.columns]
            keys = columns[0]
            for c in columns[1:]:
                keys = _path(keys, c)
            for p in _places(keys, bits):
                np.bitwise_or.at(marks, p >> np.uint64(6), np.uint64(1) << (p & np.uint64(63)))
        at = np.flatnonzero(marks)
        yield pa.RecordBatch.from_arrays([pa.array(at), _signed(marks[at])], ["at", "marks"])

    made = nodes.select(*_names(depth)).mapInArrow(mark, "at long, marks long")
    made = made.groupBy("at").agg(F.bit_or("marks").alias("marks")).toArrow()
    marks = np.zeros(bits // 64, np.uint64)
    marks[made.column("at").to_numpy()] = made.column("marks").to_numpy().view(np.uint64)
    return _Sieve(bits, marks)


def _names(depth: int) -> list[str]:
    return [f"w{k}" for k in range(depth)]


@dataclass
class _Groups:
    """Groups of prefixes: a first group per bucket of first words, and into how many a bucket that is
    larger than a group is split by its suffixes."""

    first: np.ndarray
    split: np.ndarray

    def of(self, words: np.ndarray, paths: np.ndarray) -> np.ndarray:
        bucket = (words >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
        return self.first[bucket] + (paths % self.split[bucket].astype(np.uint64)).astype(np.int64)


def _groups(nodes: DataFrame, budget: int) -> _Groups:
    """Vertical partitioning: consecutive buckets of first words share a group while the occurrences of
    their nodes, which bound the suffixes to come, are within the budget."""
    bucket = F.expr(f"shiftrightunsigned(w0, {64 - BUCKET_BITS})")
    weights = np.zeros(1 << BUCKET_BITS, np.int64)
    for row in nodes.groupBy(bucket.alias("b")).agg(F.sum("f").alias("f")).collect():
        weights[row.b] = row.f
    split = np.maximum(1, -(-weights // budget))
    first, group, room = np.zeros(len(weights), np.int64), -1, 0
    for b, weight in enumerate(weights.tolist()):
        if split[b] > 1 or weight > room:
            group += 1
            room = budget
        first[b] = group
        room -= weight
        if split[b] > 1:
            group, room = group + int(split[b]) - 1, 0
    return _Groups(first, split)


def _suffixes(depth: int, seed: int, sieves, groups) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Suffixes of ``depth`` words whose nodes may be frequent one level up, counted per task."""

    def flush(held: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        columns = [np.concatenate(c) for c in zip(*held)]
        held.clear()
        # Equal keys nearly always mean equal paths; if not, a path only has more than one row.
        order = np.argsort(columns[-1], kind="stable")
        at = _segments(columns[:-1], order)
        counts = np.diff(np.append(at, len(order)))
        columns = [c[order[at]] for c in columns]
        group = groups.value.of(columns[0], columns[-1])
        arrays = [pa.array(group), *map(_signed, columns[:-1]), pa.array(counts.astype(np.int64))]
        batch = pa.RecordBatch.from_arrays(arrays, ["g", *_names(depth), "f"])
        for k in range(0, batch.num_rows, 1 << 16):
            yield batch.slice(k, 1 << 16)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            for ids, follows, *_ in _word_ids(batch, seed):
                keys, ok = ids, sieves.value[0].may_have(ids)
                for d in range(2, depth + 1):
                    if len(ids) < d:
                        keys, ok = ids[:0], ok[:0]
                        break
                    # Both nodes that the longer path joins may be frequent, and it stays in a piece.
                    ok = ok[:-1] & ok[1:] & follows[: len(ok) - 1]
                    keys = _path(keys[:-1], ids[d - 1 :])
                    if d < depth:
                        ok[ok] = sieves.value[d - 1].may_have(keys[ok])
                at = np.flatnonzero(ok)
                if len(at):
                    held.append([*(ids[at + k] for k in range(depth)), keys[at]])
                    n += len(at)
                if n >= GATHER:
                    yield from flush(held)
                    held, n = [], 0
        if held:
            yield from flush(held)

    return emit


def _subtrees(depth: int, least: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Nodes of the full depth of every group's subtree: its suffixes sorted, the leaves of equal ones
    added up. Rows come group by group."""

    def nodes(held: list[list[np.ndarray]]) -> pa.RecordBatch:
        columns = [np.concatenate(c) for c in zip(*held)]
        order = np.lexsort(columns[depth - 1 :: -1])
        at = _segments(columns[:depth], order)
        total = np.add.reduceat(columns[depth][order], at)
        keep = total >= least
        at, total = at[keep], total[keep]
        arrays = [pa.array(c[order[at]]) for c in columns[:depth]]
        return pa.RecordBatch.from_arrays([*arrays, pa.array(total)], [*_names(depth), "f"])

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, group = [], None
        for batch in batches:
            g, *columns = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
            edges = np.flatnonzero(np.diff(g)) + 1
            for a, b in zip([0, *edges], [*edges, len(g)]):
                if a == b:
                    continue
                if held and g[a] != group:
                    yield nodes(held)
                    held = []
                group = g[a]
                held.append([c[a:b] for c in columns])
        if held:
            yield nodes(held)

    return build


def phrase_tree(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    least: int = LEAST,
    group_suffixes: int = GROUP_SUFFIXES,
    lang_column: str = "lang",
    text_column: str = "text",
) -> tuple[list[DataFrame], DataFrame]:
    """Frequent phrases by their number of words, from one: ``(w0.., lang, phrase, f)`` each, written
    tables; and ``(lang, n)``, the words of a language."""
    single, totals, seed = words(docs, least, lang_column, text_column)
    context = docs.sparkSession.sparkContext
    texts = docs.select(F.col(lang_column).cast("string").alias("lang"), F.col(text_column).cast("string").alias("text"))
    levels, sieves, nodes = [single], [], single
    for depth in range(2, max_words + 1):
        sieves.append(_sieve(nodes, depth - 1, nodes.count()))
        kinds = ", ".join(f"{c} long" for c in [*_names(depth), "f"])
        shared = context.broadcast(list(sieves)), context.broadcast(_groups(nodes, group_suffixes))
        found = texts.mapInArrow(_suffixes(depth, seed, *shared), f"g long, {kinds}")
        dealt = found.repartition("g").sortWithinPartitions("g")
        nodes = written(dealt.mapInArrow(_subtrees(depth, least), kinds), "collocation-nodes")
        levels.append(nodes)
    return levels, totals


def _score(l: Column, r: Column) -> Column:
    """Whole part of SCALE * a * a / (l * r), exactly: decimals hold the products."""
    wide = "decimal(18,0)"
    return F.call_function(
        "div", F.col("f").cast(wide) * F.col("f").cast(wide) * F.lit(SCALE).cast("decimal(7,0)"), l.cast(wide) * r.cast(wide)
    )


def _part(nodes: DataFrame, size: int, offset: int, prefix: str) -> tuple[DataFrame, Column]:
    """Nodes of ``size`` words to be met by words ``offset``.. of longer ones."""
    side = nodes.select(
        *[F.col(f"w{k}").alias(f"{prefix}{k}") for k in range(size)],
        *[F.col(c).alias(f"{prefix}_{c}") for c in ("f", "phrase", "lang") if c in nodes.columns],
    )
    met = F.lit(True)
    for k in range(size):
        met = met & (F.col(f"w{offset + k}") == F.col(f"{prefix}{k}"))
    return side, met


def collocations(
    docs: DataFrame,
    max_words: int = MAX_WORDS,
    least: int = LEAST,
    within_percent: int = WITHIN_PERCENT,
    group_suffixes: int = GROUP_SUFFIXES,
    lang_column: str = "lang",
    text_column: str = "text",
) -> DataFrame:
    """Phrases of two words or more ``(lang, phrase, words, a, l, r, cut, score, n)``: ``a`` occurrences, and of
    the cut with the lowest score (of several the first) ``l`` and ``r`` those of its parts; ``n`` words are in
    the language. Left out are phrases that stand mostly within a longer one."""
    levels, totals = phrase_tree(docs, max_words, least, group_suffixes, lang_column, text_column)
    named, scored = [levels[0]], []
    for d in range(2, max_words + 1):
        frame, cuts = levels[d - 1], []
        for k in range(1, d):
            left, on_left = _part(named[k - 1], k, 0, f"l{k}_")
            right, on_right = _part(named[d - k - 1], d - k, k, f"r{k}_")
            frame = frame.join(left, on_left).join(right, on_right)
            l, r = F.col(f"l{k}__f"), F.col(f"r{k}__f")
            cuts.append(F.struct(_score(l, r).alias("score"), F.lit(k).alias("cut"), l.alias("l"), r.alias("r")))
        frame = written(
            frame.select(
                *_names(d), "f",
                F.col("l1__lang").alias("lang"),
                F.concat_ws(" ", "l1__phrase", "r1__phrase").alias("phrase"),
                F.array_min(F.array(*cuts)).alias("best"),
            ),
            "collocation-phrases",
        )
        named.append(frame.select(*_names(d), "f", "lang", "phrase"))
        scored.append(frame)
    out = None
    for d, frame in enumerate(scored, 2):
        if d < max_words:
            longer, names = scored[d - 1], _names(d)
            ends = [longer.select(*[F.col(f"w{k + s}").alias(f"x{k}") for k in range(d)], "f") for s in (0, 1)]
            most = ends[0].unionByName(ends[1]).groupBy(*[f"x{k}" for k in range(d)]).agg(F.max("f").alias("most"))
            met = F.lit(True)
            for k, name in enumerate(names):
                met = met & (F.col(name) == F.col(f"x{k}"))
            within = F.col("most").isNotNull() & (100 * F.col("most") >= within_percent * F.col("f"))
            frame = frame.join(most, met, "left").where(~within)
        frame = frame.select("lang", "phrase", F.lit(d).alias("words"), F.col("f").alias("a"), "best.*")
        out = frame if out is None else out.unionByName(frame)
    return _per_language(out, totals)


def _per_language(frame: DataFrame, side: DataFrame) -> DataFrame:
    """``frame`` with the columns of ``side``, a row per language. Languages are few, so their rows go to every
    task; where a text column passes for a language and they are many, both sides are dealt by it."""
    side = side.withColumnRenamed("lang", "ws_lang")
    if side.limit(MANY_LANGUAGES + 1).count() <= MANY_LANGUAGES:
        side = F.broadcast(side)
    return frame.join(side, F.col("lang") == F.col("ws_lang")).drop("ws_lang")


def top(found: DataFrame, count: int = TOP) -> DataFrame:
    """The first phrases of each language by score, occurrences and text, with their ``rank``. Phrases are
    counted per thousandth of the scale first, so that few beyond ``count`` of a language meet in one task."""
    found = written(found, "collocations")
    step = F.floor(F.col("score") * 1000 / SCALE)
    steps = found.groupBy("lang", step.alias("ws_step")).agg(F.count("*").alias("ws_n"))
    above = F.sum("ws_n").over(Window.partitionBy("lang").orderBy(F.desc("ws_step"))) - F.col("ws_n")
    needed = steps.withColumn("ws_above", above).where(F.col("ws_above") < count)
    least = written(needed.groupBy("lang").agg(F.min("ws_step").alias("ws_least")), "collocation-steps")
    high = _per_language(found, least).where(step >= F.col("ws_least")).drop("ws_least")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = high.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= count)
    return ranked.withColumn("rank", F.col("rank").cast("long"))
