"""Lines that repeat an earlier line, exactly or within one edit.

A line emits its variants: itself, and itself without one character, as hashed keys. Two lines within
one edit (a character changed, added or dropped) share a key, and a key holds what makes
the check exact without pairs:

* a changed character: both lines without the character at that place, so the key is (variant, place)
  and everything under it is within one edit of everything else;
* an added or dropped one: the shorter line as it is, and the longer one without a character. Under the
  key the shorter line meets the longer ones; it needs the earliest of them, and they need it.

So a group of lines under a key is an aggregate of two minima, however many lines it has, and each line
finds the earliest line within one edit. Of all lines only those emit variants that agree with another
line but for a small part: cut into equal parts, two lines within one edit differ in one of them, and
what stands before it, counted from the start, and after it, counted from the end, is the same. Four
parts sieve all lines, more and more parts those that are left, and only within a part that may hold an
edit are characters left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from string import ascii_lowercase, ascii_uppercase

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspark.llm.tables import sieved, written
from webspark.llm.words import BYTE_VALUES, LOWER, chunks, inverse, mix, powers, powers_for

# Shorter lines are left alone, unless the caller gives other floors.
MIN_CHARS = 32
# Floors for cleaning: exact repeats of every line with a word, and repeats within one edit from so many
# characters. In the tables (sf0.1) 354 pairs of lines of 4 to 9 characters are within one edit, mostly
# other words; the 13 pairs of 10 characters or more are mostly one line with another punctuation mark.
EXACT_CHARS, NEAR_CHARS = 1, 10
# Parts of a line in the sieves, one after the other.
PARTS = (4, 32, 128)

_ODD = np.uint64(0xE7037ED1A0B428DB)


def _sizes() -> np.ndarray:
    """Sizes a sixteenth apart; a line counts with the largest one up to its length."""
    out = [4]
    while out[-1] < 1 << 31:
        out.append(max(out[-1] + 1, out[-1] * 17 // 16))
    return np.array(out, np.int64)


SIZES = _sizes()
# Bytes that make a word of a line.
WORDLY = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _part_keys(ranges, first: np.ndarray, chars: np.ndarray, size: np.ndarray, parts: int) -> np.ndarray:
    """Keys of a line, each of all but one of ``parts`` parts of ``size`` characters; the last one leaves
    out everything beyond the others. ``ranges`` hashes runs of characters."""
    cuts = [k * size // parts for k in range(parts + 1)]
    keys = []
    for k in range(parts):
        before = ranges(first, first + cuts[k])
        after = ranges(first + chars - (size - cuts[k + 1]), first + chars)
        keys.append(mix(before * _ODD + after + (size * parts + k).astype(np.uint64)))
    return np.stack(keys, 1)


def scan_lines(
    texts: pa.Array, min_chars: int, parts: int, exact_chars: int | None = None
) -> Iterator[tuple[np.ndarray, ...]]:
    """(row, line number, hash, second hash, keys, keys per line) of the lines of runs of texts.

    Lines below ``min_chars``, but not below ``exact_chars``, come without keys if they have a word: an
    ASCII letter or digit, or anything outside ASCII. Lines end at a line feed; A-Z are lower-cased, and spaces around a line don't count. All lines of a
    run are handled at once: a hash of any part of a text is the difference of two prefix sums.
    """
    for row, _, data, offsets in chunks(texts):
        data = LOWER[data]
        n = len(data)
        feeds = np.flatnonzero(data == 10)
        starts = np.concatenate([offsets[:-1], feeds + 1])
        text = np.concatenate([np.arange(len(offsets) - 1), np.searchsorted(offsets, feeds, "right") - 1])
        number = np.searchsorted(feeds, starts) - np.searchsorted(feeds, offsets[text])
        ends = np.minimum(np.append(feeds, n)[np.searchsorted(feeds, starts)], offsets[text + 1])
        solid = np.append(np.flatnonzero(data != 32), n)
        starts = np.minimum(solid[np.searchsorted(solid, starts)], ends)
        ends = np.maximum(starts, np.append(-1, solid)[np.searchsorted(solid, ends)] + 1)
        lead = (data & 0xC0) != 0x80
        places = np.append(np.flatnonzero(lead), n)
        before = np.concatenate([[0], np.cumsum(lead)])
        first, chars = before[starts], before[ends] - before[starts]
        floor = max(min_chars, int(SIZES[0]))
        use = chars >= floor
        if exact_chars is not None:
            word = np.concatenate([[0], np.cumsum(WORDLY[data])])
            use |= (chars >= exact_chars) & (word[ends] > word[starts])
        first, chars, text, number = first[use], chars[use], text[use], number[use]
        power, back = powers_for(n)
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(BYTE_VALUES[data] * power[:n], out=total[1:])

        def ranges(a: np.ndarray, b: np.ndarray, places=places, total=total, back=back) -> np.ndarray:
            x, y = places[a], places[b]
            return mix((total[y] - total[x]) * back[x] + (y - x).astype(np.uint64))

        whole = ranges(first, first + chars)
        half = chars // 2
        check = mix(ranges(first, first + half) * _ODD ^ ranges(first + half, first + chars))
        keyed = np.flatnonzero(chars >= floor)
        first, long = first[keyed], chars[keyed]
        size = SIZES[np.searchsorted(SIZES, long, "right") - 1]
        keys = _part_keys(ranges, first, long, size, parts)
        # One character more may take a line to the next size.
        edge = np.flatnonzero(SIZES[np.searchsorted(SIZES, long + 1, "right") - 1] != size)
        more = _part_keys(ranges, first[edge], long[edge], long[edge] + 1, parts)
        many = np.zeros(len(chars), np.int64)
        many[keyed] = parts
        many[keyed[edge]] = 2 * parts
        flat = np.concatenate([keys.ravel(), more.ravel()])
        owner = np.concatenate([np.repeat(keyed, parts), np.repeat(keyed[edge], parts)])
        yield row + text, number, whole, check, flat[np.argsort(owner, kind="stable")], many


def _lines(docs: DataFrame, min_chars: int, id_column: str, text_column: str, exact_chars: int | None = None) -> DataFrame:
    """``(place, hash, check, keys)`` of every line that counts. Places order by document, then line;
    documents without an id come last, and a hash of the row's text keeps apart rows that share an id."""
    doc, text = F.col(id_column), F.col(text_column)
    kind = docs.schema[id_column].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, number, whole, check, keys, many in scan_lines(batch.column(2), min_chars, PARTS[0], exact_chars):
                at = pa.array(row)
                ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(at),
                        batch.column(1).take(at),
                        pa.array(number.astype(np.int32)),
                        pa.array(whole.view(np.int64)),
                        pa.array(check.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64))),
                    ],
                    names=["doc_id", "twin", "line_no", "hash", "check", "keys"],
                )

    made = docs.where(text.isNotNull()).select(doc.alias("doc_id"), F.xxhash64(text).alias("twin"), text).mapInArrow(
        rows, f"doc_id {kind}, twin long, line_no int, hash long, check long, keys array<long>"
    )
    place = F.struct(F.col("doc_id").isNull().alias("missing"), "doc_id", "twin", "line_no")
    return made.select(place.alias("place"), "hash", "check", "keys")


def _sharing(keys: DataFrame) -> DataFrame:
    """``(hash, part)`` of the lines of ``keys(hash, keys)`` and their keys that a different line has too.
    The sieve lets hardly any other key into the shuffle."""
    keys = keys.select("hash", F.posexplode("keys").alias("part", "key"))
    shared = keys.groupBy("key").agg(F.min("hash").alias("a"), F.max("hash").alias("b")).where("a <> b").select("key")
    shared = written(shared, "shared-keys")
    return sieved(keys, "key", shared, "key").join(shared, "key").select("hash", "part")


def _finer(lines: DataFrame, parts: int) -> DataFrame:
    """The lines of ``lines(line, hash, ...)`` that agree with another one but for one of ``parts`` parts,
    and which, as ``open``."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, _, _, _, keys, many in scan_lines(batch.column(1), 1, parts):
                ends = np.concatenate([[0], np.cumsum(many)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(keys.view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), lists], names=["hash", "keys"])

    near = _sharing(lines.select("hash", "line").mapInArrow(rows, "hash long, keys array<long>"))
    near = near.groupBy("hash").agg(F.collect_set("part").alias("open"))
    return written(lines.drop("open").join(near, "hash").select("hash", "check", "place", "line", "open"), "near-lines")


def open_places(chars: int, parts: list[int], of: int) -> np.ndarray:
    """Places of the characters within the numbered parts of :func:`scan_lines`' keys; from ``of`` on they
    are those of a line one character longer."""
    found = np.zeros(chars, bool)
    size = int(SIZES[np.searchsorted(SIZES, chars, "right") - 1])
    for part in parts:
        whole, k = (size, part) if part < of else (chars + 1, part - of)
        end = chars if k == of - 1 else (k + 1) * whole // of
        found[k * whole // of : end] = True
    return np.flatnonzero(found)


def _variants(lines: DataFrame, of: int) -> DataFrame:
    """``lines(place, line, open)`` with (key, role) of every variant. Roles: 0 the place of the missing
    character is part of the key, 1 the line itself, 2 the line without a character."""

    def keys_of(text: str, parts: list[int]) -> tuple[np.ndarray, np.ndarray]:
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        n = len(points)
        value = mix(points + np.uint64(0x632BE59BD9B4E019)) * powers(n)
        before = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value, dtype=np.uint64)])
        at = open_places(n, parts, of)
        # Without character i: what comes after it moves one place to the left.
        variant = before[at] + (before[-1] - before[at + 1]) * inverse()
        lengths = np.array([n - 1, n], np.uint64) * _ODD
        place = at.astype(np.uint64) + np.uint64(1)
        changed = mix(mix(variant + np.uint64(n)) + place * np.uint64(0xA0761D6478BD642F))
        own = mix(before[-1:] + lengths[1:])
        # A run of one character gives the same variant over and over.
        shorter = np.unique(mix(variant + lengths[:1]))
        keys = np.concatenate([changed, own, shorter]).view(np.int64)
        return keys, np.repeat(np.array([0, 1, 2], np.int8), [len(at), 1, len(shorter)])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [keys_of(t.as_py(), o.as_py()) for t, o in zip(batch.column(0), batch.column(1), strict=True)]
            ends = np.concatenate([[0], np.cumsum([len(k) for k, _ in made])]).astype(np.int32)
            keys = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *[k for k, _ in made]])))
            roles = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int8), *[r for _, r in made]])))
            yield pa.RecordBatch.from_arrays([*batch.columns[2:], keys, roles], names=["hash", "check", "place", "keys", "roles"])

    place = lines.schema["place"].dataType.simpleString()
    made = lines.select("line", "open", "hash", "check", "place").mapInArrow(
        rows, f"hash long, check long, place {place}, keys array<long>, roles array<tinyint>"
    )
    return made.select("hash", "check", "place", F.explode(F.arrays_zip("keys", "roles")).alias("v")).select(
        "hash", "check", "place", F.col("v.keys").alias("key"), F.col("v.roles").alias("role")
    )


def duplicate_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    id_column: str = "doc_id",
    text_column: str = "text",
    exact_chars: int | None = None,
) -> DataFrame:
    """``(doc_id, twin, line_no, kept_doc_id, kept_line_no, distance)`` of every line that repeats an
    earlier one.

    Lines end at a line feed, count from 0, and are compared with A-Z lower-cased and without spaces
    around them. A line is a repeat when an earlier line (by document id, then place) equals it or is one edit
    away, whether or not that one is a repeat itself; the earliest such line is named, with its
    distance, 0 or 1. Lines of fewer than ``min_chars`` characters are no repeats, nor are lines of a
    null or empty text. With ``exact_chars``, lines between the two floors that have a word are repeats of
    lines that they equal. Rows equal in id and text are one document; ``twin``, a hash of the text, tells
    rows apart that share only the id. Documents without an id come last. An empty table gives an empty
    one; other columns are not read.
    """
    lines = written(_lines(docs, min_chars, id_column, text_column, exact_chars), "lines")
    same = ["hash", "check"]
    distinct = written(
        lines.groupBy(*same).agg(F.min("place").alias("place"), F.count("*").alias("n")), "distinct-lines"
    )
    near = _sharing(lines).select("hash").distinct()
    near = written(sieved(distinct, "hash", near, "hash").join(near, "hash").select(*same, "place"), "near-places")
    # Their texts, from the documents that hold their first places.
    wanted = near.groupBy(F.col("place.doc_id").alias("ws_doc"), F.col("place.twin").alias("twin")).agg(
        F.collect_list(F.struct(*same, "place")).alias("ws_lines")
    )
    texts = docs.select(F.col(id_column).alias("ws_doc"), F.col(text_column).alias("ws_text")).where(
        F.col("ws_text").isNotNull()
    )
    texts = sieved(texts.withColumn("twin", F.xxhash64("ws_text")), "twin", wanted, "twin")
    meets = F.col("l.ws_doc").eqNullSafe(F.col("r.ws_doc")) & (F.col("l.twin") == F.col("r.twin"))
    placed = texts.alias("l").join(wanted.alias("r"), meets).select(
        F.split("ws_text", "\n").alias("ws_all"), F.explode("ws_lines").alias("ws_at")
    )
    line = F.translate(F.trim(F.get("ws_all", F.col("ws_at.place.line_no"))), ascii_uppercase, ascii_lowercase)
    near_lines = written(
        placed.select("ws_at.hash", "ws_at.check", "ws_at.place", line.alias("line")).dropDuplicates(same),
        "near-lines",
    )
    for parts in PARTS[1:]:
        near_lines = _finer(near_lines, parts)
    variants = written(_variants(near_lines, PARTS[-1]), "variants")
    plain = F.col("role") != 1
    least = variants.groupBy("key").agg(
        F.min(F.when(plain, F.col("place"))).alias("others"),
        F.min(F.when(~plain, F.col("place"))).alias("own"),
        F.count("*").alias("ws_n"),
    ).where("ws_n > 1")
    # A changed character: everything under the key. An added one: the other role.
    partner = F.when(F.col("role") == 2, F.col("own")).otherwise(F.col("others"))
    partners = (
        variants.join(least, "key")
        .select(*same, "place", partner.alias("kept"))
        .where("kept < place")
        .groupBy(*same)
        .agg(F.min("place").alias("place"), F.min("kept").alias("kept"))
    )
    a = near_lines.select(*same, F.col("line").alias("ws_line"))
    b = near_lines.select(F.col("place").alias("kept"), F.col("line").alias("ws_other"))
    checked = (
        partners.join(a, same)
        .join(b, "kept")
        .where(F.levenshtein("ws_line", "ws_other") == 1)
        .select(*same, "kept")
    )
    named = (
        distinct.select(*same, "place", "n")
        .join(checked, same, "left")
        .where("n > 1 OR kept IS NOT NULL")
        .select(*same, F.col("place").alias("first"), F.coalesce("kept", "place").alias("kept"))
    )
    # A line under a third of all documents is a hot key here; a plain join, which Spark can split.
    named = written(named, "named-lines")
    repeats = sieved(lines.select(*same, "place"), "hash", named, "hash").join(named, same).where("kept < place")
    return repeats.select(
        "place.doc_id",
        "place.twin",
        "place.line_no",
        F.col("kept.doc_id").alias("kept_doc_id"),
        F.col("kept.line_no").alias("kept_line_no"),
        (F.col("kept") != F.col("first")).cast("int").alias("distance"),
    )


def dedup_lines(
    docs: DataFrame,
    min_chars: int = MIN_CHARS,
    id_column: str = "doc_id",
    text_column: str = "text",
    exact_chars: int | None = None,
) -> DataFrame:
    """The documents without the lines that repeat an earlier one (:func:`duplicate_lines`), all columns
    kept, and ``lines_removed``. Lines that stay are joined by line feeds as they were; texts without a
    repeat are untouched, null stays null."""
    gone = (
        duplicate_lines(docs, min_chars, id_column, text_column, exact_chars)
        .groupBy(F.col("doc_id").alias("ws_doc"), F.col("twin").alias("ws_twin"))
        .agg(F.collect_set("line_no").alias("ws_gone"))
    )
    text = F.col(text_column)
    meets = F.col(id_column).eqNullSafe(F.col("ws_doc")) & (F.xxhash64(text) == F.col("ws_twin"))
    at = F.array_except(F.expr(f"sequence(0, size(split(`{text_column}`, '\\\\n')) - 1)"), F.col("ws_gone"))
    all_lines = F.split(text, "\n")
    rest = F.array_join(F.transform(at, lambda k: F.get(all_lines, k)), "\n")
    joined = docs.join(gone, meets, "left")
    names = [c for c in docs.columns if c != "lines_removed"]
    return joined.select(
        *[F.when(F.col("ws_gone").isNull(), text).otherwise(rest).alias(c) if c == text_column else F.col(f"`{c}`") for c in names],
        F.coalesce(F.size("ws_gone"), F.lit(0)).alias("lines_removed"),
    )
