"""Best-fit packing of documents into token sequences, after Martello-Toth dominance reduction.

Lengths are whole numbers up to the capacity, so an instance is a table of counts per length: at most
``capacity`` rows, whatever the number of documents. The plan (which lengths share a sequence, and how
often) is made on that table; documents then find their places by their rank among the documents of
the same length, in slices, so that a length shared by a third of all documents is no hot key.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from webspark.llm.tables import written

CAPACITY = 2048
END_ID = 0
# Rows of a slice in which pieces of one length are numbered.
SLICE_ROWS = 4096

# The pattern of the vocabulary's pre-tokens is in public_tokenizers.PATTERN.
# Letters for which the rank-based encoder is known to cut like the tokenizer file (see tests).
_PLAIN = regex.compile(r"^[\x00-ɏ]*$")
# The rank-based encoder recurses over white space; from so many characters in a row on, the tokenizer file
# itself encodes a text.
LONG_GAP = 4096
_GAP = regex.compile(r"\s{64,}+")

_ENCODERS: dict[tuple[str, str], object] = {}


def _encoder(tokenizer: str, ranks: str | None):
    """A function text -> ids, made once per worker process.

    The tokenizer file defines the ids. Its vocabulary as ranks gives the same ids several times
    faster, and is used for texts of plain Latin characters without very long white space; every other
    text goes through the tokenizer file itself.
    """
    if (tokenizer, ranks) in _ENCODERS:
        return _ENCODERS[tokenizer, ranks]
    from tokenizers import Tokenizer

    exact = Tokenizer.from_file(tokenizer)
    exact.encode_special_tokens = True

    def slow(text: str) -> np.ndarray:
        return np.array(exact.encode(text, add_special_tokens=False).ids, np.uint32)

    encode = slow
    if ranks is not None:
        import base64

        import tiktoken

        with open(ranks, "rb") as lines:
            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        quick = tiktoken.Encoding(
            "ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={}
        )

        def encode(text: str) -> np.ndarray:
            if not _PLAIN.match(text) or any(m.end() - m.start() >= LONG_GAP for m in _GAP.finditer(text)):
                return slow(text)
            return np.array(quick.encode_ordinary(text), np.uint32)

    _ENCODERS[tokenizer, ranks] = encode
    return encode


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids: full ones, the first takes what is over."""
    first = n % capacity or min(n, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, n, capacity)]


def token_pieces(
    docs: DataFrame,
    capacity: int = CAPACITY,
    end_id: int = END_ID,
    keep_ids: bool = True,
    tokenizer: str | None = None,
    ranks: str | None = None,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """Pieces ``(doc_id, piece, start, length, ids_crc32[, ids])`` of at most ``capacity`` ids.

    A document is the ids of its text, then ``end_id``; a null or empty text is that id alone. Rows
    are independent: repeated rows give repeated pieces, a null ``doc_id`` stays null. ``ids_crc32``
    is over little-endian unsigned 32-bit ids. ``tokenizer`` is a tokenizer file, ``ranks`` the same
    vocabulary as ranks; without either, the 50k byte-level vocabulary of public_tokenizers serves.
    """
    if tokenizer is None:
        tokenizer = public_tokenizers.path("byte_bpe_50k.json")
        ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    key = docs.schema[id_column].dataType.simpleString()
    schema = f"doc_id {key}, piece int, start long, length long, ids_crc32 long"
    schema += ", ids array<int>" if keep_ids else ""
    end = np.array([end_id], np.uint32)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(tokenizer, ranks)
        for batch in batches:
            rows, out = [], []
            for row, text in enumerate(batch.column(1)):
                ids = np.concatenate([encode(text.as_py() or ""), end]).astype("<u4")
                for piece, (start, length) in enumerate(cut(len(ids), capacity)):
                    part = ids[start : start + length]
                    rows.append(row)
                    out.append((piece, start, length, zlib.crc32(part.tobytes()), part))
            names = ["piece", "start", "length", "ids_crc32", "ids"]
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
            made = {"doc_id": batch.column(0).take(pa.array(rows, pa.int64()))}
            for k in range(5 if keep_ids else 4):
                made[names[k]] = pa.array([x[k] for x in out], kinds[k])
            yield pa.RecordBatch.from_pydict(made)

    return docs.select(F.col(id_column), F.col(text_column)).mapInArrow(pieces, schema)


# --- the plan, on counts per length ------------------------------------------------------------

Pattern = tuple[tuple[int, int], ...]  # (length, how often) within one sequence


def reduce_instance(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Fix sets that provably belong to some best packing, and take them off ``counts``.

    ``counts[n]`` documents have length ``n``; the last index is the capacity. For a length, largest
    first, let ``mate`` be the largest that still fits beside it. A set of the two dominates every
    other set with that length, if whatever else fits beside it would fit in the place of the mate:

    * nothing fits beside it: it is alone;
    * mate and length fill the sequence;
    * no two other documents fit beside it;
    * no three fit, and the best two together are no longer than the mate.
    """
    capacity = len(counts) - 1
    fixed: list[tuple[Pattern, int]] = []
    changed = True
    while changed:
        changed = False
        for length in range(capacity, 0, -1):
            while counts[length] > 0:
                counts[length] -= 1  # one of them stands in the sequence
                present = np.flatnonzero(counts)
                counts[length] += 1
                room = capacity - length
                fit = present[present <= room]
                if len(fit) == 0:
                    n = int(counts[length])
                    fixed.append((((length, 1),), n))
                    counts[length] = 0
                    changed = True
                    break
                mate = int(fit[-1])
                if not (mate == room or _dominates(counts, fit, length, mate, room)):
                    break
                n = int(counts[length]) // 2 if mate == length else int(min(counts[length], counts[mate]))
                fixed.append((((length, 2),) if mate == length else ((length, 1), (mate, 1)), n))
                counts[length] -= n
                counts[mate] -= n
                changed = True
    return fixed


def _dominates(counts: np.ndarray, fit: np.ndarray, length: int, mate: int, room: int) -> bool:
    least: list[int] = []
    for n in fit[:3]:
        free = int(counts[n]) - (n == length)
        least += [int(n)] * min(free, 3 - len(least))
        if len(least) == 3:
            break
    if len(least) < 2 or least[0] + least[1] > room:
        return True
    if len(least) > 2 and sum(least) <= room:
        return False
    # The best pair: for every first document the largest second one that fits.
    at = np.searchsorted(fit, room - fit, "right") - 1
    for first, k in zip(fit, at, strict=True):
        free = int(counts[first]) - (first == length)
        second = int(fit[k]) if k >= 0 else 0
        if second == first and free < 2:
            second = int(fit[k - 1]) if k > 0 else 0
        if second and first + second > mate:
            return False
    return True


def best_fit(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, all documents of a length at a time: equal sequences stay one group."""
    capacity = len(counts) - 1
    groups: dict[int, list[tuple[Pattern, int]]] = {}
    rooms = np.zeros(capacity + 1, np.int64)

    def add(pattern: Pattern, n: int, room: int) -> None:
        groups.setdefault(room, []).append((pattern, n))
        rooms[room] += n

    for length in range(capacity, 0, -1):
        left = int(counts[length])
        while left:
            open_rooms = np.flatnonzero(rooms[length:])
            if len(open_rooms):
                room = int(open_rooms[0]) + length
                pattern, n = groups[room].pop()
                rooms[room] -= n
            else:
                room, pattern, n = capacity, (), left
            each = room // length
            full = min(n, left // each)
            used, each = (full, each) if full else (1, left)
            add((*pattern, (length, each)), used, room - each * length)
            left -= used * each
            if n > used and pattern:
                add(pattern, n - used, room)
    return [x for found in groups.values() for x in found]


def pack_plan(counts: np.ndarray) -> list[tuple[Pattern, int]]:
    """Sequences as (pattern, how many), for ``counts`` of documents per length up to the capacity."""
    counts = counts.copy()
    return reduce_instance(counts) + best_fit(counts)


def _places(plan: list[tuple[Pattern, int]]) -> pd.DataFrame:
    """Per length, runs of ranks with the sequence and offset of the first."""
    rows, used, sequence = [], {}, 0
    for pattern, n in plan:
        offset = 0
        for length, each in pattern:
            rank = used.get(length, 0)
            rows.append((length, rank, each, sequence, offset))
            used[length] = rank + each * n
            offset += each * length
        sequence += n
    made = pd.DataFrame(rows, columns=["length", "rank", "each", "sequence", "offset"], dtype="int64")
    return made.sort_values(["length", "rank"], ignore_index=True)


def pack(pieces: DataFrame, capacity: int = CAPACITY, slice_rows: int = SLICE_ROWS) -> DataFrame:
    """Pieces with ``sequence_id`` and ``offset``: their place, gapless from 0 within a sequence.

    ``pieces`` is read twice and should be a table. An empty table gives an empty one. Pieces equal
    in ``doc_id``, ``piece``, ``start`` and ``ids_crc32`` are interchangeable.
    """
    # At most `capacity` rows: the only thing that the driver sees.
    table = pieces.groupBy("length").count().collect()
    counts = np.zeros(capacity + 1, np.int64)
    for row in table:
        counts[row["length"]] = row["count"]
    places = _places(pack_plan(counts))
    slices = max(1, -(-int(counts.sum()) // slice_rows))
    order = ["doc_id", "piece", "start", "ids_crc32"]
    numbered = pieces.withColumn("ws_slice", F.pmod(F.xxhash64(*order), F.lit(slices)))
    before = (
        numbered.groupBy("length", "ws_slice")
        .count()
        .select(
            "length",
            "ws_slice",
            (
                F.sum("count").over(Window.partitionBy("length").orderBy("ws_slice"))
                - F.col("count")
            ).alias("ws_before"),
        )
    )
    within = Window.partitionBy("length", "ws_slice").orderBy(*order)
    ranked = (
        numbered.withColumn("ws_row", F.row_number().over(within))
        .join(before, ["length", "ws_slice"])
        .withColumn("ws_rank", F.col("ws_before") + F.col("ws_row") - 1)
    )
    big = int(counts.max()) + 1
    keys = (places["length"] * big + places["rank"]).to_numpy()
    first = {c: places[c].to_numpy() for c in places.columns}

    @F.pandas_udf("struct<sequence_id: long, offset: long>")
    def place(length: pd.Series, rank: pd.Series) -> pd.DataFrame:
        at = np.searchsorted(keys, length.to_numpy() * big + rank.to_numpy(), "right") - 1
        sequence, copy = np.divmod(rank.to_numpy() - first["rank"][at], first["each"][at])
        return pd.DataFrame(
            {
                "sequence_id": first["sequence"][at] + sequence,
                "offset": first["offset"][at] + copy * length.to_numpy(),
            }
        )

    return ranked.withColumn("ws_place", place("length", "ws_rank")).select(
        *[c for c in pieces.columns if c not in ("sequence_id", "offset")], "ws_place.*"
    )


def pack_documents(docs: DataFrame, capacity: int = CAPACITY, keep_ids: bool = True, **options) -> DataFrame:
    """Every piece of every document (:func:`token_pieces`) with its place (:func:`pack`)."""
    made = token_pieces(docs, capacity, keep_ids=keep_ids, **options)
    return pack(written(made, "token-pieces"), capacity)


def sequences(packed: DataFrame) -> DataFrame:
    """``(sequence_id, ids)`` of packed pieces with their ids. A group is one sequence, so it holds at
    most the capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda p: p["ids"])).alias("ids"))
