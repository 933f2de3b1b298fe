"""Secrets in texts: assignments to telling names, access keys, hexadecimal digits, and random tokens.

A token that no pattern names is judged by a battery of tests for randomness. From its characters an
encoding is inferred, so the token is a sequence of symbols of an alphabet. Three tests ask whether the
symbols are drawn evenly and independently: chi-squared on their counts, runs above and below the middle
of the alphabet, and correlation of neighbours. Fisher's method joins their p-values into one score: high
where the token is *not* random.

How far written text gets by chance depends on encoding and length, so both are taken from the corpus.
Every text gives controls: all its prose, cut into windows, in each encoding and length class, through the same
battery. The share of controls that look at least as random as a token is the token's p-value as a piece of text,
and Benjamini and Hochberg's procedure, within each class of encoding and length, bounds the share of
false discoveries. Where a length has no power, its controls pass too and nothing is found.

One scan finds spans, tokens and controls; what leaves it are spans per document and counts per class, a
fixed number of them. Texts never travel, and the driver sees the counts alone.

A null text is empty, a null id stays, repeated rows are judged alike, an empty table gives no rows. Tables
with few controls have no discoveries beyond the patterns. Columns other than id and text are not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspark.llm.tables import written
from webspark.llm.words import LOWER, chunks

# The patterns of the base, and the least length of a match (of its group 2 for the first).
ASSIGN = re.compile(
    r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII
)
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
LEAST_ASSIGN, LEAST_ACCESS, LEAST_HEX = 6, 20, 24
KINDS = ("assign", "access", "hex", "random")
# Every assignment holds one of these.
_NAMES = (b"passw", b"secret", b"token", b"api")

# Share of false discoveries among random tokens of a class.
FALSE_SHARE = 0.01
LEAST_TOKEN = 20
# Length classes; a control has the least length of its class, where the tests see least.
LENGTHS = (20, 24, 32, 40, 56)
# Controls are counted apart: the first of so many letters of a text, and all further ones.
CONTROL_CHARS = 4096
# Windows scored at a time, so that their symbols stay in the cache.
_BLOCK = 16384
# Scores are in sixteenths of a power of ten, up to a bound beyond which nothing is random.
PER_DECADE, BINS = 16, 257

_RUN = np.zeros(256, bool)
_RUN[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_.=-"]] = True
_TOKEN = re.compile(rb"[A-Za-z0-9+/_-]{20,}")
_LETTER = np.zeros(256, bool)
_LETTER[[*b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"]] = True


def _alphabet(symbols: bytes) -> np.ndarray:
    """Value per byte, -1 outside."""
    table = np.full(256, -1, np.int64)
    table[[*symbols]] = np.arange(len(symbols))
    return table


_CAPITALS, _SMALL, _DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
# Encodings from narrow to wide: name, what a token of it looks like, symbols.
ENCODINGS: list[tuple[str, re.Pattern[bytes], bytes]] = [
    ("hex", re.compile(rb"[0-9a-f]+|[0-9A-F]+"), _DIGITS + b"abcdef"),
    ("base32", re.compile(rb"[A-Z2-7]+"), _CAPITALS + b"234567"),
    ("base36", re.compile(rb"[A-Z0-9]+|[a-z0-9]+"), _SMALL + _DIGITS),
    ("base62", re.compile(rb"[A-Za-z0-9]+"), _CAPITALS + _SMALL + _DIGITS),
    ("base64", re.compile(rb"[A-Za-z0-9+/]+"), _CAPITALS + _SMALL + _DIGITS + b"+/"),
    ("base64url", re.compile(rb"[A-Za-z0-9_-]+"), _CAPITALS + _SMALL + _DIGITS + b"-_"),
]
_VALUES = [_alphabet(symbols) for _, _, symbols in ENCODINGS]
for _k in (0, 1, 2):
    # Narrow alphabets in either case.
    _other = _VALUES[_k][[*(_SMALL if _k == 1 else _CAPITALS)]] < 0
    _from, _to = (_CAPITALS, _SMALL) if _k == 1 else (_SMALL, _CAPITALS)
    _VALUES[_k][[*_to]] = np.where(_other, _VALUES[_k][[*_from]], _VALUES[_k][[*_to]])
SIZES = [len(symbols) for _, _, symbols in ENCODINGS]
CLASSES = len(ENCODINGS) * len(LENGTHS)


def encoding_of(token: bytes) -> int | None:
    """Place of the narrowest encoding; None for numbers alone and for signs of two alphabets."""
    if token.isdigit():
        return None
    return next((k for k, (_, look, _) in enumerate(ENCODINGS) if look.fullmatch(token)), None)


_erfc = np.vectorize(math.erfc, otypes=[float])


_TINY = 1e-300


def _even(squares: np.ndarray, n: int, size: int) -> np.ndarray:
    """P-value of even use of the alphabet, by the sum of the squares of counts (Wilson and Hilferty's normal form
    of chi-squared)."""
    chi, free = size / n * squares - n, size - 1
    z = (np.cbrt(chi / free) - (1 - 2 / (9 * free))) / math.sqrt(2 / (9 * free))
    return 0.5 * _erfc(z / math.sqrt(2))


def _mixed(above: np.ndarray, runs: np.ndarray, n: int) -> np.ndarray:
    """P-value of runs above and below the middle."""
    mean = 2 * above * (n - above) / n + 1
    spread = np.sqrt(np.maximum((mean - 1) * (mean - 2) / (n - 1), 1e-12))
    return np.where((above == 0) | (above == n), 2.0 ** (1 - min(n, 900)), _erfc(np.abs(runs - mean) / spread / math.sqrt(2)))


def battery(symbols: np.ndarray, size: int) -> np.ndarray:
    """Score of each row, a sequence of symbols below ``size``: minus the logarithm to base ten of the joined
    p-value that its symbols are even and independent."""
    m, n = symbols.shape
    rows = np.arange(m)[:, None] * size
    counts = np.bincount((rows + symbols).ravel(), minlength=m * size).reshape(m, size)
    even = _even(np.square(counts).sum(1), n, size)
    high = symbols >= size / 2
    mixed = _mixed(high.sum(1), 1 + (high[:, 1:] != high[:, :-1]).sum(1), n)
    # Correlation of neighbours.
    centred = symbols - symbols.mean(1, keepdims=True)
    power = np.square(centred).sum(1)
    serial = (centred[:, 1:] * centred[:, :-1]).sum(1) / np.maximum(power, 1e-12)
    free_of = np.where(power < 1e-9, _TINY, _erfc(np.abs(serial + 1 / n) * math.sqrt(n) / math.sqrt(2)))
    s = -(np.log(np.maximum(even, _TINY)) + np.log(np.maximum(mixed, _TINY)) + np.log(np.maximum(free_of, _TINY)))
    return (s - np.log1p(s + s * s / 2)) / math.log(10)


def _bins(scores: np.ndarray) -> np.ndarray:
    return np.clip(np.floor(scores * PER_DECADE), 0, BINS - 1).astype(np.int64)


def token_class(token: bytes) -> tuple[int, int] | None:
    """Class and bin of a token; None if it has no encoding or is short."""
    kind = encoding_of(token)
    if kind is None or len(token) < LEAST_TOKEN:
        return None
    length = int(np.searchsorted(LENGTHS, len(token), "right")) - 1
    symbols = _VALUES[kind][np.frombuffer(token, np.uint8)]
    return kind * len(LENGTHS) + length, int(_bins(battery(symbols[None, :], SIZES[kind]))[0])


def _gathered(stream: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """Windows of a stream as columns: their first bytes are the first row."""
    return np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(stream, width)[starts].T)


def _packed(letters: np.ndarray, n: int, bits: int) -> np.ndarray:
    """The first ``n`` symbols of ``bits`` bits of columns of bytes: the columns as an encoder would write them."""
    out = np.empty((n, letters.shape[1]), np.uint8)
    for k in range(n):
        byte, shift = divmod(k * bits, 8)
        if shift + bits <= 8:
            out[k] = (letters[byte] >> (8 - shift - bits)) & ((1 << bits) - 1)
        else:
            two = letters[byte].astype(np.uint16) << 8 | letters[byte + 1]
            out[k] = (two >> (16 - shift - bits)) & ((1 << bits) - 1)
    return out


# Minus the logarithm of erfc at steps of 1 / _STEPS, read between them linearly: right to 1e-9.
_STEPS, _LAST = 1 << 14, 26


@cache
def _erfc_table() -> np.ndarray:
    return -np.log(np.maximum(_erfc(np.arange(_LAST * _STEPS + 2) / _STEPS), _TINY))


@cache
def _tables(n: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Minus the logarithms of two p-values of sequences of ``n`` symbols: of even use by the number of pairs of
    equal symbols, of runs by the numbers of symbols above the middle and of changes."""
    even = -np.log(np.maximum(_even(n + 2.0 * np.arange(n * (n - 1) // 2 + 1), n, size), _TINY))
    above, changes = np.divmod(np.arange((n + 1) * n), n)
    return even, -np.log(np.maximum(_mixed(above, 1 + changes, n), _TINY))


def column_scores(symbols: np.ndarray, size: int) -> np.ndarray:
    """:func:`battery` of many sequences of one length, the columns of ``symbols``, from whole numbers and tables."""
    n, m = symbols.shape
    even, mixed = _tables(n, size)
    pairs = np.zeros(m, np.int64)
    for k in range(n - 1):
        pairs += np.add.reduce((symbols[k + 1 :] == symbols[k]).view(np.uint8), axis=0, dtype=np.uint8)
    high = symbols >= size / 2
    above = np.add.reduce(high.view(np.uint8), axis=0, dtype=np.uint8)
    changes = np.add.reduce((high[1:] != high[:-1]).view(np.uint8), axis=0, dtype=np.uint8)
    wide = symbols.astype(np.uint16)
    total = np.add.reduce(wide, axis=0, dtype=np.uint32).astype(float)
    power = np.add.reduce(wide * wide, axis=0, dtype=np.uint32) - total * total / n
    both = np.add.reduce(wide[1:] * wide[:-1], axis=0, dtype=np.uint32)
    mean = total / n
    serial = (both - mean * (2 * total - wide[0] - wide[-1]) + (n - 1) * mean * mean) / np.maximum(power, 1e-12)
    place = np.minimum(np.abs(serial + 1 / n) * (math.sqrt(n) / math.sqrt(2) * _STEPS), _LAST * _STEPS)
    step, table = place.astype(np.int64), _erfc_table()
    free = table[step] + (place - step) * (table[step + 1] - table[step])
    free[power < 1e-9] = -math.log(_TINY)
    s = even[pairs] + mixed[above.astype(np.int64) * n + changes] + free
    return (s - np.log1p(s + s * s / 2)) / math.log(10)


def _windows(bounds: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of windows that cover every text of a stream, the last one of a text up to its end, and whether a
    window is the first of CONTROL_CHARS. A text shorter than a window has none."""
    sizes = np.diff(bounds)
    number = np.where(sizes >= width, -(-sizes // width), 0)
    text = np.repeat(np.arange(len(sizes)), number)
    k = np.arange(len(text)) - np.repeat(np.cumsum(number) - number, number)
    first = (k == 0) | (k * width // CONTROL_CHARS != (k - 1) * width // CONTROL_CHARS)
    return bounds[text] + np.minimum(k * width, sizes[text] - width), first


def controls(data: np.ndarray, offsets: np.ndarray, counts: np.ndarray) -> None:
    """Adds controls of all prose of a run of texts to ``counts``, by whether they are the first of CONTROL_CHARS or
    further ones, class and bin. Every class covers all letters of a text that has enough for one window. Wide
    alphabets take prose, names made of its words, and encoded prose, in turn; base64url takes words joined by a
    hyphen."""
    letter = _LETTER[data]
    begins = letter.copy()
    begins[1:] &= ~letter[:-1]
    # A text begins anew, whatever the one before it in the run ends with.
    heads = offsets[:-1][offsets[:-1] < len(data)]
    begins[heads] = letter[heads]
    at = np.flatnonzero(letter)
    letters, names = data[at], np.where(begins, data & 0xDF, data)[at]
    bounds = np.searchsorted(at, offsets)
    at = np.flatnonzero(letter | (data == 0x20))
    slugs, slug_bounds = np.where(letter, data, ord("-")).astype(np.uint8)[at], np.searchsorted(at, offsets)
    for kind, (name, _, _) in enumerate(ENCODINGS):
        values = _VALUES[kind].astype(np.uint8)
        bits = {"hex": 4, "base32": 5}.get(name)
        stream, ends = (slugs, slug_bounds) if name == "base64url" else (letters, bounds)
        for length, n in enumerate(LENGTHS):
            width = -(-n * bits // 8) if bits else n
            starts, first = _windows(ends, width)
            for low in range(0, len(starts), _BLOCK):
                some = starts[low : low + _BLOCK]
                rows = _gathered(stream, some, width)
                if bits:
                    symbols = _packed(rows, n, bits)
                else:
                    symbols = values[rows]
                    # Which of them a window gives follows from its own letters, so partitions don't matter.
                    turn = rows[:8].sum(0, dtype=np.int64)
                    if name in ("base62", "base64"):
                        named = np.flatnonzero(turn % 2 == 0)
                        symbols[:, named] = values[_gathered(names, some[named], n)]
                    if name == "base64":
                        coded = np.flatnonzero(turn % 3 == 0)
                        symbols[:, coded] = _packed(rows[:, coded], n, 6)
                bins, firsts = _bins(column_scores(symbols, SIZES[kind])), first[low : low + _BLOCK]
                for part, mask in enumerate((firsts, ~firsts)):
                    counts[part, kind * len(LENGTHS) + length] += np.bincount(bins[mask], minlength=BINS)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """Spans ``(start, place of the kind, end)`` of one text, by the patterns alone."""
    spans = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    data = text.encode("utf-32-le")
    plain = bytes(min(c, 255) for c in memoryview(data).cast("I")) if not text.isascii() else text.encode()
    for kind, pattern, least in ((1, ACCESS, LEAST_ACCESS), (2, HEX, LEAST_HEX)):
        spans += [(m.start(), kind, m.end()) for m in pattern.finditer(plain) if m.end() - m.start() >= least]
    return sorted(spans)


def _scan(kind: str):
    """Per document its base spans and its tokens with class and bin; per task a row of the counts of controls."""
    schema = f"doc_id {kind}, spans array<struct<start:long,kind:int,end:long>>, "
    schema += "tokens array<struct<start:long,kind:int,end:long,class:int,bin:int>>, "
    schema += "controls array<long>, further array<long>"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, key = np.zeros((2, CLASSES, BINS), np.int64), None
        for batch in batches:
            key = batch.schema.field(0).type
            texts = batch.column(1)
            spans: list[list] = [[] for _ in range(batch.num_rows)]
            tokens: list[list] = [[] for _ in range(batch.num_rows)]
            for first, last, data, offsets in chunks(texts):
                _find(texts, first, data, offsets, spans, tokens)
                controls(data, offsets, counts)
            for row in range(batch.num_rows):
                spans[row].sort()
            none = [None] * batch.num_rows
            yield _rows(batch.column(0), spans, tokens, none, none)
        if key is not None:
            yield _rows(pa.nulls(1, key), [None], [None], *([c.ravel().tolist()] for c in counts))

    return scan, schema


_SPAN = [("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64())]
_TOKENS = pa.struct([*_SPAN, ("class", pa.int32()), ("bin", pa.int32())])


def _rows(ids: pa.Array, spans: list, tokens: list, controls: list, further: list) -> pa.RecordBatch:
    def structs(values: list, kind: pa.StructType) -> pa.Array:
        names = [f.name for f in kind]
        return pa.array([v and [dict(zip(names, x)) for x in v] if v is not None else None for v in values], pa.list_(kind))

    counts = [pa.array(c, pa.list_(pa.int64())) for c in (controls, further)]
    arrays = [ids, structs(spans, pa.struct(_SPAN)), structs(tokens, _TOKENS), *counts]
    return pa.RecordBatch.from_arrays(arrays, ["doc_id", "spans", "tokens", "controls", "further"])


def _find(texts: pa.Array, first: int, data: np.ndarray, offsets: np.ndarray, spans: list, tokens: list) -> None:
    """Base spans and tokens of the texts of a run, by the rows of its batch."""
    # Assignments: only texts with one of the names are searched.
    low, named = LOWER[data].tobytes(), set()
    for name in _NAMES:
        at = low.find(name)
        while at >= 0:
            row = int(np.searchsorted(offsets, at, "right")) - 1
            named.add(row)
            at = low.find(name, int(offsets[row + 1]) - len(name) + 1 if offsets[row + 1] - at > len(name) else at + 1)
    for row in named:
        text = texts[first + row].as_py()
        spans[first + row] += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST_ASSIGN]
    # All else stands in long runs of the characters of tokens.
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _RUN[data]
    edge = np.diff(inside.astype(np.int8))
    starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    cut = np.unique(cut[inside[cut] & inside[cut + 1]])
    starts, ends = np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))
    long = ends - starts >= LEAST_TOKEN
    starts, ends = starts[long], ends[long]
    if not len(starts):
        return
    rows = np.searchsorted(offsets, starts, "right") - 1
    # Places in code points: bytes that begin one, before the run.
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    places = begins[starts] - begins[offsets[rows]]
    for row, place, start, end in zip(rows.tolist(), places.tolist(), starts.tolist(), ends.tolist()):
        run, out = data[start:end].tobytes(), spans[first + row]
        for kind, pattern, least in ((1, ACCESS, LEAST_ACCESS), (2, HEX, LEAST_HEX)):
            for m in pattern.finditer(run):
                if m.end() - m.start() >= least:
                    out.append((place + m.start(), kind, place + m.end()))
        for m in _TOKEN.finditer(run):
            found = token_class(m.group())
            if found is not None:
                tokens[first + row].append((place + m.start(), 3, place + m.end(), *found))


def thresholds(targets: np.ndarray, control: np.ndarray, share: float = FALSE_SHARE) -> np.ndarray:
    """Per class the last bin whose tokens are discoveries, -1 for none; both counts are per class and bin.

    The p-value of a bin is the share of controls up to it, the bin's tokens counted as one more."""
    out = np.full(len(targets), -1)
    for k, (found, text) in enumerate(zip(targets, control)):
        p = (1 + np.cumsum(text)) / (1 + text.sum())
        good = np.flatnonzero((found > 0) & (p * found.sum() <= share * np.cumsum(found)))
        if len(good):
            out[k] = good[-1]
    return out


def find_secrets(
    docs: DataFrame, false_share: float = FALSE_SHARE, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """``(doc_id, spans, base)`` per document: ``spans`` are structs ``(start, kind, end)`` in code points, by
    start and kind (a place in KINDS), ``base`` those of the patterns. A random token that a base span covers
    is counted for the thresholds, and not reported twice."""
    scan, schema = _scan(docs.schema[id_column].dataType.simpleString())
    texts = docs.select(F.col(id_column).alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    scanned = written(texts.mapInArrow(scan, schema), "secret-spans")
    control = np.zeros(CLASSES * BINS, np.int64)
    both = scanned.where("controls IS NOT NULL").select(F.explode(F.array("controls", "further")).alias("c"))
    summed = both.select(F.posexplode("c").alias("at", "n"))
    for row in summed.where("n > 0").groupBy("at").agg(F.sum("n").alias("n")).collect():
        control[row["at"]] = row["n"]
    targets = np.zeros((CLASSES, BINS), np.int64)
    held = scanned.where("controls IS NULL").select(F.explode("tokens").alias("t"))
    for row in held.groupBy("t.class", "t.bin").count().collect():
        targets[row["class"], row["bin"]] = row["count"]
    last = thresholds(targets, control.reshape(CLASSES, BINS), false_share)
    # A number per class, so a literal.
    limits = F.array(*[F.lit(int(x)) for x in last])
    random = F.filter("tokens", lambda t: t["bin"] <= F.get(limits, t["class"]))
    uncovered = F.filter(
        random, lambda t: ~F.exists("spans", lambda s: (s["start"] <= t["start"]) & (t["end"] <= s["end"]))
    )
    added = F.transform(uncovered, lambda t: F.struct(t["start"].alias("start"), t["kind"].alias("kind"), t["end"].alias("end")))
    return scanned.where("controls IS NULL").select(
        "doc_id", F.array_sort(F.concat("spans", added)).alias("spans"), F.col("spans").alias("base")
    )


def span_text(spans: str):
    """Spans as ``kind:start:end``, joined by commas."""
    names = F.array(*map(F.lit, KINDS))
    parts = F.transform(
        spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))
    )
    return F.array_join(parts, ",")
