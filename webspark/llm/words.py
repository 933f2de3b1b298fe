"""Words and shingles of whole batches of texts as numpy arrays, without a Python step per word.

A batch's texts are one buffer of UTF-8 bytes. Positions of words come from comparisons over the
buffer, and their hashes from prefix sums of ``value(byte) * BASE ** position`` modulo 2**64, so the
cost is a few vector steps per byte, whatever the length of a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

# Bytes of text that one vector step handles; bounds the memory of a task.
CHUNK_BYTES = 1 << 20
SPACES = tuple([0x20, *range(0x09, 0x0E)])

_ODD = np.uint64(0x9E3779B97F4A7C15)


def mix(x: np.ndarray) -> np.ndarray:
    """Finalizer of 64 bits: every input bit changes half of the output bits."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def powers(n: int, base: np.uint64 = _ODD) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2**64."""
    out = np.full(max(n, 1), base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)[:n]


def inverse(base: np.uint64 = _ODD) -> np.uint64:
    """The inverse of an odd number modulo 2**64."""
    return np.uint64(pow(int(base), -1, 1 << 64))


BYTE_VALUES = mix(np.arange(1, 257, dtype=np.uint64) * _ODD)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_POWER = powers(CHUNK_BYTES + 1)
_INVERSE = powers(CHUNK_BYTES + 1, inverse())


def powers_for(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse for a run of ``n`` bytes."""
    if n <= CHUNK_BYTES:
        return _POWER, _INVERSE
    return powers(n + 1), powers(n + 1, inverse())


def separators(keep_symbols: bool) -> np.ndarray:
    """Table of the bytes that end a word: ASCII white space, or every ASCII byte that is neither a
    letter nor a digit."""
    table = np.zeros(256, bool)
    table[list(SPACES)] = True
    if not keep_symbols:
        table[:128] = [not chr(b).isalnum() for b in range(128)]
    return table


WHITE = separators(True)
PLAIN = separators(False)


def chunks(texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first, last, bytes, offsets) of runs of texts of about CHUNK_BYTES; a null is empty. A text
    beyond the size is a run of its own."""
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset :][: len(texts) + 1]
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    first = 0
    while first < len(texts):
        last = int(np.searchsorted(offsets, offsets[first] + CHUNK_BYTES, "right")) - 1
        last = min(max(last, first + 1), len(texts))
        span = offsets[first : last + 1]
        yield first, last, data[span[0] : span[-1]], span - span[0]
        first = last


def word_hashes(data: np.ndarray, offsets: np.ndarray, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words of all texts of a run, A-Z lower-cased, in order, and the number of words
    per text. ``table`` names the bytes that end a word."""
    data = LOWER[data]
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = ~table[data]
    # The end of a text ends a word as well.
    cut = offsets[1:-1]
    edge = np.diff(inside.astype(np.int8))
    starts = np.flatnonzero(edge == 1)
    ends = np.flatnonzero(edge == -1)
    broken = cut[(cut > 0) & (cut < len(data))]
    broken = np.unique(broken[inside[broken] & inside[broken + 1]])
    starts = np.sort(np.concatenate([starts, broken]))
    ends = np.sort(np.concatenate([ends, broken]))
    power, back = powers_for(len(data))
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE_VALUES[data] * power[: len(data)], out=total[1:])
    hashes = mix((total[ends] - total[starts]) * back[starts] + (ends - starts).astype(np.uint64))
    counts = np.diff(np.searchsorted(starts, offsets))
    return hashes, counts


def window_hashes(words: np.ndarray, size: int) -> np.ndarray:
    """Hash of every run of ``size`` words; of the whole sequence where it is shorter."""
    if len(words) == 0:
        return words
    size = min(size, len(words))
    weights = powers(size + 1)[1:]
    n = len(words) - size + 1
    out = np.full(n, np.uint64(size), np.uint64)
    for k in range(size):
        out += words[k : k + n] * weights[k]
    return mix(out)


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """The distinct shingles of every text, as ascending hashes; of a text with fewer than ``size``
    words its whole sequence as the only one, of a text without words none."""
    for first, last, data, offsets in chunks(texts):
        words, counts = word_hashes(data, offsets, WHITE)
        at = np.concatenate([[0], np.cumsum(counts)])
        for k in range(last - first):
            yield np.unique(window_hashes(words[at[k] : at[k + 1]], size))
