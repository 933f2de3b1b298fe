"""Test items that training documents contain, found by BM25 over an inverted index of the items.

The items are indexed, and every passage of every document is a query. Postings carry impacts: the
BM25 share of a term in its item, as a part of the item's score for its own text, so one threshold
between 0 and 1 serves items of any length. As in block-max WAND, items stand in blocks, every term
knows the largest impact it has in a block, and a block is only scored for a passage when the block's
maxima can reach the threshold; all other blocks are skipped unread. Nothing above the threshold is
lost. What is scored above it is then verified word by word: the item's question and its answer must
both stand in the passage.
"""

from __future__ import annotations

import re
import unicodedata
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from webspark.llm.words import PLAIN, chunks, window_hashes, word_hashes

# The usual BM25 parameters.
K1, B = 1.2, 0.75

THRESHOLD = 0.5
QUESTION_OVERLAP = 0.7
ANSWER_OVERLAP = 0.7
# Words that must match in a row for a word to count as found again.
RUN_WORDS = 3
# Half a passage, in words; passages overlap by half, and grow with the longest item.
STRIDE_WORDS = 64
BLOCK_ITEMS = 8
# What terms of many items may add to an item; below every threshold.
COMMON_PART = 0.2
# Items that one pass over the documents indexes: bounds what is broadcast.
PASS_ITEMS = 20_000

_SENTENCE = re.compile(r"(?<=[.?!])\s+|(?<=[。？！｡])\s*")
_UNSEEN = regex.compile(r"\p{Cf}+")
# Signs within ASCII separate by themselves.
_BETWEEN = regex.compile(r"[^\p{L}\p{M}\p{N}\x00-\x7f]+")
# Scripts without spaces between words.
_DENSE = regex.compile(
    r"[\p{Han}\p{Hiragana}\p{Katakana}\p{Thai}\p{Lao}\p{Khmer}\p{Myanmar}][\p{M}\u30fc]*"
)
_DENSE_RUN = regex.compile(f"(?:{_DENSE.pattern})+")


def question_and_answer(text: str) -> tuple[str, str]:
    """The last sentence is the answer, what comes before the question; of a single sentence both."""
    parts = [p for p in _SENTENCE.split(text.strip()) if any(c.isalnum() for c in p)]
    if len(parts) < 2:
        return text, text
    return " ".join(parts[:-1]), parts[-1]


def _pairs(run: regex.Match) -> str:
    signs = _DENSE.findall(run.group())
    return " " + " ".join(map("".join, zip(signs, signs[1:], strict=False)) if len(signs) > 1 else signs) + " "


def spaced(text: str) -> str:
    """The words of a text outside ASCII with spaces between them: compatible forms are one, case is folded,
    punctuation of any script separates, signs without width are gone, and runs of a script without spaces are the pairs of
    their signs."""
    words = _UNSEEN.sub("", unicodedata.normalize("NFKC", text)).casefold()
    # A few different signs tell whether a text needs the patterns at all.
    others = [sign for sign in set(words) if sign > "\x7f"]
    if any(map(_BETWEEN.match, others)):
        words = _BETWEEN.sub(" ", words)
    return _DENSE_RUN.sub(_pairs, words) if any(map(_DENSE.match, others)) else words


def _all_spaced(texts: pa.Array) -> pa.Array:
    """Texts within ASCII as they are, the others :func:`spaced`."""
    texts = texts.cast(pa.large_string())
    other = pc.fill_null(pc.invert(pc.string_is_ascii(texts)), False)
    if not pc.any(other).as_py():
        return texts
    new = pa.array([spaced(t) for t in texts.filter(other).to_pylist()], pa.large_string())
    return pc.replace_with_mask(texts, other, new)


def _words(texts: list[str]) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, _, data, offsets in chunks(_all_spaced(pa.array(texts, pa.large_string()))):
        words, counts = word_hashes(data, offsets, PLAIN)
        out += np.split(words, np.cumsum(counts)[:-1])
    return out


@dataclass
class Index:
    """Inverted index of items. Postings of term ``t`` are the slice ``starts[t]:starts[t + 1]``;
    ``blocks`` has the same for blocks, with the largest impact of the term in the block."""

    ids: list
    terms: np.ndarray
    starts: np.ndarray
    items: np.ndarray
    impacts: np.ndarray
    block_starts: np.ndarray
    blocks: np.ndarray
    maxima: np.ndarray
    common: np.ndarray  # of a block: the most that common terms add to any of its items
    is_common: np.ndarray
    questions: list[np.ndarray]
    answers: list[np.ndarray]
    stride: int


def build_index(ids: list, texts: list[str], frequencies: dict[int, int] | None = None, total: int | None = None) -> Index:
    """``frequencies`` and ``total``: items with a term, and items, where these are a part of all."""
    words = _words(texts)
    lengths = np.array([len(w) for w in words], np.int64)
    mean = max(lengths.mean() if len(lengths) else 1.0, 1.0)
    owner = np.repeat(np.arange(len(words)), lengths)
    flat = np.concatenate([np.zeros(0, np.uint64), *words])
    terms, term = np.unique(flat, return_inverse=True)
    pair, tf = np.unique(term.astype(np.int64) * max(len(words), 1) + owner, return_counts=True)
    at, item = np.divmod(pair, max(len(words), 1))
    df = np.bincount(at, minlength=len(terms))
    if frequencies is not None:
        df = np.array([frequencies[int(t)] for t in terms.view(np.int64)], np.int64)
    n = total if total is not None else len(words)
    idf = np.log1p((n - df + 0.5) / (df + 0.5))
    weight = idf[at] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * lengths[item] / mean))
    own = np.bincount(item, weight, minlength=len(words))
    impact = weight / own[item] if len(item) else weight
    starts = np.searchsorted(at, np.arange(len(terms) + 1))
    is_common = _common_terms(starts, item, impact, df, max(n / 20, 1), len(words))
    block = item // BLOCK_ITEMS
    n_blocks = int(len(words) // BLOCK_ITEMS + 1)
    rare = np.flatnonzero(~is_common[at])
    key, first = np.unique(at[rare] * n_blocks + block[rare], return_index=True)
    maxima = np.maximum.reduceat(impact[rare], first) if len(first) else np.zeros(0)
    of_common = np.bincount(item[is_common[at]], impact[is_common[at]], minlength=len(words))
    common = np.zeros(n_blocks)
    np.maximum.at(common, np.arange(len(words)) // BLOCK_ITEMS, of_common)
    parts = [question_and_answer(t) for t in texts]
    runs = [_runs(w, RUN_WORDS) for w in _words([p for pair in parts for p in pair])]
    return Index(
        ids, terms, starts, item, impact,
        np.searchsorted(key // n_blocks, np.arange(len(terms) + 1)), key % n_blocks, maxima,
        common, is_common, runs[::2], runs[1::2],
        max(STRIDE_WORDS, int(lengths.max()) if len(lengths) else 0),
    )


def _common_terms(
    starts: np.ndarray, item: np.ndarray, impact: np.ndarray, df: np.ndarray, many: float, n_items: int
) -> np.ndarray:
    """Terms of more than ``many`` items, the most frequent first, while they add at most COMMON_PART to
    any item. Their part is bounded per block once and for all, and never reaches a threshold alone."""
    common, part = np.zeros(len(df), bool), np.zeros(n_items)
    for t in np.argsort(-df, kind="stable").tolist():
        if df[t] <= many:
            break
        own = slice(starts[t], starts[t + 1])
        if (part[item[own]] + impact[own]).max() <= COMMON_PART:
            part[item[own]] += impact[own]
            common[t] = True
    return common


def _runs(words: np.ndarray, size: int) -> np.ndarray:
    """Hashes of the runs of ``size`` words, or of all words where there are fewer."""
    return np.unique(window_hashes(words, size))


def _found(runs: np.ndarray, passage: np.ndarray) -> float:
    """Share of the runs that stand in the passage. Runs are of one length, that of a short text
    too, so the passage is cut to fit."""
    return float(np.isin(runs, passage).mean()) if len(runs) else 0.0


def _segment_bounds(index: Index, term: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segment * blocks + block, summed maxima) of rare terms, ascending."""
    n_blocks = len(index.common)
    n = index.block_starts[term + 1] - index.block_starts[term]
    steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    at = np.repeat(index.block_starts[term], n) + steps
    key = np.repeat(segment, n) * n_blocks + index.blocks[at]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.diff(key, prepend=-1))
    return key[first], np.add.reduceat(index.maxima[at][order], first) if len(first) else np.zeros(0)


def search(index: Index, words: np.ndarray, counts: np.ndarray, threshold: float) -> Iterator[tuple[int, int, int, int, float]]:
    """(text, first word, last word + 1, item, score) of every passage and item at or above the
    threshold. ``words`` of all texts in a row, ``counts`` per text."""
    if len(index.terms) == 0 or len(words) == 0:
        return
    n_blocks, stride = len(index.common), index.stride
    at = np.minimum(np.searchsorted(index.terms, words), len(index.terms) - 1)
    known = index.terms[at] == words
    text = np.repeat(np.arange(len(counts)), counts)
    begin = np.concatenate([[0], np.cumsum(counts)])
    # Segments of half a passage; an empty one after each text keeps passages within texts.
    per_text = -(-counts // stride) + 1
    base = np.concatenate([[0], np.cumsum(per_text)])
    segment = base[text] + (np.arange(len(words)) - begin[text]) // stride
    use = known & ~index.is_common[at]
    key, bound = _segment_bounds(index, at[use], segment[use])
    if len(key) == 0:
        return
    # A passage is a segment and the next, either of which may have terms of the block.
    before = key[(key // n_blocks > 0)] - n_blocks
    before = before[np.isin(before // n_blocks, base[1:] - 1, invert=True)]
    begins = np.union1d(key, before)
    both = np.zeros(len(begins))
    for shift in (0, n_blocks):
        found = np.minimum(np.searchsorted(key, begins + shift), len(key) - 1)
        both += np.where(key[found] == begins + shift, bound[found], 0.0)
    reach = both + index.common[begins % n_blocks] >= threshold - 1e-9
    passages: dict[int, list[int]] = defaultdict(list)
    for k in begins[reach].tolist():
        passages[k // n_blocks].append(k % n_blocks)
    for seg, blocks in passages.items():
        t = int(np.searchsorted(base, seg, "right")) - 1
        first = int(begin[t]) + (seg - int(base[t])) * stride
        last = min(first + 2 * stride, int(begin[t + 1]))
        inside = at[first:last][known[first:last]]
        present = np.unique(inside)
        n = index.starts[present + 1] - index.starts[present]
        steps = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        post = np.repeat(index.starts[present], n) + steps
        item, impact = index.items[post], index.impacts[post]
        for block in blocks:
            here = item // BLOCK_ITEMS == block
            scores = np.bincount(item[here] - block * BLOCK_ITEMS, impact[here], minlength=BLOCK_ITEMS)
            for k in np.flatnonzero(scores >= threshold - 1e-9).tolist():
                yield t, first, last, block * BLOCK_ITEMS + k, float(scores[k])


def _scan(index: Index, texts: pa.Array, threshold: float) -> Iterator[tuple[int, int, float, float, float]]:
    """(text, item, score, question overlap, answer overlap), the best passage of each pair."""
    for start, _, data, offsets in chunks(_all_spaced(texts)):
        words, counts = word_hashes(data, offsets, PLAIN)
        begin = np.concatenate([[0], np.cumsum(counts)])
        best: dict[tuple[int, int], tuple[float, float, float]] = {}
        for t, first, last, item, score in search(index, words, counts, threshold):
            # An item across the edge of a passage is whole in the passage's surroundings.
            around = words[max(int(begin[t]), first - index.stride) : min(int(begin[t + 1]), last + index.stride)]
            grams = [window_hashes(around, k) for k in range(1, RUN_WORDS + 1)]
            passage = np.concatenate(grams)
            figures = (score, _found(index.questions[item], passage), _found(index.answers[item], passage))
            key = (start + t, item)
            if key not in best or figures[1:] > best[key][1:]:
                best[key] = max(figures, best.get(key, figures), key=lambda f: (f[1] + f[2], f[0]))
        for (t, item), figures in best.items():
            yield t, item, *figures


def _passes(benchmark: DataFrame, item_column: str, text_column: str, pass_items: int) -> Iterator[Index]:
    """Indexes of at most about ``pass_items`` items each; document frequencies are over all items."""
    items = benchmark.select(F.col(item_column).alias("id"), F.col(text_column).alias("text")).dropna()
    total = items.count()
    n = max(1, -(-total // pass_items))
    for k in range(n):
        rows = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(n)) == k).orderBy("id", "text").collect()
        frequencies = None
        if n > 1:
            frequencies = _frequencies(items, rows)
        yield build_index([r["id"] for r in rows], [r["text"] for r in rows], frequencies, total)


def _frequencies(items: DataFrame, rows: list) -> dict[int, int]:
    """Items of all that hold a term, for the terms of ``rows``."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(w) for w in _words(batch.column(0).to_pylist())]
            yield pa.RecordBatch.from_pydict({"term": np.concatenate([np.zeros(0, np.uint64), *found]).view(np.int64)})

    spark = items.sparkSession
    own = np.unique(np.concatenate(_words([r["text"] for r in rows]))).view(np.int64)
    wanted = spark.createDataFrame([(int(t),) for t in own], "term long")
    counted = items.select("text").mapInArrow(terms, "term long").groupBy("term").count().join(wanted, "term")
    return {r["term"]: r["count"] for r in counted.collect()}


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    question_overlap: float = QUESTION_OVERLAP,
    answer_overlap: float = ANSWER_OVERLAP,
    pass_items: int = PASS_ITEMS,
    verified_only: bool = True,
    id_column: str = "doc_id",
    item_column: str = "item_id",
    text_column: str = "text",
) -> DataFrame:
    """``(doc_id, item_id, score, question_overlap, answer_overlap, verified)`` per document row and item.

    Words are letters, digits and marks of any script, case folded; where a script has no spaces, pairs of
    successive signs (:func:`spaced`). A passage is ``2 * STRIDE_WORDS`` words (more, where
    an item is longer), passages start every half of it and cover the whole text. Retrieved are all
    items with a BM25 score of ``threshold`` or more of the score for their own text; ``verified`` says
    that so many of the three-word runs of question and answer stand in the passage or half a passage
    around it. Only verified pairs are returned unless asked otherwise.

    Documents are read once for each ``pass_items`` items, and nothing is shuffled. Null, empty and
    wordless texts and items match nothing; items with a null id are left out. Repeated items and rows
    give repeated pairs; an empty table on either side gives an empty result. Other columns are not read.
    """
    if threshold <= COMMON_PART:
        raise ValueError(f"the threshold must be above {COMMON_PART}")
    key = docs.schema[id_column].dataType.simpleString()
    item_type = benchmark.schema[item_column].dataType.simpleString()
    schema = f"doc_id {key}, item_id {item_type}, score double, question_overlap double, answer_overlap double, verified boolean"
    spark = docs.sparkSession
    results = []
    for index in _passes(benchmark, item_column, text_column, pass_items):
        shared = spark.sparkContext.broadcast(index)

        def match(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            index = shared.value
            ids = pa.array(index.ids)
            for batch in batches:
                rows = list(_scan(index, batch.column(1), threshold))
                columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
                question, answer = np.array(columns[3], float), np.array(columns[4], float)
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": batch.column(0).take(pa.array(columns[0], pa.int64())),
                        "item_id": ids.take(pa.array(columns[1], pa.int64())) if rows else pa.array([], ids.type),
                        "score": pa.array(columns[2], pa.float64()),
                        "question_overlap": question,
                        "answer_overlap": answer,
                        "verified": (question >= question_overlap) & (answer >= answer_overlap),
                    }
                )

        if index.ids:
            results.append(docs.select(id_column, text_column).mapInArrow(match, schema))
    if not results:
        return spark.createDataFrame([], schema)
    out = results[0]
    for more in results[1:]:
        out = out.unionByName(more)
    return out.where("verified") if verified_only else out


def decontaminate(
    docs: DataFrame,
    benchmark: DataFrame,
    threshold: float = THRESHOLD,
    question_overlap: float = QUESTION_OVERLAP,
    answer_overlap: float = ANSWER_OVERLAP,
    pass_items: int = PASS_ITEMS,
    id_column: str = "doc_id",
    item_column: str = "item_id",
    text_column: str = "text",
) -> DataFrame:
    """The documents without those that hold a test item, verified as in :func:`contaminated`. Every row is
    judged by its own text where it is read, so nothing is shuffled. A null id is kept: no decision can name it."""
    if threshold <= COMMON_PART:
        raise ValueError(f"the threshold must be above {COMMON_PART}")
    at_id, at_text = docs.columns.index(id_column), docs.columns.index(text_column)
    for index in _passes(benchmark, item_column, text_column, pass_items):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def clean(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep = np.ones(len(batch), bool)
                for text, _, _, question, answer in _scan(shared.value, batch.column(at_text), threshold):
                    if question >= question_overlap and answer >= answer_overlap:
                        keep[text] = False
                yield batch.filter(pc.or_(pa.array(keep), batch.column(at_id).is_null()))

        if index.ids:
            docs = docs.mapInArrow(clean, docs.schema)
    return docs
