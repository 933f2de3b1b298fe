"""Toxicity by a weighted lexicon, found by Aho-Corasick in folded text.

Terms are the beginnings of words (or whole words). Text and terms are folded alike: lower case,
look-alike letters of other scripts to the Latin ones, digits and signs that stand for letters within
words to these letters. A text's score grows with the weights of the terms that it holds and with
their share of its words, so that one word counts less in a long text; terms inside an exception
phrase don't count. The lexicon, its weights and the two coefficients are learned from labels.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Letters of other scripts that look like Latin ones, and digits and signs for letters.
LOOK_ALIKES = {
    "а": "a", "в": "b", "с": "c", "ԁ": "d", "е": "e", "һ": "h", "і": "i", "ј": "j", "к": "k", "м": "m",
    "н": "h", "о": "o", "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "ѵ": "v", "ԝ": "w",
    "α": "a", "β": "b", "ε": "e", "η": "n", "ι": "i", "κ": "k", "ν": "v", "ο": "o", "ρ": "p", "τ": "t",
    "υ": "u", "χ": "x", "ı": "i", "ɡ": "g", "ℓ": "l",
}
SUBSTITUTIONS = {
    "0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i",
}

# Labelled rows that are learned from, at most, of either label. Nothing else is bounded.
TRAINING_ROWS = 8_000
# A term is a beginning of a word of so many letters.
SHORTEST, LONGEST = 3, 12
# A term's part of toxic documents may differ by chance with this probability, over all terms tried.
SIGNIFICANCE = 0.01
# A term must be this much more frequent in toxic than in other documents.
LEAST_RATIO = 8.0

_LETTERS = re.compile(r"[^\W\d_]+")
_WORD = re.compile(r"\S+")
# Full-width forms are an offset from ASCII.
_FOLD = {ord(a): b for a, b in LOOK_ALIKES.items()} | {c: chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_ODD = re.compile("[" + "".join(map(chr, _FOLD)) + "]")
_ANY_SIGN = re.compile(r"[013457@$!]")
# Signs within a word; at its start before two letters (with signs between them or not), a run of digits
# before three; at its end, after two letters (so too) or as a run of signs after one. A word starts after
# white space, a quote or a bracket. A single $ at the end may be a currency, and ! a mark.
_SIGN = re.compile(
    r"(?<=[^\W\d_])[013457@$!]+(?=[^\W\d_])"
    r"|(?<![^\s\"'`(\[{<*_~«»„“”‘’¿¡])(?:[013457@$]|[013457]*[@$][013457@$]*|[013457]+(?=[^\W\d_]{3}))"
    r"(?=[^\W\d_][013457@$!]*[^\W\d_])"
    r"|(?:(?<=[^\W\d_]{2})|(?<=[^\W\d_][013457@$!][^\W\d_]))[013457@$]*[013457@](?![\w@$])"
    r"|(?<=[^\W\d_])[@$]{2,}(?![\w@$])"
)


def fold(text: str | None) -> str:
    """Lower case without disguises; null is empty."""
    text = (text or "").lower()
    if not text.isascii() and _ODD.search(text):
        text = text.translate(_FOLD).lower()
    if not _ANY_SIGN.search(text):
        return text
    return _SIGN.sub(lambda m: "".join(SUBSTITUTIONS[c] for c in m.group()), text)


@dataclass
class Lexicon:
    """Terms with weights, and a line that turns a text's figures into a probability."""

    weights: dict[str, float] = field(default_factory=dict)
    exceptions: frozenset[str] = frozenset()
    coefficients: tuple[float, float, float] = (-3.0, 0.0, 0.0)

    def automaton(self):
        """The terms as an automaton, or None without terms; an exception phrase is a term as well."""
        import ahocorasick

        made = ahocorasick.Automaton()
        for term in self.weights:
            made.add_word(term, (len(term), term))
        for phrase in self.exceptions:
            made.add_word(phrase, (len(phrase), None))
        if len(made) == 0:
            return None
        made.make_automaton()
        return made


def matches(automaton, folded: str) -> list[tuple[int, int, str]]:
    """(start, end, term) of the terms at the start of a word and outside exception phrases."""
    if automaton is None:
        return []
    found, spared = [], []
    for last, (length, term) in automaton.iter(folded):
        start = last + 1 - length
        if start and folded[start - 1].isalpha():
            continue
        (spared if term is None else found).append((start, last + 1, term))
    if spared:
        found = [f for f in found if not any(s <= f[0] and f[1] <= e for s, e, _ in spared)]
    return found


def figures(lexicon: Lexicon, automaton, text: str | None) -> tuple[float, float, int]:
    """(log of one plus the summed weights, weights per hundred words, matches)."""
    folded = fold(text)
    hits = matches(automaton, folded)
    if not hits:
        return 0.0, 0.0, 0
    total = sum(lexicon.weights[t] for _, _, t in hits)
    return math.log1p(total), math.log1p(100 * total / len(_WORD.findall(folded))), len(hits)


def probability(lexicon: Lexicon, first: float, second: float) -> float:
    a, b, c = lexicon.coefficients
    return 1 / (1 + math.exp(-min(max(a + b * first + c * second, -40), 40)))


# --- learning ----------------------------------------------------------------------------------


def _beginnings(text: str | None) -> set[str]:
    words = set(_LETTERS.findall(fold(text)))
    return {w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)}


def _log_tail(hits: int, n: int, part: float) -> float:
    """Log of the chance that ``n`` draws with probability ``part`` hit at least ``hits`` times, from
    above (Chernoff)."""
    share = hits / n
    if share <= part:
        return 0.0
    other = (1 - share) * math.log((1 - share) / (1 - part)) if share < 1 else 0.0
    return -n * (share * math.log(share / part) + other)


def choose_terms(counts: dict[str, tuple[int, int]], toxic: int, clean: int) -> dict[str, float]:
    """Terms with weights, from (toxic, clean) documents with each beginning.

    A beginning counts when its toxic share is no accident and its ratio is high. Of the beginnings of
    a word the one that is least an accident is taken: a longer one misses documents, a shorter one takes
    in other words.
    """
    if not toxic or not clean:
        return {}
    part = toxic / (toxic + clean)
    limit = math.log(SIGNIFICANCE / max(len(counts), 1))
    good: dict[str, tuple[float, float]] = {}
    for term, (bad, fine) in counts.items():
        ratio = ((bad + 0.5) / (toxic + 1)) / ((fine + 0.5) / (clean + 1))
        accident = _log_tail(bad, bad + fine, part)
        if ratio >= LEAST_RATIO and accident <= limit:
            good[term] = (accident, math.log(ratio))
    chosen: dict[str, float] = {}
    taken: set[str] = set()  # the chosen terms and their beginnings
    for term in sorted(good, key=lambda t: (good[t][0], -len(t), t)):
        starts = [term[:n] for n in range(SHORTEST, len(term) + 1)]
        if term not in taken and not any(t in chosen for t in starts):
            chosen[term] = good[term][1]
            taken.update(starts)
    return chosen


def _training_ids(labels: DataFrame, id_column: str, label_column: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids of either label, chosen by a hash of the id."""
    known = labels.select(id_column, F.col(label_column).cast("int").alias("ws_label")).dropna().distinct()
    order = [F.xxhash64(id_column), id_column]
    parts = [known.where(F.col("ws_label") == k).orderBy(*order).limit(rows) for k in (0, 1)]
    return parts[0].union(parts[1])


def _logistic(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Coefficients of a logistic line, by Newton steps with a small ridge."""
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    ridge = np.diag([1e-6, 0.05, 0.05])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x.T * (p * (1 - p))) @ x + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    return w


def learn(
    docs: DataFrame,
    labels: DataFrame,
    exceptions: tuple[str, ...] = (),
    rows: int = TRAINING_ROWS,
    id_column: str = "doc_id",
    text_column: str = "text",
    label_column: str = "toxic",
) -> Lexicon:
    """The lexicon of labelled documents, at most ``rows`` of each label.

    Labels and ids choose and mark the rows; they are no part of a score. Null labels, ids and texts
    are left out, and without rows of both labels the lexicon is empty and every score low. A term
    that follows the same word again and again in documents that are not toxic, and never in toxic
    ones, becomes an exception phrase beside those given.
    """
    ids = F.broadcast(_training_ids(labels, id_column, label_column, rows))  # at most 2 * rows
    known = docs.select(id_column, text_column).join(ids, id_column).select(text_column, "ws_label").dropna()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals, found = Counter(), (Counter(), Counter())
        for batch in batches:
            for text, label in zip(*batch.columns, strict=True):
                label = int(label.as_py() == 1)
                totals[label] += 1
                found[label].update(_beginnings(text.as_py()))
        terms = ["", *set(found[0]) | set(found[1])]
        found[0][""], found[1][""] = totals[0], totals[1]
        yield pa.RecordBatch.from_pydict(
            {"term": terms, "bad": [found[1][t] for t in terms], "fine": [found[0][t] for t in terms]}
        )

    counted = known.mapInArrow(count, "term string, bad long, fine long").groupBy("term")
    counted = counted.agg(F.sum("bad").alias("bad"), F.sum("fine").alias("fine"))
    counts = {r["term"]: (r["bad"], r["fine"]) for r in counted.where("bad >= 3 OR term = ''").collect()}
    toxic, clean = counts.pop("", (0, 0))
    lexicon = Lexicon(choose_terms(counts, toxic, clean), frozenset(fold(p) for p in exceptions if p))
    if not lexicon.weights:
        return lexicon
    lexicon.exceptions |= _exceptions(known, lexicon)
    seen = [(r["first"], r["second"], r["label"]) for r in _figures(known, lexicon).collect()]
    x = np.array([s[:2] for s in seen], float)
    lexicon.coefficients = tuple(_logistic(x, np.array([s[2] for s in seen], float)).tolist())
    return lexicon


def _exceptions(known: DataFrame, lexicon: Lexicon) -> set[str]:
    def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            rows = []
            for text, label in zip(*batch.columns, strict=True):
                folded = fold(text.as_py())
                for start, end, _ in matches(automaton, folded):
                    word = re.search(r"[^\W\d_]+ $", folded[max(0, start - 40) : start])
                    rest = _LETTERS.match(folded, start)
                    if word and rest:
                        rows.append((word.group() + rest.group(), int(label.as_py() == 1)))
            rows = list(dict.fromkeys(rows))
            yield pa.RecordBatch.from_pydict(
                {"phrase": pa.array([r[0] for r in rows], pa.string()), "bad": pa.array([r[1] for r in rows], pa.int64())}
            )

    found = known.mapInArrow(phrases, "phrase string, bad long").groupBy("phrase")
    found = found.agg(F.sum("bad").alias("bad"), F.count("*").alias("n")).where("bad = 0 AND n >= 5")
    return {r["phrase"] for r in found.collect()}


def _figures(known: DataFrame, lexicon: Lexicon) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            made = [figures(lexicon, automaton, t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_pydict(
                {
                    "first": pa.array([m[0] for m in made], pa.float64()),
                    "second": pa.array([m[1] for m in made], pa.float64()),
                    "label": batch.column(1).cast(pa.int64()),
                }
            )

    return known.mapInArrow(rows, "first double, second double, label long")


# --- scoring -----------------------------------------------------------------------------------


def score(docs: DataFrame, lexicon: Lexicon, text_column: str = "text") -> DataFrame:
    """The documents with ``score`` (0 to 1), ``matches`` and ``predicted`` (1 from a score of 0.5).

    Every text is read whole, row by row, without a shuffle. A null or empty text has the score of a
    text without matches. Columns of the input with these names are replaced.
    """
    made = ("score", "matches", "predicted")
    kept = [c for c in docs.columns if c.lower() not in made]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = lexicon.automaton()
        for batch in batches:
            found = [figures(lexicon, automaton, t.as_py()) for t in batch.column(batch.num_columns - 1)]
            scores = np.array([probability(lexicon, a, b) for a, b, _ in found], float)
            columns = dict(zip(kept, batch.columns[:-1], strict=True))
            yield pa.RecordBatch.from_pydict(
                columns
                | {
                    "score": scores,
                    "matches": pa.array([f[2] for f in found], pa.int32()),
                    "predicted": (scores >= 0.5).astype(np.int32),
                }
            )

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields if f.name in kept]
    schema = ", ".join([*kinds, "score double", "matches int", "predicted int"])
    return docs.select(*[F.col(f"`{c}`") for c in kept], F.col(text_column).alias("ws_text")).mapInArrow(rows, schema)
