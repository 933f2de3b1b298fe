"""Phrase mining against plain counting."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from webspark.llm import collocations


def brute(rows, max_words=3, least=10, within=50):
    counts, sizes = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            words = re.findall(r"[^\x20\x09]+", piece)
            sizes[lang] += len(words)
            for n in range(1, max_words + 1):
                for i in range(len(words) - n + 1):
                    counts.setdefault(lang, Counter())[tuple(words[i : i + n])] += 1
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        for p, a in found.items():
            longer = (q for q in found if len(q) > len(p) and 100 * found[q] >= within * a)
            if any(q[i : i + len(p)] == p for q in longer for i in range(len(q) - len(p) + 1)):
                continue
            cuts = [(10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p))]
            score, _, l, r = min(cuts)
            out.append((lang, " ".join(p), a, l, r, sizes[lang], score))
    return sorted(out)


def _found(spark, rows, **options):
    docs = spark.createDataFrame([(*r, 1, "x") for r in rows], "lang string, text string, f long, phrase string")
    got = collocations.collocations(docs, **options).select("lang", "phrase", "a", "l", "r", "n", "score")
    return sorted(tuple(r) for r in got.collect())


def _texts(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["Été", "naïve", "A", "b-c", "日本"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    gaps = [" "] * 20 + ["  ", "\t", ", ", ".", "\n", "\r\n", "\x0b", "! ", "\xa0", " "]
    rows = []
    for _ in range(n):
        words = rng.choices(vocabulary, weights, k=rng.randrange(60))
        rows.append((rng.choice(["en", "fr", None]), "".join(w + rng.choice(gaps) for w in words)))
    return rows + [("en", None), (None, ""), ("xx", " . "), ("", "one word")]


@pytest.mark.parametrize("budget", [1 << 20, 50])
def test_equals_counting(spark, monkeypatch, budget):
    rows = _texts(budget, 150)
    assert _found(spark, rows, least=4, group_suffixes=budget) == brute(rows, least=4)


def test_repeated_rows_ties_and_longer_phrases(spark):
    rows = [("en", "alpha beta gamma delta. alpha beta")] * 40 + [("de", "x x x x x x x x x x x x x")] * 3
    assert _found(spark, rows, max_words=4) == brute(rows, max_words=4)
    assert _found(spark, rows) == brute(rows)


def test_long_text_is_taken_in_parts(monkeypatch):
    text = ("one two three, " * 40 + "four five six seven eight nine ten " * 30 + ".") * 3
    batch = pa.RecordBatch.from_arrays([pa.array(["en"]), pa.array([text])], ["lang", "text"])

    def pairs():
        out = Counter()
        for ids, follows, *_ in collocations._word_ids(batch, 0):
            at = np.flatnonzero(follows)
            out.update(zip(ids[at].tolist(), ids[at + 1].tolist()))
        return out

    whole = pairs()
    monkeypatch.setattr(collocations, "CHUNK_BYTES", 50)
    assert pairs() == whole


def test_empty_table_and_top(spark):
    assert _found(spark, [("en", "a b")][:0]) == []
    rows = [("en", "a b. c d. e f")] * 20 + [("fr", "g h")] * 30
    docs = spark.createDataFrame(rows, "lang string, text string")
    best = collocations.top(collocations.collocations(docs), 2).select("lang", "rank", "phrase").collect()
    assert sorted(map(tuple, best)) == [("en", 1, "a b"), ("en", 2, "c d"), ("fr", 1, "g h")]


def test_scores_beyond_64_bits(spark):
    a, l, r = 3 * 10**12 + 7, 4 * 10**12 + 1, 5 * 10**12 + 3
    made = spark.createDataFrame([(a, l, r)], "f long, l long, r long")
    got = made.select(collocations._score(F.col("l"), F.col("r")).alias("s")).head().s
    assert got == 10**6 * a * a // (l * r)


def test_groups_hold_their_budget(spark):
    nodes = spark.createDataFrame([(k << 46, 1 + k % 7) for k in range(-40000, 40000, 7)], "w0 long, f long")
    groups = collocations._groups(nodes, 100)
    words = np.array([r.w0 for r in nodes.collect()]).view(np.uint64)
    weights = np.array([r.f for r in nodes.collect()])
    assert np.bincount(groups.of(words, words), weights).max() <= 100 * 1.5
