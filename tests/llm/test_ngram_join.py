import random
import re
from collections import Counter

import numpy as np
import pytest

from webspark.llm import ngram_join as nj

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, size=5, percent=80):
    """(id, size of the set, component) of every row."""
    sets = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        sets.append({tuple(w[k : k + size]) for k in range(max(len(w) - size + 1, 1))} if w else set())
    root = list(range(len(rows)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * both >= percent * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    groups = {}
    for k, (i, _) in enumerate(rows):
        groups.setdefault(find(k), []).append(i)
    least = {k: min((i for i in g if i is not None), default=None) for k, g in groups.items()}
    return Counter((i, len(sets[k]), least[find(k)]) for k, (i, _) in enumerate(rows))


def corpus(seed, n):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)]
    shared = " ".join(rng.choices(vocabulary, k=12))
    texts = []
    for _ in range(n):
        if texts and rng.random() < 0.6:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
        else:
            words = rng.choices(vocabulary, k=rng.randint(1, 70))
            if rng.random() < 0.5:
                words += shared.split()
        texts.append(" ".join(words))
    return [(k, t) for k, t in enumerate(texts)]


def run(docs, **options):
    return Counter(map(tuple, nj.ngram_join(docs, **options).collect()))


@pytest.mark.parametrize("slices", [False, True])
def test_equals_brute_force(spark, texts, monkeypatch, slices):
    if slices:  # blocks of a few sets, few pivots: the way of large blocks
        monkeypatch.setattr(nj, "SLICE_SETS", 3)
        monkeypatch.setattr(nj, "PIVOTS", 1)
        monkeypatch.setattr(nj, "FEW", 2)
    rows = corpus(3, 150)
    assert run(texts(*rows)) == brute(rows)


def test_odd_rows(spark, texts):
    rows = [
        (1, None), (2, ""), (3, " \t\n"), (4, "One two"), (5, "one  TWO"), (6, "one two three"),
        (7, "a b c d e f"), (7, "a b c d e f"), (None, "a b c d e f"), (8, "É b c d e"), (9, "é b c d e"),
        (10, "long " * 40000), (11, " x y z"), (12, " x y z"),
    ]
    assert run(texts(*rows)) == brute(rows)
    assert run(texts((None, "only this"))) == Counter({(None, 1, None): 1})
    assert nj.ngram_join(texts((1, "a")).limit(0)).count() == 0


def test_trie_links_equal_pairs():
    rng = np.random.default_rng(2)
    base = rng.choice(400, 60, replace=False)
    sets = [np.unique(np.concatenate([rng.choice(base, 45, replace=False), rng.integers(0, 400, rng.integers(0, 12))])).astype(np.uint64) for _ in range(60)]
    got = {(k, p) for k, found in nj.trie_links(sets, sets) for p in found.tolist()}
    want = {
        (a, b)
        for a, x in enumerate(sets)
        for b, y in enumerate(sets)
        if 100 * len(np.intersect1d(x, y)) >= 80 * len(np.union1d(x, y))
    }
    assert got == want


def test_components(spark):
    from webspark.llm.components import components

    path = [(k, k + 1) for k in range(40)]
    edges = spark.createDataFrame([*path, (100, 90), (90, 90), (90, 100), (101, 100)], "a long, b long")
    got = {r["node"]: r["root"] for r in components(edges).collect()}
    assert got == {k: 0 for k in range(41)} | {90: 90, 100: 90, 101: 90}
