import random

import pytest

from webspark.llm import line_dedup as ld


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def brute(rows, least):
    """Repeats by the definition, for distinct ids."""
    lines = [
        (i, k, t.strip(" ").lower())
        for i, text in sorted(rows)
        for k, t in enumerate((text or "").split("\n") if text is not None else [])
        if len(t.strip(" ")) >= least
    ]
    out = set()
    for n, (i, k, t) in enumerate(lines):
        for j, m, u in lines[:n]:
            if abs(len(t) - len(u)) <= 1 and distance(t, u) <= 1:
                # The first equal line decides with what the line is near.
                first = next(x for x in lines if x[2] == t)
                near = [x for x in lines if x[:2] < first[:2] and distance(x[2], t) == 1]
                kept = min([first, *near])
                out.add((i, k, kept[0], kept[1], int(kept[2] != t)))
                break
    return out


@pytest.mark.parametrize("seed", range(2))
def test_equals_brute_force(spark, texts, seed):
    rng = random.Random(seed)
    bases = ["".join(rng.choices("ab", k=rng.randint(6, 20))) for _ in range(12)]

    def line():
        t = list(rng.choice(bases))
        for _ in range(rng.randint(0, 2)):
            at, how = rng.randrange(len(t)), rng.random()
            t[at : at + (how < 0.6)] = rng.choice(["a", "b", "é"]) if how > 0.3 else ""
        return "".join(t)

    rows = [(k, "\n".join(line() for _ in range(rng.randint(1, 4)))) for k in range(30)]
    got = {tuple(r) for r in ld.duplicate_lines(texts(*rows), min_chars=6).drop("twin").collect()}
    assert got == brute(rows, 6)


def test_one_edit_at_any_place(spark, texts):
    rows, first = [], {}
    for n in (32, 33, 63, 64, 65, 127, 128):
        line = "".join(chr(97 + (k * 7 + n) % 26) for k in range(n))
        made = [line]
        for k in range(n):
            made += [line[:k] + "#" + line[k + 1 :], line[:k] + line[k + 1 :], line[:k] + "+" + line[k:]]
        first |= {len(rows) + k: len(rows) for k in range(1, len(made))}
        rows += [(len(rows) + k, t) for k, t in enumerate(made)]
    got = {r["doc_id"]: r["kept_doc_id"] for r in ld.duplicate_lines(texts(*rows), min_chars=31).collect()}
    assert got == first


def test_odd_rows_and_rewriting(spark, texts):
    long = "x" * 70000 + "y"
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (4, "A line of thirty-two characters.\nshort\nanother line, which is long enough"),
        (5, "  a line of thirty-two characters.\nshort\nmine"), (6, long), (7, long[:-1] + "z"), (8, "keep\n" + long),
        (None, "a line of thirty-two characters!"), (9, "same row of a table, long enough here"), (9, "same row of a table, long enough here"),
    ]
    docs = texts(*rows)
    got = sorted(map(tuple, ld.duplicate_lines(docs).drop("twin").collect()), key=str)
    assert got == sorted([(5, 0, 4, 0, 0), (7, 0, 6, 0, 1), (8, 1, 6, 0, 0), (None, 0, 4, 0, 1)], key=str)
    out = ld.dedup_lines(docs)
    assert out.columns == [*docs.columns, "lines_removed"] and out.count() == len(rows)
    new = {r["doc_id"]: r["text"] for r in out.collect()}
    assert new[5] == "short\nmine" and new[7] == "" and new[8] == "keep" and new[1] is None and new[4] == rows[3][1]
    assert [r["text"] for r in out.where("doc_id = 9").collect()] == [rows[9][1]] * 2
    assert ld.dedup_lines(docs.limit(0)).count() == 0


def test_short_lines_repeat_exactly(spark, texts):
    rows = [(1, "All rights reserved.\nyes\n---\nMIT\né"), (2, "all rights reserved\nYES\n---\nyet"), (3, "mit \n é\nx"), (4, None)]
    got = {tuple(r) for r in ld.duplicate_lines(texts(*rows), ld.NEAR_CHARS, exact_chars=ld.EXACT_CHARS).drop("twin").collect()}
    assert got == {(2, 0, 1, 0, 1), (2, 1, 1, 1, 0), (3, 0, 1, 3, 0), (3, 1, 1, 4, 0)}
    assert ld.duplicate_lines(texts(*rows)).count() == 0
