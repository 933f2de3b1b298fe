"""Merkle manifest against a tree built in plain Python, whole and in appends."""

from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from webspark.llm import merkle


def _h(parts):
    return sha256("".join(parts).encode()).hexdigest()


def _levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([_h(out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def _witness(levels, at):
    out = []
    for nodes in levels[:-1]:
        run = nodes[at // 16 * 16 : at // 16 * 16 + 16]
        out.append(("".join(run[: at % 16]), "".join(run[at % 16 + 1 :])))
        at //= 16
    return out


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[0], []).append(row)
    names = sorted(trees, key=lambda t: (t is not None, (t or "").encode()))
    for t in names:
        trees[t].sort(key=lambda r: (r[1] is not None, r[1] or 0, r[2]))
    levels = {t: _levels([r[2] for r in trees[t]]) for t in names}
    top = _levels([levels[t][-1][0] for t in names])
    out = []
    for place, t in enumerate(names):
        for at, row in enumerate(trees[t]):
            steps = _witness(levels[t], at) + _witness(top, place)
            node = row[3] or row[2]
            for left, right in steps:
                node = _h([left, node, right])
            proof = _h([a + b for a, b in steps])
            out.append((t, row[1], row[2], levels[t][-1][0], top[-1][0], proof, node, node == top[-1][0]))
    return out


def _rows(**sizes):
    out = []
    for tree, n in sizes.items():
        for k in range(n):
            leaf = _h([tree, str(k)])
            out.append((None if tree == "none" else tree, k, leaf, _h([leaf]) if k % 5 == 2 else None))
    return out


def _frame(spark, rows):
    made = spark.createDataFrame(rows, "tree string, key long, d string, f string")
    return made.select("tree", "key", F.unhex("d").alias("digest"), F.unhex("f").alias("folded"), F.lit(1).alias("pos"))


def _sorted(rows):
    return sorted((tuple(r) for r in rows), key=lambda r: (str(r[0]), str(r[1]), r[2]))


SIZES = {"none": 3, "a": 1, "b": 16, "c": 17, "d": 256, "é": 257, "e": 4100}


def test_equals_plain_tree(spark):
    rows = _rows(**SIZES)
    got = merkle.proofs(merkle.build(_frame(spark, rows)), with_witness=False).collect()
    assert _sorted(got) == _sorted(brute(rows))


def test_many_trees_and_repeated_rows(spark):
    rows = _rows(**{f"t{k}": 1 + k % 3 for k in range(300)})
    rows += [("t1", 0, _h(["t1", "0"]), None)] * 20 + [("t1", None, _h(["x"]), None)] * 2
    got = merkle.proofs(merkle.build(_frame(spark, rows)), with_witness=False).collect()
    want = brute(rows)
    # Equal leaves are in any order, so they are compared apart.
    assert _sorted(r for r in got if r["tree"] != "t1") == _sorted(r for r in want if r[0] != "t1")
    assert sorted(r.proof_sha256 for r in got) == sorted(r[5] for r in want)


def test_appends_equal_the_whole(spark):
    rows = [r for r in _rows(**SIZES) if r[0] != "a"] + _rows(a=1)
    parts = [
        [r for r in rows if r[1] < 10 and r[0] != "a"],
        [r for r in rows if 10 <= r[1] < 256],
        [r for r in rows if r[1] >= 256 or r[0] == "a"],
    ]
    made = merkle.build(_frame(spark, parts[0]))
    for k in (1, 2):
        made = merkle.append(made, _frame(spark, parts[k]))
        want = brute([r for p in parts[: k + 1] for r in p])
        assert _sorted(merkle.proofs(made, with_witness=False).collect()) == _sorted(want)
    assert made.root().head().root == want[0][4]
    assert {r.tree: r.root for r in made.subroots().collect()}["e"] == next(r[3] for r in want if r[0] == "e")


def test_append_must_come_after(spark):
    made = merkle.build(_frame(spark, _rows(a=5)))
    with pytest.raises(ValueError):
        merkle.append(made, _frame(spark, _rows(a=2)))


def test_witness_leads_to_the_root(spark):
    made = merkle.proofs(merkle.build(_frame(spark, _rows(a=300, b=2)))).collect()
    for row in made:
        node = row.leaf
        for step in row.witness:
            node = _h([step.left, node, step.right])
        assert node == row.root


def test_empty_and_single(spark):
    empty = merkle.build(_frame(spark, _rows(a=1)).limit(0))
    assert merkle.proofs(empty).collect() == [] and empty.root().collect() == []
    one = merkle.proofs(merkle.build(_frame(spark, _rows(a=1)))).collect()[0]
    assert one.leaf == one.subroot == one.root and one.proof_sha256 == _h([]) and one.witness == []


def test_row_digest_of_nulls(spark):
    made = spark.createDataFrame([(7, None, "é")], "doc_id long, lang string, text string")
    got = made.select(F.lower(F.hex(merkle.row_digest("doc_id", "lang", "text"))).alias("h")).head().h
    assert got == _h(["1:7", "-", "2:é"])
