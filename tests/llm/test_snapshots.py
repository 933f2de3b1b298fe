import random

from webspark.llm import snapshots


def test_random_logs_equal_brute_force(spark):
    rng = random.Random(1)
    logs = {}
    for k in range(80):
        turns = list(rng.choice(list(logs.values()))) if logs and rng.random() < 0.7 else []
        turns = turns[: rng.randint(0, len(turns))]
        turns += [(rng.choice("ua"), rng.choice(["x", "y", "", None])) for _ in range(rng.randint(0, 3))]
        logs[k] = turns or [("u", "x")]
    rows = [(k, 10 * n - 5, r, t) for k, turns in logs.items() for n, (r, t) in enumerate(turns)]
    rng.shuffle(rows)
    got = {r["conv_id"]: r for r in snapshots.collapse(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    want = {
        k
        for k, t in logs.items()
        if not any(len(u) > len(t) and u[: len(t)] == t or u == t and j < k for j, u in logs.items())
    }
    assert set(got) == want
    for k in want:
        assert got[k]["n_turns"] == len(logs[k]) and got[k]["copies"] == sum(u == logs[k] for u in logs.values())
        assert got[k]["rendered"] == "".join(f"<|im_start|>{r}\n{t or ''}<|im_end|>\n" for r, t in logs[k])


def test_odd_rows(spark):
    rows = [(None, 0, "u", "lost"), (1, None, "u", "a"), (1, 1, None, None), (2, 0, "u", "a"), (3, 0, "u", "a"), (3, 0, "u", "a"), (4, 5, "u", "z" * 300000)]
    turns = spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, size string, at int")
    got = {r["conv_id"]: r["rendered"] for r in snapshots.collapse(turns).collect()}
    assert set(got) == {1, 3, 4}
    assert got[1] == "<|im_start|>u\na<|im_end|>\n<|im_start|>unknown\n<|im_end|>\n" and len(got[4]) > 300000
    assert snapshots.collapse(turns.limit(0)).count() == 0


def test_plan_has_no_python(spark, sf_dir):
    from webspark.llm.queries import QUERIES

    for name in ("op1_line_frequency", "op4_snapshots"):
        plan = QUERIES[name](spark, sf_dir)._jdf.queryExecution().toString()
        assert not any(word in plan for word in ("Python", "Arrow", "Pandas"))
