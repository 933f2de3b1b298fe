import math
import random
import re
from collections import Counter

import pytest

from webspark.llm import decontamination as dc

WORD = re.compile(r"[^\W_]+|[^\x00-\x7f]+")


def words(text):
    return re.findall(r"[0-9a-z\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))


def brute(docs, items, threshold):
    """BM25 of every item for every passage, in one plain loop."""
    known = [(i, words(t)) for i, t in items]
    mean = sum(len(w) for _, w in known) / len(known)
    df = Counter(t for _, w in known for t in set(w))
    idf = {t: math.log(1 + (len(known) - n + 0.5) / (n + 0.5)) for t, n in df.items()}

    def impact(w):
        tf = Counter(w)
        part = {t: idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, n in tf.items()}
        return {t: p / sum(part.values()) for t, p in part.items()}

    impacts = [(i, impact(w)) for i, w in known if w]
    stride = max(dc.STRIDE_WORDS, max(len(w) for _, w in known))
    out = set()
    for d, text in docs:
        w = words(text)
        for at in range(0, len(w), stride):
            passage = set(w[at : at + 2 * stride])
            out |= {(d, i) for i, p in impacts if sum(v for t, v in p.items() if t in passage) >= threshold - 1e-9}
    return out


@pytest.mark.parametrize("seed", range(4))
def test_retrieval_equals_brute_force(spark, seed):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(300)]
    weights = [1 / (k + 1) for k in range(300)]
    items = [(k, " ".join(rng.choices(vocabulary, weights, k=rng.randint(1, 30))) + ".") for k in range(70)]
    items += [(100 + k, items[3][1]) for k in range(6)]
    docs = []
    for k in range(60):
        w = rng.choices(vocabulary, weights, k=rng.randint(0, 500))
        if rng.random() < 0.5:
            at = rng.randrange(len(w) + 1)
            w[at:at] = rng.choice(items)[1].split()
        docs.append((k, " ".join(w)))
    want = brute(docs, items, 0.6)
    d = spark.createDataFrame(docs, "doc_id long, text string")
    b = spark.createDataFrame(items, "item_id long, text string")
    got = dc.contaminated(d, b, threshold=0.6, verified_only=False).collect()
    assert {(r["doc_id"], r["item_id"]) for r in got} == want and len(got) == len(want)
    parts = dc.contaminated(d, b, threshold=0.6, verified_only=False, pass_items=20).collect()
    scores = {(r["doc_id"], r["item_id"]): r["score"] for r in got}
    # Blocks of items give the same but for the mean length.
    assert len({(r["doc_id"], r["item_id"]) for r in parts} ^ set(scores)) <= len(scores) // 5


def test_planted_items_are_found(spark, documents, sf_dir):
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    texts = [(r["doc_id"], " ".join(words(r["text"]))) for r in documents.collect()]
    items = [(r["item_id"], " ".join(words(r["text"]))) for r in benchmark.collect()]
    want = {(d, i) for d, t in texts for i, q in items if f" {q} " in f" {t} "}
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(documents, benchmark).collect()}
    assert want and got >= want and len(got) <= 1.1 * len(want)
    clean = dc.decontaminate(documents, benchmark)
    assert clean.count() == len(texts) - len({d for d, _ in got}) and clean.columns == documents.columns


def test_odd_rows(spark, texts):
    items = spark.createDataFrame(
        [(1, "What holds the first of the words? The second sentence does."), (2, None), (3, ""), (4, "..."), (None, "what holds"), (5, "Single words of one sentence only here")],
        "item_id long, text string",
    )
    question = "What holds the first of the words?"
    docs = texts(
        (1, None), (2, ""), (3, "?!"), (None, "intro " + question + " the second sentence does"), (4, question),
        (5, "x " * 30000 + question + "### The second sentence does." + " y" * 30000), (6, "single WORDS of one sentence only here%%%"),
        (6, "single WORDS of one sentence only here%%%"), (7, "the second sentence does"),
    )
    got = sorted((str(r["doc_id"]), r["item_id"]) for r in dc.contaminated(docs, items).collect())
    assert got == [("5", 1), ("6", 5), ("6", 5), ("None", 1)]
    assert {r["doc_id"] for r in dc.decontaminate(docs, items).collect()} == {1, 2, 3, None, 4, 7}
    assert dc.contaminated(docs, items.limit(0)).count() == 0
    assert dc.contaminated(docs.limit(0), items).count() == 0
    with pytest.raises(ValueError):
        dc.contaminated(docs, items, threshold=0.1)


def test_items_of_every_script(spark, texts):
    items = [
        (1, "今天天气很好我们去公园。答案是北京。"),
        (2, "東京タワーの高さは何メートルですか？三百三十三メートルです。"),
        (3, "Wer schrieb «Über die Größe» im Jahr 1905? Das schrieb Ödön Müller."),
        (4, "ประเทศไทยมีเมืองหลวงชื่ออะไร กรุงเทพมหานคร"),
        (5, "ΠΟΙΟΣ ΕΓΡΑΨΕ ΤΗΝ ΟΔΥΣΣΕΙΑ; Ο ΟΜΗΡΟΣ ΕΓΡΑΨΕ ΤΗΝ ΟΔΥΣΣΕΙΑ."),
        (6, "Which word has a soft hyphen in it? The word hyphenation has it."),
    ]
    b = spark.createDataFrame(items, "item_id long, text string")
    other = "昨日は雨が降りましたので家で本を読みました。明天我们去上海看朋友。"
    docs = texts(
        (1, other + items[0][1] + other),
        (2, "，".join([other, items[1][1], other])),
        (3, "Intro — wer schrieb „über die Größe“ im Jahr 1905… DAS SCHRIEB ÖDÖN MÜLLER!"),
        (4, "x " + items[3][1] + " y"),
        (5, "(" + items[4][1].lower().replace("ς", "σ") + ")"),
        (6, "which word has a soft hy\u00adphen in it? “the word hyphen\u00adation” has it"),
        (7, other * 50),
        (8, "今天下雨我们在家。"),
    )
    got = {(r["doc_id"], r["item_id"]) for r in dc.contaminated(docs, b).collect()}
    assert {(k, k) for k in range(1, 7)} <= got and not {7, 8} & {d for d, _ in got}
    assert got == {(d, i) for d, i in got if d == i}
    for size in (20_000, 2):  # in one pass, and in several
        clean = dc.decontaminate(docs, b, pass_items=size)
        assert {r["doc_id"] for r in clean.collect()} == {7, 8}
        assert "Exchange" not in clean._jdf.queryExecution().executedPlan().toString()
