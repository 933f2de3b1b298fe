import pytest

from webspark.llm import toxicity as tx


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        (None, ""), ("IDIOT", "idiot"), ("1d10t", "idiot"), ("іdіоt", "idiot"), ("ｉｄｉｏｔ", "idiot"), ("m0r0n$", "moron$"),
        ("2024 and 10 of 3", "2024 and 10 of 3"), ("café", "café"), ("5tupid!", "stupid!"), ("cl0wn 404", "clown 404"),
    ],
)
def test_fold(text, folded):
    assert tx.fold(text) == folded


def test_matches_start_words_and_spare_exceptions():
    lexicon = tx.Lexicon({"trash": 2.0, "lowei": 3.0}, frozenset({"trash can"}))
    found = tx.matches(lexicon.automaton(), tx.fold("Trash, pretrash; a trash can and loweien tr4sh"))
    assert [t for _, _, t in found] == ["trash", "lowei", "trash"]
    assert tx.matches(tx.Lexicon().automaton(), "anything") == []


def _labelled(spark):
    filler = "the plain words of a text that says nothing much at all number".split()
    rows, labels = [], []
    for k in range(600):
        toxic = k % 6 == 0
        words = [filler[(k * 7 + j * (k % 5 + 1)) % len(filler)] for j in range(30)]
        if toxic:
            words[k % 20 : k % 20] = [f"zork{filler[k % 11]}", "m0ron" if k % 4 else "moron"]
        elif k % 9 == 0:
            words[5:5] = ["friendly", "morons"]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    return docs, spark.createDataFrame(labels, "doc_id long, toxic int")


def test_learns_terms_and_scores_held_out_rows(spark):
    docs, labels = _labelled(spark)
    lexicon = tx.learn(docs, labels.where("doc_id % 5 != 0"))
    assert any(t.startswith("zork") for t in lexicon.weights)
    scored = tx.score(docs, lexicon).join(labels, "doc_id").where("doc_id % 5 = 0").collect()
    right = sum(r["predicted"] == r["toxic"] for r in scored)
    assert right >= 0.98 * len(scored)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5) for r in scored)


def test_longer_texts_score_lower():
    lexicon = tx.Lexicon({"moron": 3.0}, coefficients=(-3.0, 1.0, 1.5))
    short = tx.figures(lexicon, lexicon.automaton(), "you moron")
    long = tx.figures(lexicon, lexicon.automaton(), "you moron " + "word " * 500)
    assert tx.probability(lexicon, *short[:2]) > tx.probability(lexicon, *long[:2])


def test_odd_rows(spark, texts):
    docs = texts((1, None), (2, ""), (None, "a moron"), (3, "moron " * 100000), (4, "x"), (4, "x")).withColumn("score", docs_score())
    lexicon = tx.Lexicon({"moron": 3.0}, coefficients=(-3.0, 2.0, 1.0))
    out = tx.score(docs, lexicon)
    assert out.columns == [*[c for c in docs.columns if c != "score"], "score", "matches", "predicted"]
    got = sorted(((str(r["doc_id"]), r["predicted"], r["matches"]) for r in out.collect()))
    assert got == [("1", 0, 0), ("2", 0, 0), ("3", 1, 100000), ("4", 0, 0), ("4", 0, 0), ("None", 1, 1)]
    assert tx.score(docs.limit(0), lexicon).count() == 0
    empty = tx.learn(docs, spark.createDataFrame([], "doc_id long, toxic int"))
    assert empty.weights == {} and tx.score(docs, empty).agg({"predicted": "max"}).first()[0] == 0
    one_side = tx.learn(docs, spark.createDataFrame([(4, 0), (4, None), (None, 1)], "doc_id long, toxic int"))
    assert one_side.weights == {}


def docs_score():
    from pyspark.sql import functions as F

    return F.lit("an older score")


@pytest.mark.parametrize(
    ("text", "folded"),
    [
        ("whor3", "whore"), ("a$$", "ass"), ("@$$hole", "asshole"), ('"$tupid" (5tupid) [@ss]', '"stupid" (stupid) [ass]'),
        ("id1o7", "idiot"), ("m0r0n5.", "morons."), ("455hole", "asshole"), ("12 3rd4 $100 us$ no! 10 km 404", "12 erda $100 us$ no! 10 km 404"),
        ("15th 30km a1 b2b", "15th 30km a1 b2b"),
    ],
)
def test_fold_at_the_ends_of_words(text, folded):
    assert tx.fold(text) == folded
