import re

import pytest

from webspark.llm import quality

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def figures(text):
    t = text or ""
    w = WORD.findall(t)
    windows = [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    again = {k for k, x in enumerate(windows) if windows.count(x) > 1}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return (
        len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)),
        len({k + j for k in again for j in range(5)}),
    )


@pytest.mark.parametrize(
    "text",
    [None, "", " \n ", "a b c d e a b c d e f", "x x x x x x x", "﻿odd\x00 \x0b\x85 w", "a\nb\na\n\n\na", "𝒳 é|# <b>", "one two three four five six one two three four five", "w " * 20000],
)
def test_base_figures(spark, texts, text):
    docs = texts((1, text))
    row = quality.line_frequency(docs).first()
    want = figures(text) if text is None or len(text) < 10000 else (20000, 20000, 0, 0, 20000)
    assert tuple(row[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == want
    assert row["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0])


def test_lines_of_many_documents_go(spark):
    own = "this document %d says something of its own in more than ten words here %d"
    rows = [(k, "h1", f"Read  MORE about us 2{k % 10}\n" + own % (k, k * k)) for k in range(12)]
    rows += [(100 + k, "h2", "read more about us 00\n" + own % (k, k)) for k in range(3)]
    rows += [(200, "h1", "read more about us 11\nread more about us 11\nread more about us 22\n" + "a b"), (201, None, own % (1, 1)), (None, "h1", None)]
    rows += [rows[0], (12, "h1", rows[0][2])]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    out = quality.line_frequency(docs, max_docs=5, max_share=0.5)
    assert out.count() == len(rows)
    got = {(r["doc_id"], r["source"]): r for r in out.collect()}
    assert got[0, "h1"]["clean_text"] == own % (0, 0) and got[0, "h1"]["kept"] and got[0, "h1"]["boilerplate_lines"] == 1
    assert got[100, "h2"]["clean_text"].startswith("read more") and got[100, "h2"]["boilerplate_lines"] == 0
    assert not got[200, "h1"]["kept"] and got[200, "h1"]["words_left"] == 2
    assert got[201, None]["kept"] and not got[None, "h1"]["kept"] and got[None, "h1"]["clean_text"] is None
    strict = quality.line_frequency(docs, max_docs=5, max_share=0.99)
    assert strict.agg({"boilerplate_lines": "sum"}).first()[0] == 0


def test_equal_rows_count_once(spark):
    rows = [(1, "h", "a line that is here ten times or more for ten words")] * 30
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    assert quality.line_frequency(docs).where("boilerplate_lines > 0").count() == 0
    assert quality.line_frequency(docs.limit(0)).count() == 0


def test_a_large_host_protects_no_line(spark):
    # 60,000 documents: half a percent of them are 300.
    docs = spark.range(60000).selectExpr(
        "id AS doc_id", "'big' AS source",
        "concat('document ', sha1(cast(id AS string)), ' says a thing of its own in more than ten words', if(id < 250, '\\nread more about us', '')) AS text",
    )
    out = quality.line_frequency(docs)
    assert out.where("boilerplate_lines = 1 AND clean_text NOT LIKE '%read more%'").count() == 250
    assert out.where("boilerplate_lines = 0").count() == 60000 - 250
    bounded = quality.line_frequency(docs, share_docs=250)
    assert bounded.where("boilerplate_lines > 0").count() == 0
