from collections import Counter

import corpus_pipeline as cp

from webspark.llm import decontamination, line_dedup, ngram_join


def test_stages_on_the_tables(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    before = docs
    for name, stage in cp.STAGES[:-1]:
        after = cp.written(stage(spark, before, sf_dir), name)
        assert after.columns == columns
        ids = [r["doc_id"] for r in after.select("doc_id").collect()]
        assert len(ids) == len(set(ids)) and set(ids) <= {r["doc_id"] for r in before.select("doc_id").collect()}
        if name == "line_dedup":
            assert line_dedup.duplicate_lines(after).where("distance = 0").count() == 0
        if name == "ngram_join":
            joined = ngram_join.ngram_join(after)
            assert joined.where("doc_id <> component_id").count() == 0
            assert len(ids) == ngram_join.ngram_join(before).select("component_id").distinct().count()
        if name == "decontamination":
            benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
            assert decontamination.contaminated(after, benchmark).count() == 0
        before = after
    last = cp.STAGES[-1][1](spark, before, sf_dir)
    assert last.select("doc_id").distinct().count() == len(ids)
    rows = Counter(tuple(r) for r in last.select("doc_id", "piece", "length", "ids_crc32").collect())
    assert rows == Counter(tuple(r) for r in cp.run(spark, sf_dir).select("doc_id", "piece", "length", "ids_crc32").collect())


def test_odd_rows_pass_every_stage(spark, sf_dir):
    rows = [(1, None), (2, ""), (None, None), (None, "a b"), (3, "same text of a row"), (3, "same text of a row"), (4, "w " * 30000), (5, "x")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1, "extra", 2.0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, hash string, score double")
    at = docs
    for _, stage in cp.STAGES[:-1]:
        at = stage(spark, at, sf_dir)
        assert at.columns == docs.columns
        assert stage(spark, docs.limit(0), sf_dir).count() == 0
    assert Counter(r["doc_id"] for r in at.collect()) == Counter([1, 2, None, None, 3, 4, 5])
    assert cp.STAGES[-1][1](spark, at, sf_dir).count() > 0
    assert cp.STAGES[-1][1](spark, docs.limit(0), sf_dir).count() == 0


def test_copies_with_short_lines_leave_nothing(spark, sf_dir):
    text = "A line of the first document, long enough.\nAll rights reserved.\n---\nEnd"
    rows = [(1, text), (2, text), (3, text.upper()), (4, "Something else here.\nEnd")]
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = {r["doc_id"]: r["text"] for r in cp.drop_repeated_lines(spark, docs, sf_dir).collect()}
    assert kept == {1: text, 4: "Something else here."}
