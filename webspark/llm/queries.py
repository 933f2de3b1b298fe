"""The registered queries of the package: every operator on its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webspark.llm import (
    collocations,
    decontamination,
    line_dedup,
    main_text,
    merkle,
    ngram_join,
    packing,
    quality,
    revisits,
    secrets,
    snapshots,
    surrogates,
    toxicity,
)
from webspark.llm.checks import CHECKS as CHECKS
from webspark.llm.tables import with_package

Query = Callable[[SparkSession, str], DataFrame]

SURROGATE_KEY = "a key of this run"


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def op1_line_frequency(spark: SparkSession, d: str) -> DataFrame:
    judged = quality.line_frequency(_table(spark, d, "documents"), with_text=False)
    return judged.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        "kept", "boilerplate_lines", "words_left",
    )


def op2_surrogates(spark: SparkSession, d: str) -> DataFrame:
    replaced = surrogates.replace_private(_table(spark, d, "documents"), SURROGATE_KEY)
    return replaced.select("doc_id", "text", "n_replaced")


def op3_toxicity(spark: SparkSession, d: str) -> DataFrame:
    docs, labels = _table(spark, d, "documents"), _table(spark, d, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    lexicon = toxicity.learn(docs, labels.where(~held_out))
    return toxicity.score(docs.select("doc_id", "text"), lexicon).select(
        "doc_id", held_out.alias("held_out"), "score", "predicted", "matches"
    )


def op4_snapshots(spark: SparkSession, d: str) -> DataFrame:
    return snapshots.collapse(_table(spark, d, "conversations"))


def captures(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(revisits, responses) derived from the pages: of each page two full captures, the older one with a
    fragment in its URL, and three revisits: between the captures, after them, and before them. The
    validators of the second revisit agree, differ, or are a date alone, in turn."""
    pages = _table(spark, d, "pages").select(
        "page_id",
        "url",
        F.md5("url").alias("old"),
        F.md5("html").alias("new"),
        F.char_length("html").cast("string").alias("size"),
        F.expr("timestamp'2024-01-01 00:00:00' + make_dt_interval(0, 0, page_id)").alias("base"),
    )

    def at(minutes: int) -> str:
        return f"base + make_dt_interval(0, 0, {minutes})"

    responses = pages.select(
        F.explode(
            F.expr(
                f"""array(
          named_struct('record_id', 2 * page_id, 'url', url || '#old', 'captured_at', {at(0)},
            'headers', map('ETag', '"' || old || '"', 'Content-Type', 'text/html', 'Content-Length', size,
              'Date', 'old'), 'payload_digest', old),
          named_struct('record_id', 2 * page_id + 1, 'url', url, 'captured_at', {at(120)},
            'headers', map('etag', 'W/"' || new || '"', 'Content-Type', 'text/html', 'Content-Length', size,
              'Date', 'new', 'Last-Modified', new), 'payload_digest', new))"""
            )
        ).alias("r")
    ).select("r.*")
    asked = pages.select(
        F.explode(
            F.expr(
                f"""array(
          named_struct('record_id', 3 * page_id, 'url', url, 'captured_at', {at(60)},
            'headers', map('ETag', 'W/"' || old || '"', 'Date', 'again', 'Content-Length', '0',
              'Connection', 'X-Trace, close', 'X-Trace', old), 'payload_digest', cast(null as string)),
          named_struct('record_id', 3 * page_id + 1, 'url', url, 'captured_at', {at(180)},
            'headers', map_filter(map('ETag', CASE page_id % 3 WHEN 0 THEN '"' || new || '"' WHEN 1 THEN 'other' END,
              'Last-Modified', new, 'Date', 'later', 'Cache-Control', 'no-store'), (k, v) -> v IS NOT NULL),
            'payload_digest', cast(null as string)),
          named_struct('record_id', 3 * page_id + 2, 'url', url, 'captured_at', {at(-100000000)},
            'headers', cast(null as map<string, string>), 'payload_digest', new))"""
            )
        ).alias("r")
    ).select("r.*")
    return asked, responses


def op5_revisits(spark: SparkSession, d: str) -> DataFrame:
    resolved = revisits.resolve_revisits(*captures(spark, d))
    lines = F.array_sort(F.transform(F.map_entries("merged_headers"), lambda e: F.concat(e["key"], F.lit("="), e["value"])))
    return resolved.select("record_id", "response_id", "verdict", F.array_join(lines, "|").alias("merged_headers"))


def op6_decontamination(spark: SparkSession, d: str) -> DataFrame:
    found = decontamination.contaminated(_table(spark, d, "documents"), _table(spark, d, "benchmark"))
    return found.drop("verified")


def op7_main_text(spark: SparkSession, d: str) -> DataFrame:
    made = main_text.extract(_table(spark, d, "pages"))
    return made.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


def op8_best_fit_packing(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack_documents(_table(spark, d, "documents"), keep_ids=False)


def op9_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngram_join.ngram_join(_table(spark, d, "documents"))


def op10_line_dedup(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    return line_dedup.duplicate_lines(docs, line_dedup.NEAR_CHARS, exact_chars=line_dedup.EXACT_CHARS).drop("twin")


def op11_merkle(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents")
    fields = ("source", "lang", "n_chars")
    lowered = F.translate("text", merkle.UPPER, merkle.LOWER)
    tampered = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    leaves = docs.select(
        F.col("source").alias("tree"),
        F.col("doc_id").alias("key"),
        merkle.row_digest("doc_id", *fields, "text").alias("digest"),
        F.when(tampered, merkle.row_digest("doc_id", *fields, lowered)).alias("folded"),
    )
    made = merkle.proofs(merkle.build(leaves), with_witness=False)
    return made.withColumnRenamed("key", "doc_id").drop("tree")


def op12_collocations(spark: SparkSession, d: str) -> DataFrame:
    best = collocations.top(collocations.collocations(_table(spark, d, "documents")))
    return best.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_secrets(spark: SparkSession, d: str) -> DataFrame:
    found = secrets.find_secrets(_table(spark, d, "documents"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.kind = {k})) as long)").alias(f"n_{secrets.KINDS[k]}") for k in range(3)]
    base = F.sha2(secrets.span_text("base"), 256).alias("base_sha256")
    return found.select("doc_id", *counts, base, secrets.span_text("spans").alias("spans"))


QUERIES: dict[str, Query] = {
    f.__name__: with_package(f)
    for f in (
        op1_line_frequency,
        op2_surrogates,
        op3_toxicity,
        op4_snapshots,
        op5_revisits,
        op6_decontamination,
        op7_main_text,
        op8_best_fit_packing,
        op9_ngram_join,
        op10_line_dedup,
        op11_merkle,
        op12_collocations,
        op13_secrets,
    )
}
