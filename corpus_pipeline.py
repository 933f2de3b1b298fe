"""From raw documents to training sequences, in stages that are tables.

Every stage reads all that the one before it kept, and each but the last returns the columns of
documents. Toxic documents go; lines that repeat an earlier line go, and documents of which nothing is
left; of each group of near duplicates the document with the smallest id stays; documents that hold a
test item go; the rest is packed into sequences of tokens. Documents with a null id are never named by a
decision about another document; of the stages that decide by id they pass unchanged.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webspark.llm import decontamination, line_dedup, ngram_join, packing, toxicity
from webspark.llm.tables import with_package, written

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the lexicon, learned from the labelled ones, doesn't call toxic."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    learned = labels.where(F.crc32(F.col("doc_id").cast("string")) % 5 != 0)
    lexicon = toxicity.learn(docs, learned)
    return toxicity.score(docs, lexicon).where("predicted = 0").select(*docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without repeated lines, however short; ``n_chars`` follows the text. A document of which
    no word is left goes."""
    rest = line_dedup.dedup_lines(docs, line_dedup.NEAR_CHARS, exact_chars=line_dedup.EXACT_CHARS).where(
        (F.col("lines_removed") == 0) | F.regexp_like("text", F.lit(r"[A-Za-z0-9]|[^\x00-\x7F]"))
    )
    if "n_chars" in docs.columns:
        changed = F.when(F.col("lines_removed") > 0, F.char_length("text").cast("long"))
        rest = rest.withColumn("n_chars", F.coalesce(changed, F.col("n_chars")))
    return rest.select(*docs.columns)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group, the one with the smallest id; of rows equal in id and text one."""
    first = (
        ngram_join.ngram_join(docs)
        .where("doc_id = component_id")
        .select("doc_id")
        .distinct()
    )
    kept = docs.join(first, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return kept.unionByName(docs.where("doc_id IS NULL")).select(*docs.columns)


def drop_test_items(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no test item."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence."""
    return packing.pack_documents(docs, keep_ids=False)


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", with_package(drop_toxic)),
    ("line_dedup", with_package(drop_repeated_lines)),
    ("ngram_join", with_package(drop_near_duplicates)),
    ("decontamination", with_package(drop_test_items)),
    ("best_fit_packing", with_package(pack)),
]
# Tokens and learned weights are beyond SQL; the stages are tested against brute force.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after the other, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
