import itertools
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from webspark.llm import packing


def _check_plan(plan, counts):
    left = counts.copy()
    for pattern, n in plan:
        assert n > 0 and sum(size * each for size, each in pattern) <= len(counts) - 1
        for size, each in pattern:
            left[size] -= each * n
    assert (left == 0).all()


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=9))
def test_plan_is_close_to_the_best(sizes):
    counts = np.bincount(sizes, minlength=13).astype(np.int64) if sizes else np.zeros(13, np.int64)
    plan = packing.pack_plan(counts)
    _check_plan(plan, counts)

    def best(items, rooms):
        if not items:
            return len(rooms)
        first, rest = items[0], items[1:]
        found = best(rest, [*rooms, 12 - first])
        for k, room in enumerate(rooms):
            if room >= first and room not in rooms[:k]:
                found = min(found, best(rest, [*rooms[:k], room - first, *rooms[k + 1 :]]))
        return found

    least = best(sorted(sizes, reverse=True), [])
    assert least <= sum(n for _, n in plan) <= least + 1
    # What the reduction fixes belongs to a best packing.
    rest = counts.copy()
    fixed = packing.reduce_instance(rest)
    left = list(itertools.chain.from_iterable([k] * int(n) for k, n in enumerate(rest)))
    assert sum(n for _, n in fixed) + best(sorted(left, reverse=True), []) == least


def test_large_instance_is_planned_by_counts():
    rng = np.random.default_rng(5)
    counts = np.bincount(np.clip(rng.lognormal(6, 1, 2_000_000), 1, 2048).astype(int), minlength=2049)
    plan = packing.pack_plan(counts)
    _check_plan(plan, counts)
    bound = -(-(counts * np.arange(2049)).sum() // 2048)
    assert sum(n for _, n in plan) <= bound * 1.001 + 1


def test_pieces_and_places(spark, documents):
    packed = packing.pack_documents(documents).toPandas()
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    exact.encode_special_tokens = True
    texts = {r["doc_id"]: r["text"] for r in documents.collect()}
    for doc, rows in packed.sort_values("piece").groupby("doc_id"):
        ids = [*exact.encode(texts[doc] or "", add_special_tokens=False).ids, 0]
        assert [i for part in rows["ids"] for i in part] == ids
        assert rows["start"].tolist() == np.cumsum([0, *rows["length"]])[:-1].tolist()
        assert (rows["length"].iloc[1:] == 2048).all()
        for r in rows.itertuples():
            assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    for _, rows in packed.sort_values("offset").groupby("sequence_id"):
        assert rows["offset"].tolist() == np.cumsum([0, *rows["length"]])[:-1].tolist()
        assert rows["length"].sum() <= 2048
    whole = packing.sequences(packing.pack_documents(documents)).toPandas()
    assert sum(map(len, whole["ids"])) == packed["length"].sum()


@pytest.mark.parametrize("text", ["<|endoftext|> a", "naïve façade ß \xa0 \x85 x", "привет мир 你好", "a" * 5000, " \n\t ", "�  x", "1234567 $$$"])
def test_ids_equal_the_tokenizer_file(text):
    quick = packing._encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    slow = packing._encoder(public_tokenizers.path("byte_bpe_50k.json"), None)
    assert quick(text).tolist() == slow(text).tolist()


def test_odd_rows(spark, texts):
    docs = texts((1, None), (2, ""), (None, "a b"), (3, "x " * 9000), (3, "x " * 9000), (4, "q"))
    packed = packing.pack_documents(docs, keep_ids=False).toPandas()
    assert packed[packed.doc_id.isin([1, 2])]["length"].tolist() == [1, 1]
    assert packed["doc_id"].isna().sum() == 1
    long = packed[packed.doc_id == 3]
    assert len(long) % 2 == 0 and long["length"].sum() == 2 * 18001 // 1 or len(long) > 2
    spots = packed[["sequence_id", "offset"]].drop_duplicates()
    assert len(spots) == len(packed)
    empty = packing.pack_documents(docs.limit(0))
    assert empty.count() == 0 and "sequence_id" in empty.columns


@pytest.mark.parametrize("unit", [" ", " \n", "\t", "\r\n", "!", "a" + " " * 4095, "a" + " " * 4100, "\xa0"])
def test_long_runs_have_the_ids_of_the_tokenizer_file(unit):
    text = "x" + unit * (300_000 // len(unit)) + "y"
    encode = packing._encoder(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"))
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    assert encode(text).tolist() == exact.encode(text, add_special_tokens=False).ids


def test_two_million_white_spaces(spark, texts):
    rows = [(1, " " * 2_000_000), (2, " \n" * 1_000_000), (3, "\t" * 2_000_000)]
    pieces = packing.token_pieces(texts(*rows), keep_ids=False)
    sums = {r["doc_id"]: r["n"] for r in pieces.groupBy("doc_id").agg({"length": "sum"}).withColumnRenamed("sum(length)", "n").collect()}
    assert sums == {1: 2_000_001, 2: 2_000_001, 3: 2_000_001}
