from datetime import datetime, timedelta

import pytest

from webspark.llm import revisits as rv

BASE = datetime(2024, 1, 1)
SCHEMA = "record_id long, url string, captured_at timestamp, headers map<string,string>, payload_digest string, body string, verdict string"


def at(minute):
    return None if minute is None else BASE + timedelta(minutes=minute)


@pytest.fixture
def resolve(spark):
    def make(asked, offered, **options):
        rows = [spark.createDataFrame([(i, u, at(m), h, d, b, "old") for i, u, m, h, d, b in x], SCHEMA) for x in (asked, offered)]
        out = rv.resolve_revisits(rows[0].drop("body"), rows[1], payload="body", **options)
        return {(r["record_id"], r["captured_at"]): r for r in out.collect()}

    return make


def test_verdicts_and_headers(resolve):
    offered = [
        (1, "http://h/a", 0, {"ETag": '"1"', "X-Old": "1", "Content-Length": "9"}, None, "first"),
        (2, "http://h:80/a#x", 10, {"etag": 'W/"2"', "Cache-Control": "old", "Content-Encoding": "gzip"}, "d2", "second"),
        (3, "http://h/a", 10, {"etag": '"3"', "Last-Modified": "m"}, None, "third"),
        (4, "http://h/b", 0, None, None, "bare"),
        (5, None, 0, {}, None, "no url"),
    ]
    asked = [
        (10, "http://h/a", 5, {"ETAG": 'W/"1"', "X-New": "n", "Content-Length": "0", "Connection": "x-hop", "X-Hop": "h"}, None, ""),
        (11, "http://h/a", 10, {"etag": '"1"'}, None, ""),  # strictly earlier: record 1
        (12, "http://h/a", 11, {"etag": '"3"', "last-modified": "other"}, None, ""),  # tags agree, dates don't count
        (13, "http://h/a", 12, {"last-modified": "m"}, None, ""),
        (14, "http://h/a", 13, {"etag": '"2"'}, None, ""),
        (15, "http://h/b", 1, None, "x", ""),
        (16, "http://h/a", 0, {}, None, ""), (17, "http://none/", 9, {}, None, ""), (18, None, 9, {}, None, ""),
        (19, "http://h/a", None, {}, None, ""), (10, "http://h/a", 5, {"etag": '"1"'}, None, ""),
    ]
    got = resolve(asked, offered)
    assert {k[0]: (r["response_id"], r["verdict"], r["body"]) for k, r in got.items()} == {
        10: (1, "resolved", "first"), 11: (1, "resolved", "first"), 12: (3, "resolved", "third"), 13: (3, "resolved", "third"),
        14: (3, "changed", None), 15: (4, "unvalidated", None), 16: (None, "no_response", None), 17: (None, "no_response", None),
        18: (None, "no_response", None), 19: (None, "no_response", None),
    }
    assert got[11, at(10)]["merged_headers"] == {"etag": '"1"', "x-old": "1", "content-length": "9"}


def test_header_rules(resolve):
    offered = [(1, "http://h/a", 0, {"ETag": '"1"', "X-Old": "1", "Content-Length": "9", "Date": "a", "date": "b"}, None, "b")]
    asked = [(10, "http://h/a", 5, {"ETAG": 'W/"1"', "X-New": "n", "Content-Length": "0", "Connection": "x-hop", "X-Hop": "h", "Keep-Alive": "5"}, None, "")]
    assert resolve(asked, offered)[10, at(5)]["merged_headers"] == {
        "etag": 'W/"1"', "x-old": "1", "content-length": "9", "date": "b", "x-new": "n"
    }


@pytest.mark.parametrize("slices", [1, 4, 64])
def test_as_of_equals_brute_force(spark, resolve, slices):
    import random

    rng = random.Random(slices)
    offered = [(k, f"http://h/{rng.randint(0, 3)}", rng.randint(0, 50), {"etag": "e"}, None, str(k)) for k in range(60)]
    asked = [(k, f"http://h/{rng.randint(0, 4)}", rng.randint(0, 50), {"etag": "e"}, None, "") for k in range(200)]
    got = resolve(asked, offered, slices=slices)
    for i, url, minute, *_ in asked:
        best = max(((m, k) for k, u, m, *_ in offered if u == url and m < minute), default=(None, None))[1]
        assert got[i, at(minute)]["response_id"] == best


def test_empty_tables(spark):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(1, "http://h/a", BASE, {}, None, "", "")], SCHEMA)
    assert rv.resolve_revisits(none, one).count() == 0
    assert rv.resolve_revisits(one, none).first()["verdict"] == "no_response"
    assert rv.resolve_revisits(none, none).count() == 0


def test_plans_hold_the_canonical_url_once(spark):
    one = spark.createDataFrame([(1, "http://h/a", BASE, {}, None, "", "")], SCHEMA)
    plan = rv.resolve_revisits(one, one)._jdf.queryExecution().optimizedPlan().toString()
    once = one.select(rv.canonicalize_url("url"))._jdf.queryExecution().optimizedPlan().toString()
    assert len(plan) < 2 * len(once)
