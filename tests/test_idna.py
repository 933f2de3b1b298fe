"""Hosts outside ASCII: Punycode, composition, width, and the URL functions that use them."""

import random
import unicodedata

import pytest
from conftest import column
from pyspark.sql import functions as F

from webspark.functions import idna
from webspark.functions import urls as U
from webspark.functions.domains import url_domain

# Sample strings of RFC 3492, section 7.1.
SAMPLES = [
    ("ليهمابتكلموشعربي؟", "egbpdaj6bu4bxfgehfvwxn"),
    ("他们为什么不说中文", "ihqwcrb4cv8a8dqg056pqjye"),
    ("Pročprostěnemluvíčesky", "Proprostnemluvesky-uyb24dma41a"),
    ("למההםפשוטלאמדבריםעברית", "4dbcagdahymbxekheh6e0a7fei0b"),
    ("なぜみんな日本語を話してくれないのか", "n8jok5ay5dzabd5bym9f0cm5685rrjetr6pdxa"),
    ("PorquénopuedensimplementehablarenEspañol", "PorqunopuedensimplementehablarenEspaol-fmd56a"),
    ("3年B組金八先生", "3B-ww4c5e180e575a65lsy2b"),
    ("安室奈美恵-with-SUPER-MONKEYS", "-with-SUPER-MONKEYS-pc58ag80a8qai00g7n9n"),
    ("そのスピードで", "d9juau41awczczp"),
    ("ü", "tda"),
    ("a", "a-"),
]
RANGES = [
    (0x61, 0x7B), (0xC0, 0x250), (0x300, 0x345), (0x1E00, 0x1F00), (0x391, 0x3D0), (0x3040, 0x3100), (0xFF21, 0xFFA0),
    (0x4E00, 0x4E40), (0xAC00, 0xAC40), (0x1100, 0x1113), (0x1161, 0x1176), (0x11A8, 0x11C3), (0x900, 0x960),
    (0x1F600, 0x1F610), (0xF900, 0xF910), (0x212A, 0x212C), (0x591, 0x5C0), (0x1D15E, 0x1D165), (0x2F800, 0x2F810),
]


def _names(spark, texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, w string").repartition(1).orderBy("i")


def _random(n):
    rng = random.Random(8)
    pool = [chr(c) for r in RANGES for c in range(*r)]
    return ["".join(rng.choices(pool, k=rng.randrange(1, 10))) for _ in range(n)]


def test_punycode_of_published_samples(spark):
    got = _names(spark, [t for t, _ in SAMPLES]).select("i", F.expr(idna.punycode_sql("w")).alias("p"))
    assert column(got, "p") == [p for _, p in SAMPLES]


def test_punycode_of_random_texts(spark):
    got = _names(spark, _random(1500)).select("w", F.expr(idna.punycode_sql("w")).alias("p"))
    for r in got.collect():
        assert r.p == r.w.encode("punycode").decode(), ascii(r.w)


def test_composition(spark):
    """Texts taken apart in canonical order, and a composed letter with a mark that belongs before its own."""
    texts = [unicodedata.normalize("NFD", "".join(c for c in t if not "\u1100" <= c < "\u1200")) for t in _random(1500)]
    texts = [t for t in texts if not any("\uac00" <= c <= "\ud7a3" for c in unicodedata.normalize("NFC", t))]
    texts += ["ê\u0323x", "o\u0323\u0302", "a\u0300\u0301", "\u0301a", "", "ka\u3099か\u3099"]
    got = _names(spark, texts).select("w", F.expr(idna.nfc_sql("w")).alias("n"))
    for r in got.collect():
        assert r.n == unicodedata.normalize("NFC", r.w), ascii(r.w)


SAME = [
    "http://BÜCHER.example/a",
    "http://bücher.example:80/a/",
    "http://ｂüｃｈｅｒ。ｅｘａｍｐｌｅ/a",
    "http://b%C3%BCcher.EXAMPLE/a",
    "http://xn--bcher-kva.example/a",
    "http://XN--BCHER-KVA.example/./a",
]


def test_forms_of_one_host_agree(spark):
    df = _names(spark, SAME)
    got = df.select(
        U.normalize_url("w").alias("n"), U.canonicalize_url("w").alias("c"), url_domain("w").alias("d"),
        U.url_hostname("w").alias("h"), U.robots_url("w").alias("r"),
    ).collect()
    assert {r.n for r in got} == {r.c for r in got} == {"http://xn--bcher-kva.example/a"}
    assert {r.d for r in got} == {r.h for r in got} == {"xn--bcher-kva.example"}
    assert {r.r.lower().replace(":80/", "/") for r in got} == {"http://xn--bcher-kva.example/robots.txt"}


@pytest.mark.parametrize(
    "url, normal",
    [
        ("http://straße.de/ß", "http://xn--strae-oqa.de/%C3%9F"),
        ("//Ü:Ü@例え.テスト:8080/x", None),
        ("//u:p@例え.テスト:8080/x", "//u:p@xn--r8jz45g.xn--zckzah:8080/x"),
        # A fold that would give a sign no host may have is not made.
        ("http://a／b.de/x", "http://a／b.de/x"),
        ("http://%ff.de/x", "http://%ff.de/x"),
        ("http://한국.kr", "http://xn--3e0b707e.kr"),
        ("http://ㄱ.\U0001f600.ws/", f"http://xn--{'ㄱ'.encode('punycode').decode()}.xn--e28h.ws"),
    ],
)
def test_cases(spark, url, normal):
    assert column(_names(spark, [url]).select(U.normalize_url("w").alias("n")), "n") == [normal]


def test_normal_form_is_stable(spark):
    hosts = [f"http://{t}.example/" for t in _random(200)]
    once = _names(spark, hosts).select("i", U.normalize_url("w").alias("w"))
    twice = once.select("w", U.normalize_url("w").alias("again"))
    assert all(r.w == r.again for r in twice.collect())


def test_ascii_hosts_skip_the_fold(spark):
    """The tables are literals of one place; a plan has no join, no Python and no second scan for them."""
    plan = spark.range(1).selectExpr("'http://a.de' AS w").select(U.normalize_url("w"))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Join" not in plan
