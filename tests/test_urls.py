import random
import re

import duckdb
import pandas as pd
import pytest
from conftest import column

from webspark.functions import urls as U
from webspark.functions.domains import url_domain
from webspark.plans import checks

NORMAL = [
    ("HTTP://Example.COM:80/a/./b/../c/?#top", "http://example.com/a/c", None),
    ("http://example.com/", "http://example.com", None),
    ("http://example.com//a///b", "http://example.com/a/b", None),
    ("http://example.com/%7eu/%c3%bc", "http://example.com/~u/%C3%BC", None),
    ("https://example.com:443/x", "https://example.com/x", None),
    ("http://example.com:443/x", "http://example.com:443/x", None),
    ("http://example.com/a?b=2&a=1", "http://example.com/a?b=2&a=1", "http://example.com/a?a=1&b=2"),
    (
        "http://example.com/a?q=2&q=1&p",
        "http://example.com/a?q=2&q=1&p",
        "http://example.com/a?p=&q=2&q=1",
    ),
    ("http://exa mple.com/", None, None),
    ("http://example.com/%zz", None, None),
    ("http://example.com/x#%zz", None, None),
    ("http://example.com/x#a?%zz", None, None),
    ("http://example.com/x?%zz#a", "http://example.com/x?%zz", "http://example.com/x"),
    ("http://example.com/\n", None, None),
    ("http://example.com:x/", None, None),
    (":x", None, None),
    ("1a:b", None, None),
    (None, None, None),
    ("", "", None),
    ("http://h/a b", "http://h/a%20b", None),
    ("http://h/%2e%2e/x%2fy%3f%25", "http://h/x/y%3F%25", None),
    ("http://h/caf%E9", "http://h/caf%E9", None),
    ("http://h/'!*()[]", "http://h/'!*()[]", None),
    ("http://h/..", "http://h", None),
    ("http://h/a/..//b/", "http://h/b", None),
    ("../x", "x", None),
    ("/../x", "x", None),
    ("./", "", None),
    ("a/.", "a", None),
    ("./a:b", "a:b", None),
    ("./1:b", None, None),
    ("a%3Ab", "a:b", None),
    ("mailto:A@Example.com?x=1", "mailto:A@Example.com?x=1", None),
    ("JavaScript:void(0)#x", "javascript:void(0)", None),
    ("mailto:%zz", "mailto:%zz", None),
    ("//Host.Org//p", "//host.org/p", None),
    ("///x//y", "/x/y", None),
    ("file:/x", "file:///x", None),
    ("http://U:P@H.com/x", "http://U:P@h.com/x", None),
    ("http://[2001:DB8::1]:80/x", "http://[2001:db8::1]/x", None),
    ("http://h_x.com/", "http://h_x.com", None),
    ("http://h?x=%20+&y", "http://h?x=%20+&y", "http://h?x=++&y="),
    ("http://h/?a=1;b=2&c=%zz&=3&d=*~", "http://h?a=1;b=2&c=%zz&=3&d=*~", "http://h?=3&d=%2A~"),
    ("http://h/?é=1&e=%e9", "http://h?é=1&e=%e9", "http://h?e=%E9&%C3%A9=1"),
    ("http://h/?%61b=1&a=2", "http://h?%61b=1&a=2", "http://h?a=2&ab=1"),
    ("http://h/?x=a=b", "http://h?x=a=b", "http://h?x=a%3Db"),
]


def test_normal_and_canonical_form(spark):
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(NORMAL)], "i int, u string")
    out = df.select("i", U.normalize_url("u").alias("n"), U.canonicalize_url("u").alias("c"))
    for r in out.collect():
        text, normal, canonical = NORMAL[r.i]
        assert r.n == normal, text
        assert r.c == (canonical if canonical is not None else normal), text


def test_normalising_twice_changes_nothing(spark):
    rng = random.Random(7)
    alphabet = ["http:", "https:", "/", "//", ".", "..", "a", "B", "ü", "%41", "%2F", "%c3", ":80", "?", "&", "=", "#", "@", "h.com", " ", "+"]
    texts = ["http://" + "".join(rng.choices(alphabet, k=rng.randint(1, 9))) for _ in range(2000)]
    once = spark.createDataFrame([(t,) for t in texts], "u string").select(
        "u", U.normalize_url("u").alias("n"), U.canonicalize_url("u").alias("c")
    )
    # A relative text may turn into another kind of URL when read again; absolute ones may not.
    stable = once.filter("n LIKE 'http%://%'").select(
        "u", "n", "c", U.normalize_url("n").alias("n2"), U.canonicalize_url("c").alias("c2")
    )
    rows = stable.collect()
    assert len(rows) > 200
    assert [r for r in rows if r.n2 != r.n or r.c2 != r.c] == []


PIECES = [
    "http://", "https://", "HTTP:", "//", "/", "/", "..", ".", "a", "B", "b.com", "Example.co.uk", "ü",
    "é", "%41", "%2F", "%c3%a9", "%zz", "%", "%2e%2e", ":80", ":443", ":8080", ":", "?", "&", "=", "#",
    "@", "+", " ", ";", "*", "~", "!", "'", "[", "]", "|", "^", '"', "<", "mailto:", "x:", "1", "%20",
    "%2B", "%3d", "a=1", "q=2&a=3", "&&", "\t", "[::1]", "u:p@", "ck", "%E9", "localhost", "-", "_", ",",
]
BASES = ["http://h.com/a/b?x=1", "https://H.com:443/", "http://u@h.com:81/d/", "http://h.com", "file:///x/y"]


@pytest.mark.parametrize("start", ["", "http://h.com/"])
def test_random_texts_against_sql(spark, start, monkeypatch):
    """The SQL of the checks is a second, separate reading of the same rules."""
    rng = random.Random(11)
    texts = [start + "".join(rng.choices(PIECES, k=rng.randint(1, 9))) for _ in range(4000)]
    hosts = {re.sub(":[0-9]*$", "", a.split("@")[-1]) for t in texts for a in re.findall("//([^/?#]*)", t)}
    foreign = [h for h in hosts if re.search("[^\\x00-\\x7f]|%[89A-Fa-f]", h) and "'" not in h]
    monkeypatch.setattr(checks, "_foreign_hosts", lambda: sorted(foreign))
    forms = pd.DataFrame(
        {"n": range(len(texts)), "base": [rng.choice(BASES) for _ in texts], "u": texts}
    )
    got = spark.createDataFrame(forms).select(
        "n",
        U.normalize_url("u").alias("a"),
        U.canonicalize_url("u").alias("b"),
        U.resolve_reference("base", "u").alias("c"),
        url_domain("u").alias("d"),
    )
    got = {r.n: (r.a, r.b, r.c, r.d) for r in got.collect()}
    con = duckdb.connect()
    con.register("forms", forms)
    rows = con.sql(
        f"""WITH {checks._url_steps('b', 'forms', 'base')},{checks._url_steps('r', 'b', 'u')},
        {checks._resolve_step('z', 'r', 'b', 'r')},
        hosts AS (SELECT *, CASE WHEN r_ok THEN list_last(string_split(r_a, '@')) END AS h FROM z),
        {checks._domain_step('dom', 'hosts', 'h')}
        SELECT n, r_normal, r_canonical, link,
          CASE WHEN regexp_full_match(h, '{checks.IPV4}') THEN h ELSE effective END FROM dom"""
    ).fetchall()
    assert [(texts[n], got[n], x) for n, *x in rows if got[n] != tuple(x)] == []


RESOLVED = [
    ("http://example.com/dir/", "b", "http://example.com/b"),
    ("http://example.com/dir/", "/b/", "http://example.com/b"),
    ("http://example.com/dir/", "../x", "http://example.com/x"),
    ("http://example.com/dir/", "/", "http://example.com/dir"),
    ("http://example.com/dir/", "#top", "http://example.com/dir"),
    ("http://example.com/dir/", "", "http://example.com/dir"),
    ("http://example.com/dir/", "?q=1", "http://example.com/dir?q=1"),
    ("http://example.com/dir/", "/?q=1", "http://example.com/dir?q=1"),
    ("http://example.com/dir/", "//other.example.org/p", "http://other.example.org/p"),
    ("http://example.com/dir/", "/für,", "http://example.com/f%C3%BCr,"),
    ("http://example.com/dir/", "https://example.com:443/x", "https://example.com/x"),
    ("http://example.com/dir/", "mailto:a@example.com", "mailto:a@example.com"),
    ("http://example.com/a/b/c", "d", "http://example.com/a/b/d"),
    ("http://example.com", "d", "http://example.com/d"),
    ("http://example.com/p?b=2&a=1", "#x", "http://example.com/p?a=1&b=2"),
    ("mailto:a@b", "?x=1", "mailto:a@b?x=1"),
    ("http://example.com/", "http://exa mple.com", None),
    ("http://exa mple.com/", "x", None),
]


def test_resolve_reference(spark):
    df = spark.createDataFrame(RESOLVED, "base string, ref string, want string")
    for r in df.withColumn("got", U.resolve_reference("base", "ref")).collect():
        assert r.got == r.want, (r.base, r.ref)


@pytest.mark.parametrize(
    ("function", "url", "want"),
    [
        (U.site_root, "http://u:p@example.com:8080/x?y#z", "http://u:p@example.com:8080"),
        (U.site_root, "mailto:a@b", "mailto:"),
        (U.site_root, "/x", ""),
        (U.robots_url, "https://example.com/x?y", "https://example.com/robots.txt"),
        (U.strip_query, "http://example.com/a/?q#f", "http://example.com/a"),
        (U.strip_query, "http://exa mple.com/", None),
        (U.url_host, "HTTP://u@Example.com:8080/", "example.com:8080"),
        (U.url_hostname, "HTTP://u@Example.com:8080/", "example.com"),
        (U.robots_path, "http://example.com", "/"),
        (U.robots_path, "http://example.com/f%c3%bcr?x", "/f%C3%BCr"),
    ],
)
def test_derived(spark, function, url, want):
    df = spark.createDataFrame([(url,)], "u string")
    assert column(df.select(function("u").alias("x")), "x") == [want]


def test_url_parts(spark):
    df = spark.createDataFrame([("HTTPS://u:p@Host.com:81/a?b=c#d",), (None,)], "u string")
    rows = df.select(U.url_parts("u").alias("p")).collect()
    assert tuple(rows[0].p) == (
        "https", "u:p@Host.com:81", "u:p", "Host.com", "81", "/a", "b=c", "d",
    )
    assert rows[1].p is None
