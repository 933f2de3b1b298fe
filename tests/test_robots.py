from conftest import column

from webspark.functions.urls import robots_path
from webspark.operators import robots

CASES = [
    ("User-agent: *\nDisallow: /en/\nAllow: /en/4", "/en/45", True),
    ("User-agent: *\nDisallow: /en/\nAllow: /en/4", "/en/5", False),
    ("User-agent: smith\nDisallow: /\n\nUser-agent: *\nDisallow:", "/x", False),
    ("User-agent: smith\nDisallow:\n\nUser-agent: *\nDisallow: /", "/x", True),
    ("User-agent: *\nDisallow: /*.html$", "/a.html", False),
    ("User-agent: *\nDisallow: /*.html$", "/a.html2", True),
    ("User-agent: *\nDisallow: /a\nAllow: /a", "/a", True),
    ("User-agent: *\nDisallow: /a\nUser-agent: *\nDisallow: /b", "/b", False),
    ("User-agent: a\nUser-agent: SMI # me\nSitemap: x\nDisallow : /c\r\n", "/c/d", False),
    ("User-agent: other\nDisallow: /", "/x", True),
    ("User-agent: *\nDisallow: /f%c3%bcr", "/für", False),
    ("User-agent: *\nDisallow: /a?b", "/a", True),
    ("User-agent: *\nDisallow: /", "", False),
    ("User-agent: *\nDisallow: /x.y+z", "/xay+z", True),
    ("User-agent: *\nDisallow: /a*b*c", "/a1b2c3", False),
    ("User-agent: *\nDisallow: /a*b*b$", "/a1b2b", False),
    ("User-agent: *\nDisallow: /a*b*b$", "/a1b", True),
    ("User-agent: *\nDisallow: /a*$", "/abc", False),
    ("User-agent: *\nDisallow: *c", "/abc", False),
    ("User-agent: *\nDisallow: /**x", "/abx", False),
    ("User-agent: *\nDisallow: /a$", "/a", False),
    ("User-agent: *\nDisallow: /a$", "/ab", True),
    ("User-agent: *\nDisallow: /\\Q.*$", "/xyz", True),
    ("<html>no rules</html>", "/x", True),
    ("", "/x", True),
    (None, "/x", False),
]


def test_verdicts(spark):
    bodies = spark.createDataFrame(
        [(f"http://h{i}.com", c[0]) for i, c in enumerate(CASES)], "site string, body string"
    )
    asked = spark.createDataFrame(
        [(f"http://h{i}.com{c[1]}", c[2]) for i, c in enumerate(CASES)]
        + [("http://absent.com/x", True)],
        "url string, want boolean",
    )
    rules = robots.parse_robots(bodies)
    got = {r.url: r.allowed for r in robots.robots_allowed(asked, rules).collect()}
    for r in asked.collect():
        assert got[r.url] == r.want, (r.url, CASES)
    passed, blocked = robots.apply_robots(asked, rules)
    assert sorted(column(passed, "url")) == sorted(r.url for r in asked.collect() if r.want)
    assert set(column(blocked, "Message")) == {"failed: Blocked by robots"}
    everything, nothing = robots.apply_robots(asked, rules, ignore=True)
    assert everything.count() == asked.count() and nothing.count() == 0


def test_rules_table(spark):
    body = "user-agent: A\nuser-agent: b\nallow: /x\ndisallow: /y # z\n\nuser-agent: c\ndisallow:\n"
    rules = robots.parse_robots(spark.createDataFrame([("s", body)], "site string, body string"))
    assert sorted((r.agent, r.pattern, r.allow) for r in rules.collect()) == [
        ("a", "/x", True),
        ("a", "/y", False),
        ("b", "/x", True),
        ("b", "/y", False),
        ("c", "", True),
    ]


def test_long_file(spark):
    body = "".join(f"user-agent: x{i}\n" for i in range(20000)) + "disallow: /\n" * 20000
    bodies = spark.createDataFrame([("http://h.com", body + "user-agent: *\ndisallow: /q")], "site string, body string")
    rules = robots.parse_robots(bodies).filter("agent = '*'")
    assert [tuple(r) for r in rules.collect()] == [("http://h.com", "*", "/q", False)]


def test_many_stars_take_one_walk(spark):
    import time

    rules = [("http://h.com", "*", "/" + "a*" * 50 + "z$", False), ("http://g.com", "*", "/" + "*a" * 50, False)]
    table = spark.createDataFrame(rules, "site string, agent string, pattern string, allow boolean")
    urls = spark.createDataFrame([("http://h.com/" + "a" * 2000,), ("http://g.com/" + "a" * 2000,)], "url string")
    asked = robots.robots_allowed(urls, table)
    asked.collect()
    start = time.perf_counter()
    assert {r.url[7]: r.allowed for r in asked.collect()} == {"h": True, "g": False}
    assert time.perf_counter() - start < 5


def test_verdicts_against_every_rule_in_turn(spark):
    """The index gives what a walk over all rules of a site gives, signs outside ASCII and ties included."""
    import random
    import re

    rng = random.Random(5)
    bits = ["/", "a", "b", "ab", "é", "𝄞", "*", "$"]
    sites = {}
    for i in range(60):
        rules = {
            ("/" + "".join(rng.choices(bits[:6] * 4 + bits[6:], k=rng.randint(0, 5))), rng.random() < 0.5)
            for _ in range(rng.randint(1, 40))
        }
        lines = [f"{'allow' if allow else 'disallow'}: {p}" for p, allow in rules]
        sites[f"http://h{i}.com"] = "\n".join(["user-agent: *", *lines])
    paths = ["/" + "".join(rng.choices(bits[:6], k=rng.randint(0, 7))) for _ in range(60)]
    asked = spark.createDataFrame([(s, s + p) for s in sites for p in set(paths)], "s string, url string")

    def fits(pattern, path):
        body = pattern[:-1] if pattern.endswith("$") else pattern
        there = ".*".join(map(re.escape, body.split("*")))
        return re.match(there + (r"\Z" if pattern.endswith("$") else ""), path, re.S) is not None

    rules = robots.parse_robots(spark.createDataFrame(list(sites.items()), "site string, body string")).cache()
    judged = robots.with_robots_verdict(asked, rules).withColumn("path", robots_path("url")).collect()
    known = {}
    for r in rules.collect():
        known.setdefault(r.site, []).append((r.pattern, r.allow))
    assert len(judged) == len(set(paths)) * len(sites)
    for r in judged:
        best = max(((len(p), allow) for p, allow in known[r.s] if fits(p, r.path)), default=(0, True))
        assert r.allowed == best[1], (known[r.s], r.path)


def test_many_rules_cost_a_search(spark):
    """50,000 rules of one site: requests are looked up, not compared with each of them."""
    import time

    rules = spark.range(50_000).selectExpr(
        "'http://h.com' AS site", "'*' AS agent", "concat('/d', id, '/') AS pattern", "id % 2 = 0 AS allow"
    )
    asked = spark.range(20_000).selectExpr("id", "concat('http://h.com/d', id * 3, '/x') AS url")
    judged = robots.with_robots_verdict(asked, rules)
    start = time.perf_counter()
    got = {r.id: r.allowed for r in judged.collect()}
    assert time.perf_counter() - start < 60  # a walk over all rules makes a billion tests
    assert got == {i: i * 3 >= 50_000 or i % 2 == 0 for i in range(20_000)}
