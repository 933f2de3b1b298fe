import random
from datetime import datetime, timedelta

from conftest import column

from webspark.operators.resolution import attach_address, hosts_to_resolve

T0 = datetime(2024, 1, 1)
DNS = "host string, ips array<string>, cname string, observed_at timestamp, error string"


def test_newest_observation(spark):
    dns = spark.createDataFrame(
        [
            ("a.com", ["1.1.1.1", "2.2.2.2"], "c", T0, None),
            ("a.com", ["9.9.9.9"], "", T0 - timedelta(days=1), None),
            ("b.com", None, None, T0, "boom"),
            ("c.com", [], "", T0, None),
        ],
        DNS,
    )
    asked = spark.createDataFrame([(f"http://{h}.com:81/x",) for h in "abcd"], "url string")
    rows = {r.url[7]: (r.ip, r.cname, r.message) for r in attach_address(asked, dns).collect()}
    assert rows == {
        "a": ("1.1.1.1", "c", ""),
        "b": (None, None, "boom"),
        "c": (None, "", "No results"),
        "d": (None, None, None),
    }


def test_ttl_bounds(spark):
    dns = spark.createDataFrame([("a.com", ["1.1.1.1"], "", T0, None)], DNS)
    offsets = [0, 1200, 1201, -1]
    asked = spark.createDataFrame(
        [(i, "http://a.com/", T0 + timedelta(seconds=s)) for i, s in enumerate(offsets)]
        + [(9, "http://bad host/", T0), (10, "http://a.com/", None)],
        "i int, url string, at timestamp",
    )
    got = {r.i: r.ip for r in attach_address(asked, dns, as_of="at").collect()}
    assert got == {0: "1.1.1.1", 1: "1.1.1.1", 2: None, 3: None, 9: None, 10: None}


def test_asof_against_brute_force(spark):
    rng = random.Random(3)
    obs = [
        (
            rng.choice("ab") + ".com",
            [] if rng.random() < 0.1 else [f"10.0.0.{i}"],
            "",
            T0 + timedelta(seconds=i * 97 + rng.randint(0, 90)),
            "err" if rng.random() < 0.3 else None,
        )
        for i in range(150)
    ]
    asked = [
        (i, f"http://{rng.choice('abc')}.com/{i}", T0 + timedelta(seconds=rng.randint(-100, 18000)))
        for i in range(500)
    ]
    got = attach_address(
        spark.createDataFrame(asked, "i int, url string, at timestamp"),
        spark.createDataFrame(obs, DNS),
        as_of="at",
    )
    got = {r.i: (r.ip, r.message) for r in got.collect()}
    for i, url, at in asked:
        serving = [
            o
            for o in obs
            if o[0] == url[7:12] and o[4] is None and timedelta(0) <= at - o[3] <= timedelta(minutes=20)
        ]
        good = [o for o in serving if o[1]]
        if good:
            assert got[i] == (max(good, key=lambda o: o[3])[1][0], "")
        else:
            assert got[i] == (None, "No results" if serving else None)


def test_hosts_to_resolve(spark):
    dns = spark.createDataFrame(
        [
            ("fresh.com", ["1.1.1.1"], "", T0, None),
            ("old.com", ["1.1.1.1"], "", T0 - timedelta(seconds=1201), None),
            ("edge.com", ["1.1.1.1"], "", T0 - timedelta(seconds=1200), None),
            ("failed.com", None, "", T0, "x"),
            ("empty.com", [], "", T0, None),
        ],
        DNS,
    )
    names = ["fresh", "old", "edge", "failed", "empty", "new", "new"]
    asked = spark.createDataFrame([(f"http://{n}.com/",) for n in names] + [("mailto:x",)], "url string")
    assert sorted(column(hosts_to_resolve(asked, dns, T0), "host")) == [
        "empty.com",
        "failed.com",
        "new.com",
        "old.com",
    ]
