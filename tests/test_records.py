import json
from datetime import datetime

from conftest import column
from pyspark.sql import functions as F

from webspark.operators import fetched
from webspark.sources import lines, records


def test_url_lists(spark, tmp_path):
    source = tmp_path / "urls.txt"
    source.write_bytes(b" http://a.com \r\n\n\t\nhttp://b.com\thint\nhttp://c.com")
    urls = lines.read_url_list(spark, str(source))
    assert column(urls, "url") == ["http://a.com", "http://b.com\thint", "http://c.com"]
    lines.write_url_list(urls, str(tmp_path / "out"))
    again = lines.read_url_list(spark, str(tmp_path / "out"))
    assert sorted(column(again, "url")) == sorted(column(urls, "url"))


def test_fetch_hints(spark):
    values = ["u", "u\t10.0.0.1", "u\tbad", "u\t10.0.0.1\tz", "u\t::1", "u\t1.2.3.256", "u\t2001:db8::1:2"]
    df = spark.createDataFrame([(v,) for v in values], "value string")
    assert [(r.url, r.ip) for r in lines.parse_fetch_hints(df).collect()] == [
        ("u", None),
        ("u", "10.0.0.1"),
        ("u", None),
        ("u\t10.0.0.1\tz", None),
        ("u", "::1"),
        ("u", None),
        ("u", "2001:db8::1:2"),
    ]


def test_page_records(spark, tmp_path):
    good = {
        "Data": {
            "Url": "http://a.com",
            "Body": "<p>é",
            "Timestamp": "2017-03-01 10:11:12.123456789 -0500 EST m=+0.001",
            "Status": "404 Not Found",
            "StatusCode": 404,
            "Proto": "HTTP/1.1",
            "Header": {"Server": ["x", "y"]},
            "Trailer": None,
        },
        "Success": True,
        "Message": "",
        "Links": None,
    }
    source = tmp_path / "pages.json"
    source.write_text(json.dumps(good) + '\n{"Data": {\n\n{"Success": true}\nnothing\n')
    ok, bad = records.read_page_records(spark, str(source))
    row = ok.select("*", records.record_time("Data.Timestamp").alias("at")).first()
    assert ok.count() == 1 and bad.count() == 3
    assert row.Data.Header == {"Server": ["x", "y"]} and row.Data.StatusCode == 404
    assert row["at"] == datetime(2017, 3, 1, 15, 11, 12, 123456)
    records.write_records(ok, str(tmp_path / "out"))
    written = [json.loads(r.value) for r in spark.read.text(str(tmp_path / "out")).collect()]
    assert written == [good]


def test_record_times(spark):
    texts = ["2017-03-01 10:11:12 +0000 UTC", "2017-03-01 10:11:12.5 +0130 X", "", "junk", "2017"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    assert column(df.select(records.record_time("t").alias("x")), "x") == [
        datetime(2017, 3, 1, 10, 11, 12),
        datetime(2017, 3, 1, 8, 41, 12, 500000),
        None,
        None,
        None,
    ]


def test_resolutions(spark, tmp_path):
    source = tmp_path / "ips.json"
    source.write_text(
        '{"Url":"http://a.com","IP":"","Cname":"","Message":"no"}\n[1]\n'
        '{"Url":"http://b.com","IP":"1.2.3.4","Cname":"c","Message":""}\n'
    )
    ok, bad = records.read_resolutions(spark, str(source))
    assert [tuple(r) for r in ok.collect()] == [
        ("http://a.com", None, "", "no"),
        ("http://b.com", "1.2.3.4", "c", ""),
    ]
    assert column(bad, "line") == ["[1]"]


def test_made_records(spark):
    df = spark.createDataFrame([("u", "body")], "url string, html string")
    made = fetched.to_page_records(df, F.lit("2024-01-01 00:00:00 +0000 UTC")).first()
    assert (made.Data.Body, made.Data.StatusCode, made.Success, made.Message) == ("body", 200, True, "")
    failed = fetched.failed_records(df, "timeout").first()
    assert (failed.Data.Body, failed.Data.StatusCode, failed.Data.Header) == ("", -1, None)
    assert (failed.Success, failed.Message) == (False, "failed: timeout")


def test_body_limit(spark):
    df = spark.createDataFrame([("aé€😀",)], "html string")
    whole = "aé€😀".encode()
    for n in range(-1, len(whole) + 2):
        got = fetched.limit_body(df, n).first().html
        want = whole if n <= 0 else whole[:n]
        marks = 0
        while True:
            try:
                text = want[: len(want) - marks].decode()
                break
            except UnicodeDecodeError:
                marks += 1
        assert got == text + "�" * marks, n


def test_bad_lines_come_out_as_they_were(spark, tmp_path):
    bad = [
        '{"Data":{"Url":"u"},"Success":true} trailing',
        '{"Data":{"Url":"u"}}{"Data":{"Url":"v"}}',
        '{"Data":{"Url":"u"}}, {"Data":{"Url":"v"}}',
        '  {"Success":true,"foo":1}',
        '{"Data":{"Url":"u"},"Success":"maybe"}',
        "{'Data':{'Url':'u'}}",
        "[]",
    ]
    source = tmp_path / "mixed.json"
    source.write_text("\n".join([*bad, ' {"Data":{"Url":"ok"},"Success":true} ']))
    ok, rest = records.read_page_records(spark, str(source))
    assert [r.Data.Url for r in ok.collect()] == ["ok"]
    assert sorted(column(rest, "line")) == sorted(bad)
