import gzip

import pytest

from webspark.sources.lines import numbered_lines, read_fetch_hints, read_numbered_urls
from webspark.sources.records import CORRUPT, read_numbered_resolutions


@pytest.fixture
def small_parts(spark):
    """Files are read in parts of a few hundred bytes."""
    names = ["spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"]
    before = [spark.conf.get(n) for n in names]
    spark.conf.set(names[0], "300")
    spark.conf.set(names[1], "50")
    yield
    for n, value in zip(names, before):
        spark.conf.set(n, value)


def _write(folder, name, lines, end="\n"):
    (folder / name).write_bytes((end.join(lines) + end).encode())


def test_numbers_follow_the_files_over_many_parts(spark, tmp_path, small_parts):
    files = {
        "b.txt": [f"b{k} " + "x" * (k * 7 % 40) for k in range(300)],
        "a.txt": [f"a{k}" for k in range(77)],
        "c.txt": ["long " + "y" * 2000, "", "é" * 150, "end"],
    }
    for name, lines in files.items():
        _write(tmp_path, name, lines)
    (tmp_path / "d.txt").write_text("no line end")
    (tmp_path / "e.txt").write_text("")
    with gzip.open(tmp_path / "f.txt.gz", "wt") as f:
        f.write("".join(f"z{k}\n" for k in range(50)))
    want = files["a.txt"] + files["b.txt"] + files["c.txt"] + ["no line end"] + [f"z{k}" for k in range(50)]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 10
    rows = numbered_lines(spark, str(tmp_path)).collect()
    assert [r.value for r in sorted(rows)] == want
    assert sorted(r.seq for r in rows) == list(range(len(want)))


def test_parts_hold_several_files(spark, tmp_path):
    for k in range(40):
        _write(tmp_path, f"{k:02}.txt", [f"{k}-{j}" for j in range(k % 5)])
    got = [r.value for r in sorted(numbered_lines(spark, str(tmp_path)).collect())]
    want = [f"{k}-{j}" if k % 5 else "" for k in range(40) for j in range(max(1, k % 5))]
    assert got == want


def test_empty_folder_and_one_line(spark, tmp_path):
    (tmp_path / "a.txt").write_text("")
    assert numbered_lines(spark, str(tmp_path)).count() == 0
    (tmp_path / "b.txt").write_text("x")
    assert numbered_lines(spark, str(tmp_path)).collect() == [(0, "x")]


def test_lists_and_hints_keep_the_numbers_of_their_lines(spark, tmp_path):
    _write(tmp_path, "a.txt", [" http://a.com/ ", "", "http://b.com/\t10.0.0.1", "\t", "http://c.com/\tbad"])
    assert sorted(read_numbered_urls(spark, str(tmp_path)).collect())[0] == (0, "http://a.com/")
    assert sorted(read_fetch_hints(spark, str(tmp_path)).collect()) == [
        (0, "http://a.com/", None),
        (2, "http://b.com/", "10.0.0.1"),
        (4, "http://c.com/", None),
    ]


def test_records_apply_in_the_order_of_their_lines(spark, tmp_path, small_parts):
    from webspark.operators import frontier as fr

    lines = [f'{{"Url":"http://a.com/","IP":"10.0.{k // 200}.{k % 200}","Cname":"","Message":""}}' for k in range(500)]
    _write(tmp_path, "a.txt", [*lines, "broken"])
    judged = read_numbered_resolutions(spark, str(tmp_path))
    assert judged.filter(judged[CORRUPT].isNotNull()).select("seq").collect() == [(500,)]
    known = fr.new_sites(spark.createDataFrame([("http://a.com/",)], "url string"))
    updated, unmatched = fr.import_resolutions(known, judged.filter(judged[CORRUPT].isNull()))
    assert updated.first().ip == "10.0.2.99" and unmatched.count() == 0
