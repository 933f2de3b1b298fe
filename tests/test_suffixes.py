import pytest
from conftest import column
from pyspark.sql import functions as F

from webspark.functions.domains import SuffixRules, registered_domain
from webspark.operators import links, suffixes

# A part of the published list, with comments and both sections.
LIST = """// ===BEGIN ICANN DOMAINS===
com
biz
// a comment
jp
ac.jp
kyoto.jp
ide.kyoto.jp
*.kobe.jp
!city.kobe.jp
*.ck
!www.ck
us
ak.us   trailing text is no part of a rule
k12.ak.us
cn
com.cn
公司.cn
中国
// ===END ICANN DOMAINS===
// ===BEGIN PRIVATE DOMAINS===
uk.com
github.io
*.compute.example.com

com
// ===END PRIVATE DOMAINS===
"""
# Cases of the published list's own tests; an empty domain is none.
CASES = """
com -> | example.com -> example.com | b.example.com -> example.com | a.b.example.com -> example.com
uk.com -> | example.uk.com -> example.uk.com | a.b.example.uk.com -> example.uk.com | test.ac -> test.ac
biz -> | domain.biz -> domain.biz | a.b.domain.biz -> domain.biz | ck -> | test.ck -> | b.test.ck -> b.test.ck
a.b.test.ck -> b.test.ck | www.ck -> www.ck | www.www.ck -> www.ck | jp -> | test.jp -> test.jp | ac.jp ->
test.ac.jp -> test.ac.jp | www.test.ac.jp -> test.ac.jp | kyoto.jp -> | test.kyoto.jp -> test.kyoto.jp
ide.kyoto.jp -> | b.ide.kyoto.jp -> b.ide.kyoto.jp | a.b.ide.kyoto.jp -> b.ide.kyoto.jp | c.kobe.jp ->
b.c.kobe.jp -> b.c.kobe.jp | a.b.c.kobe.jp -> b.c.kobe.jp | city.kobe.jp -> city.kobe.jp
www.city.kobe.jp -> city.kobe.jp | us -> | test.us -> test.us | ak.us -> | test.ak.us -> test.ak.us
k12.ak.us -> | test.k12.ak.us -> test.k12.ak.us | www.test.k12.ak.us -> test.k12.ak.us
食狮.com.cn -> 食狮.com.cn | 食狮.公司.cn -> 食狮.公司.cn | www.食狮.公司.cn -> 食狮.公司.cn
shishi.公司.cn -> shishi.公司.cn | 公司.cn -> | 食狮.中国 -> 食狮.中国 | 中国 ->
xn--85x722f.xn--55qx5d.cn -> xn--85x722f.xn--55qx5d.cn | www.xn--85x722f.xn--55qx5d.cn -> xn--85x722f.xn--55qx5d.cn
xn--55qx5d.cn -> | xn--85x722f.xn--fiqs8s -> xn--85x722f.xn--fiqs8s | xn--fiqs8s ->
example -> | example.example -> example.example | .com -> | a..com -> | com. ->
a.b.compute.example.com -> a.b.compute.example.com | b.compute.example.com -> | me.github.io -> me.github.io
"""
WANT = dict(tuple(x.strip() for x in case.split("->")) for case in CASES.strip().replace("\n", "|").split("|"))


@pytest.fixture(scope="module")
def rules(spark, tmp_path_factory):
    file = tmp_path_factory.mktemp("list") / "list.dat"
    file.write_text(LIST)
    return suffixes.load_suffix_table(spark, str(file)), str(file)


def _hosts(spark, hosts):
    return spark.createDataFrame([(h,) for h in hosts], "host string")


def test_cases_of_the_list(spark, rules):
    found = suffixes.host_domains(_hosts(spark, [*WANT, *WANT, None]), rules[0])
    assert {r.host: r.domain for r in found.collect()} == WANT and found.count() == len(WANT)


def test_equal_to_the_rules_as_literals(spark):
    # Without rules outside ASCII, which the literals know in the form they are written in.
    lines = [x for x in LIST.splitlines() if x.isascii()]
    table = suffixes.suffix_rules(spark.createDataFrame(list(enumerate(lines)), "seq int, value string"))
    literal = SuffixRules.parse(lines)
    hosts = _hosts(spark, [*WANT, "10.0.0.1", "[::1]", "a.com:80", "", None, "A.Com", "x" * 300 + ".com", "a." * 3000 + "ck"])
    rows = hosts.withColumn("domain", F.lit("taken")).withColumn("literal", registered_domain("host", literal))
    found = suffixes.attach_domain(rows, table)
    assert found.columns == ["host", "literal", "domain"] and found.count() == rows.count()
    assert found.filter("NOT (domain <=> literal)").collect() == []


def test_sections(spark, rules):
    hosts = _hosts(spark, ["a.uk.com", "a.com", "a.zz", "me.github.io"])

    def told(**options):
        return {r.host: (r.suffix, r.section, r.domain) for r in suffixes.host_domains(hosts, rules[0], **options).collect()}

    assert told() == {
        "a.uk.com": ("uk.com", "private", "a.uk.com"),
        "a.com": ("com", "icann", "a.com"),
        "a.zz": ("zz", None, "a.zz"),
        "me.github.io": ("github.io", "private", "me.github.io"),
    }
    assert told(sections=["icann"])["me.github.io"] == ("io", None, "github.io")


def test_long_lists_are_refused_and_empty_ones_taken(spark, rules, tmp_path):
    with pytest.raises(ValueError):
        suffixes.load_suffix_table(spark, rules[1], most=5)
    (tmp_path / "none.dat").write_text("")
    none = suffixes.load_suffix_table(spark, str(tmp_path))
    assert suffixes.host_domains(_hosts(spark, ["a.b.c"]), none).first().domain == "b.c"
    assert suffixes.host_domains(_hosts(spark, []), none).count() == 0


def _plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_the_plan_does_not_grow_with_the_list(spark, rules, tmp_path):
    (tmp_path / "long.dat").write_text(LIST + "".join(f"s{k}.example\n*.w{k}.example\n" for k in range(5_000)))
    long = suffixes.load_suffix_table(spark, str(tmp_path))
    hosts = _hosts(spark, ["a.s4999.example", "a.b.w7.example", "a.com"] * 50)
    found = suffixes.attach_domain(hosts, long)
    short = suffixes.attach_domain(hosts, rules[0])
    assert abs(len(_plan(found)) - len(_plan(short))) < 100 + 0.05 * len(_plan(short))
    assert set(column(found, "domain")) == {"a.s4999.example", "a.b.w7.example", "a.com"} and found.count() == 150


def test_filter_links(spark, rules):
    urls = ["http://a.com/", "http://com/", "http://uk.com/x", "http://a.com:81/", "ftp://a.com/", "https://b.a.ck/", None]
    rows = spark.createDataFrame([(u, k) for k, u in enumerate(urls)], "link string, k int")
    kept = suffixes.filter_links(rows, rules[0])
    literal = links.filter_links(rows.filter("link IS NOT NULL"), rules=SuffixRules.parse(LIST.splitlines()))
    assert sorted(kept.collect()) == sorted(literal.collect()) and kept.count() == 2
