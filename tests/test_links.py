import random
from html.parser import HTMLParser

from conftest import column

from webspark.functions.domains import SuffixRules, has_domain, load_suffix_rules, registered_domain
from webspark.functions.html import anchor_hrefs, decode_entities
from webspark.operators import links
from webspark.operators.fetched import to_page_records

MARKUP = [
    ("""<a href='/1'>x</a><A HREF=/2>y<a data-href="/n"><abbr href="/n"><a title="x>y" href="/3">""", ["/1", "/2", "/3"]),
    ("""<!-- <a href="/n"> --><script>var a='<a href="/n">';</script><style><a href=/n></style><a href="/4">""", ["/4"]),
    ("""<a href><a href=""><a href=>x<a class="b"href="/5"/><a href="/6" href="/n">""", ["", "", "", "/5", "/6"]),
    ("""<a title=it's href=/9><a href = "/10" ><a\nhref="/11"><?php <a href="/n"?><a href="/13">""", ["/9", "/10", "/11", "/13"]),
    ("<title><a href=/n></title><textarea><a href=/n></textarea><a/href=/14><a href=/15/>", ["/14", "/15/"]),
    ("<!--><a href=/17><!-- x --!><a href=/18><!DOCTYPE x><a href=/19>", ["/17", "/18", "/19"]),
    ("""<a href="/n" title="never closed""", []),
    ("<a href=/n", []),
    ("<script><a href=/n>", []),
    ("<scripts></scripts><a href=/20></a foo><aside href=/n><plaintext><a href=/n>", ["/20"]),
    ("<a x='<script>' href=/21>", ["/21"]),
    ("", []),
    (None, None),
]


def test_anchor_markup(spark):
    df = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MARKUP)], "i int, h string")
    for r in df.select("i", anchor_hrefs("h").alias("found")).collect():
        assert r.found == MARKUP[r.i][1], MARKUP[r.i][0]


def test_long_tags_do_not_overflow(spark):
    attributes = " ".join(f'data-{i}="{i}"' for i in range(20000))
    html = f"<a {attributes} href='/end'>" + "<!-- " + "x" * 500_000 + "--><a href=/last>"
    df = spark.createDataFrame([(html,)], "h string")
    assert column(df.select(anchor_hrefs("h").alias("x")), "x") == [["/end", "/last"]]


ENTITIES = [
    ("/x?a=1&amp;b=2", "/x?a=1&b=2"),
    ("?a=1&copy=2&copy", "?a=1&copy=2©"),
    ("&eacute;&#8364;&#x1F600;&#128;&quot;&#39;", "é€😀€\"'"),
    ("&notit;&notin;&nosuch;", "&notit;∉&nosuch;"),
    ("&#0;&#xD800;&#99999999999999999999;&#;", "���&#;"),
    ("&#xFFFFFFFFFFFFFFFFFFFFFFFF;&#x0000000000000041;&#x110000;", "\ufffdA\ufffd"),
    ("a&b&&", "a&b&&"),
    ("&ngE;", "≧̸"),
]


def test_entities(spark):
    df = spark.createDataFrame(ENTITIES, "t string, want string")
    for r in df.withColumn("got", decode_entities("t")).collect():
        assert r.got == r.want, r.t


class _Anchors(HTMLParser):
    CDATA_CONTENT_ELEMENTS = ("script", "style", "title", "textarea")

    def __init__(self):
        super().__init__()
        self.found = []

    def handle_starttag(self, tag, attrs):
        values = [v for k, v in attrs if k == "href"]
        if tag == "a" and values:
            self.found.append(values[0] or "")


def test_anchors_agree_with_a_parser(pages):
    for r in pages.select("html", anchor_hrefs("html").alias("found")).collect():
        parser = _Anchors()
        parser.feed(r.html)
        assert r.found == parser.found


FRAGMENTS = [
    '<a href="x">', "<a href='y'>", "<a href=z>", "text & more", "<!-- c <a href=n> -->",
    '<p title="a>b">', "</a>", "<script>if(a<b){'<a href=n>'}</script>", '<A HREF = "q" >',
    "<a\nclass=x href=w>", "<br/>", "<a title='\"' href=\"v\">", "<style>a{}</style>",
    "<a data-href=n x=1>", "< a href=n>", "<a/href=u>", "<div a='<a href=n>'>", "&lt;a href=n&gt;",
    '<a href="a&amp;b&#233;">', "<img src=x onerror='a>b'><a href=t>", "<abbr href=n>", "<a href>",
    '<a href="" href=n>', "\n\t", "é<a href=é>", '<a class="k"href="s">', '<b <a href="r">',
    "<a href=p/>", "<a x=y/ href=o>",
]


def test_anchors_of_random_markup_agree_with_a_parser(spark):
    rng = random.Random(5)
    texts = ["".join(rng.choices(FRAGMENTS, k=rng.randint(1, 12))) for _ in range(2000)]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, h string")
    for r in df.select("i", anchor_hrefs("h").alias("found")).collect():
        parser = _Anchors()
        parser.feed(texts[r.i])
        parser.close()
        assert r.found == parser.found, texts[r.i]


RULES = SuffixRules.parse(["// list", "com", "co.uk", "*.ck", "!www.ck", ""])
DOMAINS = [
    ("a.b.example.co.uk", "example.co.uk", True),
    ("example.com", "example.com", True),
    ("com", "", False),
    ("localhost", "", False),
    ("192.0.2.1", "192.0.2.1", True),
    ("::1", "::1", False),
    ("a.b.ck", "a.b.ck", True),
    ("b.ck", "", False),
    ("www.ck", "www.ck", True),
    ("a.www.ck", "www.ck", True),
    ("x.y.zz", "y.zz", True),
    ("example.com:8080", "example.com:8080", True),
    ("a..b", "", False),
    ("x.com.", "", False),
    ("", "", False),
]


def test_domains(spark):
    df = spark.createDataFrame(DOMAINS, "h string, want string, has boolean")
    out = df.withColumn("got", registered_domain("h", RULES)).withColumn("g", has_domain("h", RULES))
    for r in out.collect():
        assert (r.got, r.g) == (r.want, r.has), r.h


def test_suffix_list_file(spark, tmp_path):
    (tmp_path / "list.dat").write_text("// comment\ncom\n*.ck\n!www.ck\n\nco.uk // x\n")
    assert load_suffix_rules(spark, str(tmp_path / "list.dat")) == RULES


LINKS = [
    ("b", "http://example.com/b", None),
    ("/x?a=1&amp;b=2", "http://example.com/x?a=1&b=2", None),
    ("http://example.com:8080/x", "http://example.com:8080/x", "port"),
    ("http://example.com:/x", "http://example.com:/x", "port"),
    ("http://localhost/x", "http://localhost/x", "empty_host"),
    ("http://localhost:81/x", "http://localhost:81/x", "empty_host"),
    ("mailto:a@example.com", "mailto:a@example.com", "scheme"),
    ("javascript:void(0)", "javascript:void(0)", "scheme"),
    ("http://u:p@example.org/x", "http://u:p@example.org/x", None),
    ("http://exa mple.com", None, None),
    ("/b/", "http://example.com/b", None),
]


def _page(spark):
    html = "".join(f'<p><a href="{x[0]}">x</a>' for x in LINKS)
    return spark.createDataFrame(
        [("http://example.com/dir/", html), ("http://bad host/", html), ("http://e.com/", None)],
        "url string, html string",
    )


def test_links_of_a_page(spark):
    page = _page(spark)
    all_links = [x[1] for x in LINKS if x[1]]
    assert column(links.resolve_links(page), "link") == all_links
    assert column(links.dedup_links(page), "link") == list(dict.fromkeys(all_links))
    kept = list(dict.fromkeys(x[1] for x in LINKS if x[1] and x[2] is None))
    assert column(links.extract_links(page), "link") == kept
    assert column(links.extract_links(page, root=True), "link") == [
        "http://example.com",
        "http://u:p@example.org",
    ]
    assert column(links.pages_with_links(page), "links") == [kept, [], None]
    stats = {r.url: (r.links, r.removed) for r in links.dedup_stats(page).collect()}
    assert stats["http://example.com/dir/"] == (len(all_links), 1)
    assert stats["http://bad host/"] == (0, 0)


def test_links_of_page_records(spark):
    page = _page(spark)
    records = to_page_records(page, "url")
    got = links.extract_links(records, "Data.Url", "Data.Body")
    assert got.columns == ["url", "link"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, links.extract_links(page).collect()))


def test_reject_reasons(spark):
    df = spark.createDataFrame([x[1:] for x in LINKS if x[1]], "link string, want string")
    for r in df.withColumn("got", links.link_reject_reason("link")).collect():
        assert r.got == r.want, r.link
    assert links.filter_links(df).count() == len([x for x in LINKS if x[1] and x[2] is None])


def test_extract_does_not_depend_on_partitions(pages):
    one = sorted(map(tuple, links.extract_links(pages.coalesce(1)).collect()))
    many = sorted(map(tuple, links.extract_links(pages.repartition(7)).collect()))
    assert one == many and one
