"""Inputs of the registered queries, all derived from the ``pages`` table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from webspark.functions.domains import BUILT_IN_RULES
from webspark.operators.fetched import failed_records, to_page_records
from webspark.operators.frontier import new_sites, site_id
from webspark.operators.links import extract_links
from webspark.sources.shared import fresh_path

PAGES_SCHEMA = "page_id BIGINT, url STRING, html STRING"
START = "2024-01-01 00:00:00"
STAMP = "2024-01-01 00:00:00 +0000 UTC"

# URL texts of every kind made from a page's own URL: {scheme}, {host}, {path} are its parts and
# {id} its number. Spark and the SQL check build them from this one list.
URL_FORMS = [
    "{scheme}://{host}{path}",
    "HTTP://{HOST}:80{path}/?#top",
    "https://{host}:443/a/./b/../c{path}",
    "{scheme}://Us:Pw@{host}:8080//x///y{path}/?b=2&a=1&b=1&c",
    "http://{host}/%7eu/%c3%bc/%2e%2e/z%2F{id}?q=%e9*&p=x+y%20z",
    "http://{host}/ü b/{id}?q=ä b&;z=1&%zz=1&&=v&k=a=b&A=1&é=2",
    "http://exa mple.com/{id}",
    "http://{host}/%zz{path}",
    "http://{host}/{id}#%zz",
    "mailto:User{id}@example.com?subject=a b",
    "javascript:void({id})",
    "../up/./{id}/",
    "{id}.html",
    "./x:y/{id}",
    "{id}:y",
    "?page={id}&a=1",
    "#top{id}",
    "",
    "/",
    "//cdn.example.co.uk/{id}//",
    "http://localhost/{id}",
    "http://10.0.0.{ip}/{id}",
    "http://a.b.ck/{id}",
    "http://www.ck:81/{id}",
    "http://co.uk/{id}",
    "ftp://{host}/{id}",
    "http://{host}./{id}",
    "http://{host}:/{id}",
    "http://BÜCHER.example/{id}",
    "https://ｂｕ\u0308cher.example:8080/{id}/",
    "http://xn--bcher-kva.example:80/{id}?q=1",
    "https://Us@b%C3%BCcher.Example:443/{id}",
    "//例え。テスト/{id}/../x",
]


# Rules beside the built-in ones, in a section of their own, as a list file has them.
PRIVATE_RULES = ["example.net", "*.example.org", "!www.example.org", "bücher.example", "テスト"]


def suffix_list(spark: SparkSession) -> str:
    """Path of a list file of the built-in and the private rules."""
    path = fresh_path(spark, "suffix-list")
    text = ["// ===BEGIN ICANN DOMAINS===", *BUILT_IN_RULES.split(), "// ===BEGIN PRIVATE DOMAINS===", *PRIVATE_RULES]
    spark.createDataFrame([("\n".join(text),)], "value string").write.text(path)
    return path


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pages table."""
    return spark.read.schema(PAGES_SCHEMA).parquet(f"{sf_dir}/pages.parquet")


def page_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url); the scan reads these two columns only."""
    return spark.read.schema(PAGES_SCHEMA).parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")


def _form(template: str) -> str:
    """SQL text that fills a template; ``||`` reads the same in Spark and in the check."""
    parts = {
        "{scheme}": "scheme",
        "{host}": "host",
        "{HOST}": "upper(host)",
        "{path}": "path",
        "{id}": "cast(page_id AS varchar(20))",
        "{ip}": "cast(page_id % 256 AS varchar(20))",
    }
    out, rest = [], template
    while rest:
        at = min((rest.find(k) for k in parts if k in rest), default=-1)
        if at == 0:
            key = next(k for k in parts if rest.startswith(k))
            out.append(parts[key])
            rest = rest[len(key) :]
        else:
            text = rest if at < 0 else rest[:at]
            out.append("'" + text + "'")
            rest = rest[len(text) :]
    return " || ".join(out) or "''"


def forms_sql() -> list[str]:
    return [_form(t) for t in URL_FORMS]


def url_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, base, form, u): every page's URL with every form of :data:`URL_FORMS`."""
    parts = page_urls(spark, sf_dir).selectExpr(
        "page_id",
        "url AS base",
        "substring_index(url, ':', 1) AS scheme",
        "regexp_extract(url, '//([^/?#]*)', 1) AS host",
        "regexp_extract(url, '//[^/?#]*([^?#]*)', 1) AS path",
    )
    forms = ", ".join(forms_sql())
    return parts.selectExpr("page_id", "base", f"posexplode(array({forms})) AS (form, u)")


# Columns of a request, from page_id and url. A request goes out 11 to 27 minutes after its host was
# observed for the page.
REQUEST_COLUMNS = [
    "page_id",
    "url",
    "if(page_id % 11 = 0, NULL, '10.0.0.' || cast(page_id % 7 AS string)) AS ip",
    f"timestamp'{START}' + make_dt_interval(0, 0, page_id * 2 + 11 + page_id % 17) AS asked_at",
]
HOST = "regexp_extract(url, '//([^/?#]*)', 1)"
# Columns of an observation: some fail, some answers are empty.
DNS_COLUMNS = [
    f"{HOST} AS host",
    "CASE WHEN page_id % 9 = 0 THEN NULL WHEN page_id % 15 = 0 THEN cast(array() AS array<string>) "
    "ELSE array('10.1.0.' || cast(page_id % 250 AS string), '10.2.0.1') END AS ips",
    f"if(page_id % 2 = 0, 'c.' || {HOST}, '') AS cname",
    f"timestamp'{START}' + make_dt_interval(0, 0, page_id * 2) AS observed_at",
    "if(page_id % 9 = 0, 'no such host', NULL) AS error",
]


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(page_id, url, ip, asked_at): one request per page."""
    return page_urls(spark, sf_dir).selectExpr(*REQUEST_COLUMNS)


def dns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations ``(host, ips, cname, observed_at, error)``: one per page, of its host."""
    return page_urls(spark, sf_dir).selectExpr(*DNS_COLUMNS)


def robots_bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(site, body): a robots file for every site. Those on example.net are open to all, or could not be
    read."""
    body = (
        "User-Agent: *\\r\\nDisallow: /en/ # no\\nAllow: /en/4\\nDisallow: /*/4*7$\\n\\n"
        "Sitemap: /s.xml\\nUser-agent: Other\\nDisallow: /\\n"
    )
    return (
        page_urls(spark, sf_dir)
        .select(F.expr("regexp_extract(url, '^([a-z]+://[^/?#]*)', 1)").alias("site"))
        .distinct()
        .withColumn(
            "body",
            F.expr(
                f"CASE WHEN NOT endswith(site, 'example.net') THEN '{body}' "
                "WHEN startswith(site, 'https') THEN 'User-agent: *\\nDisallow:' END"
            ),
        )
    )


def frontier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Known URLs: the https pages, of which those in English are visited. The one input that is a part
    of the pages, so that every operation has URLs it knows and URLs that are new."""
    known = page_urls(spark, sf_dir).filter("startswith(url, 'https:')").select("url").distinct()
    return new_sites(known, "url", START).withColumn("visited", F.contains("url", F.lit("/en/")))


def import_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(url): all extracted links and all page URLs."""
    found = extract_links(pages(spark, sf_dir)).select(F.col("link").alias("url"))
    return found.unionByName(page_urls(spark, sf_dir).select("url"))


def page_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Data, Success, Message, Links): a record per page, every fifth one failed."""
    table = pages(spark, sf_dir)
    good = to_page_records(table.filter("page_id % 5 != 0"), F.lit(STAMP))
    bad = failed_records(table.filter("page_id % 5 = 0"), "timeout", F.lit(STAMP))
    return good.unionByName(bad)


def numbered_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(Data, Success, Message, seq) of all pages: a failure before the success for every third page, only
    a failure for every fifth, so that order matters. Records name the URL without its fragment, so known
    URLs with one have no record, and some records have no known URL."""
    table = page_urls(spark, sf_dir).withColumn("url", F.expr("regexp_replace(url, '#.*$', '')"))
    good = table.filter("page_id % 5 != 0").select(
        F.struct(F.col("url").alias("Url")).alias("Data"),
        F.lit(True).alias("Success"),
        F.lit("").alias("Message"),
        (F.col("page_id") * 2 + 1).alias("seq"),
    )
    failed = table.filter("page_id % 5 = 0 OR page_id % 3 = 0").select(
        F.struct(F.col("url").alias("Url")).alias("Data"),
        F.lit(False).alias("Success"),
        F.expr("'failed: timeout ' || cast(page_id AS string)").alias("Message"),
        (F.col("page_id") * 2).alias("seq"),
    )
    return good.unionByName(failed)


def resolutions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, Url, IP, Cname, Message) of all pages: every seventh one failed. Records name the URL without
    its query, so known URLs with one have no record, and some records have no known URL."""
    return page_urls(spark, sf_dir).selectExpr(
        "page_id AS seq",
        "regexp_replace(url, '[?].*$', '') AS Url",
        "if(page_id % 7 = 0, '', '10.3.0.' || cast(page_id % 250 AS string)) AS IP",
        "'' AS Cname",
        "if(page_id % 7 = 0, 'no such host', '') AS Message",
    )


def queue_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(value): ``id<TAB>url<TAB>ip`` for every request; http URLs are unknown, some ids are no
    numbers."""
    return requests(spark, sf_dir).select(
        F.concat_ws(
            "\t",
            F.when(F.col("page_id") % 10 == 0, F.lit("x")).otherwise(site_id("url").cast("string")),
            "url",
            F.coalesce("ip", F.lit("")),
        ).alias("value")
    )
