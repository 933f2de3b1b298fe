import re
from html import unescape

import pytest

from webspark.llm import main_text as mt

LONG = "This is a sentence of the article with all the words that it needs, and it is long enough for a block to be judged by itself."


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (None, ""),
        ("", ""),
        ("<p", ""),
        (f"<article><h1>Title</h1><p>{LONG}<p>Short.</article>", f"Title\n{LONG}\nShort."),
        (f"<header><p>{LONG}</p></header><nav><p>{LONG}</p></nav><main><p>{LONG}</p></main><footer>{LONG}</footer>", LONG),
        (f"<article><p>{LONG}</p><div class='comments'><p>{LONG}</p></div><form>{LONG}</form><aside>{LONG}</aside></article>", LONG),
        (f"<article><p>{LONG}</p><ul class=related-posts><li><a href=x>One more story</a></li></ul><p>End &amp; out&nbsp; &eacute;</p></article>", f"{LONG}\nEnd & out é"),
        (f"<script>var t='<p>{LONG}</p>';</script><style>p{{}}</style><!-- <p>{LONG} --><article>{LONG}</article>", LONG),
        (f"<article><p>{LONG[:60]}<b>bold<br>{LONG[60:]}</article>", LONG[:60] + "bold" + LONG[60:]),
        (f"<div><p>{LONG} {LONG}</p><p>Short one.</p><p>{LONG} {LONG}</p></div>", f"{LONG} {LONG}\nShort one.\n{LONG} {LONG}"),
        (f"<div><p>Zq xv</p><a href=/>Home</a> <a href=/>News</a></div><div>© 2024 {LONG}</div>", ""),
        (f"<div class=\"cookie-notice\">{LONG}</div><div id='ad-top'>{LONG} {LONG}</div>", ""),
        (f"<article><p>1 < 2 and 3 > 2. {LONG}</article>", f"1 < 2 and 3 > 2. {LONG}"),
        (f"<ARTICLE><P>{LONG}</P></ARTICLE><DIV CLASS=Advert>{LONG}{LONG}</DIV>", LONG),
    ],
)
def test_pages(html, text):
    assert mt.main_text(html) == text


def test_tables_keep_their_articles(spark, pages):
    got = {r["page_id"]: r["text"] for r in mt.extract(pages).collect()}
    for r in pages.collect():
        inside = re.search(r"<article>(.*?)(</article>|\Z)", r["html"], re.DOTALL)[1].replace("<br>", " ")
        want = [" ".join(unescape(re.sub("<[^>]*>", "", b)).split()) for b in re.split("</?(?:p|h1)>", inside)]
        assert got[r["page_id"]] == "\n".join(b for b in want if b)


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "b"), (None, f"<article>{LONG}</article>", "c"), (3, "<p>" * 50000 + "<div>" * 2000, "d"), (4, "x", "e"), (4, "x", "e")]
    docs = spark.createDataFrame(rows, "page_id long, html string, text string")
    out = mt.extract(docs)
    assert out.columns == ["page_id", "text"]
    got = sorted((str(r["page_id"]), r["text"]) for r in out.collect())
    assert got == [("1", ""), ("2", ""), ("3", ""), ("4", ""), ("4", ""), ("None", LONG)]
    assert mt.extract(docs.limit(0)).count() == 0


@pytest.mark.parametrize(
    "text",
    [
        "Il giornale pubblica ogni mattina notizie dalla città, racconti dei lettori e fotografie degli avvenimenti più importanti della settimana. Chi desidera scrivere alla redazione trova gli indirizzi nell'ultima pagina.",
        "Каждое утро газета публикует новости города, рассказы читателей и фотографии самых важных событий недели. Адреса редакции можно найти на последней странице, письма читателей печатаются каждую субботу без изменений.",
        "Gazeta publikuje każdego ranka wiadomości z miasta, opowiadania czytelników oraz fotografie najważniejszych wydarzeń tygodnia. Adresy redakcji znajdują się na ostatniej stronie, listy drukujemy w każdą sobotę bez zmian.",
        "这份报纸每天早上刊登城市新闻、读者的故事以及一周最重要事件的照片。编辑部的地址可以在最后一页找到，读者来信每个星期六都会原样刊登，欢迎大家踊跃投稿，来信请写明姓名和联系方式，谢谢各位读者的支持。",
    ],
)
def test_languages_without_stop_words(text):
    page = f"<nav><p>{text}</p></nav><div><p>{text}</p><p>{text[:30]}</p><p>{text}</p></div><div><a href=/>{text[:90]}</a></div><footer>{text}</footer>"
    assert mt.main_text(page) == f"{text}\n{text[:30]}\n{text}"
    assert mt.main_text(f"<div><p>{LONG} {LONG}</p><p>{text}</p></div>").count("\n") == (1 if mt._other_script(text) else 0)


def test_keywords_of_a_known_language_stay_out():
    words = "shoes jackets hats " * 12
    assert mt.main_text(f"<div><p>{LONG} {LONG}</p><p>{LONG} {LONG}</p></div><div>{words}</div>") == f"{LONG} {LONG}\n{LONG} {LONG}"


@pytest.mark.parametrize(
    "page",
    [
        '<div class="layout has-sidebar"><article><p>{0}</p></article><div class="sidebar">{1}</div></div>',
        '<div id="page" class="site no-comments"><p>{0}</p></div>',
        '<div class="post share-enabled"><p>{0}</p></div>',
        '<div class="site header-image"><h1></h1><p>{0}</p></div>',
        '<form id="aspnetForm"><article><p>{0}</p></article><div class=footer>{1}</div></form>',
        '<form id="aspnetForm"><div><p>{0}</p></div></form>',
        '<div class="sidebar-layout comments-open"><main><p>{0}</p></main><aside>{1}</aside></div>',
        '<article><p>{0}</p></article><div class="comments"><article class="comment"><p>{1}</p></article></div>',
        '<article><p>{0}</p><section id="comments"><article class="comment"><p>{1}</p></article></section></article>',
        '<div><p>{0}</p></div><div class="comments"><article class="comment"><p>{1}</p></article></div>',
        '<div class="search-results-open"><article><p>{0}</p></article></div><div class="search-box">{1}</div>',
        '<article><select><option>x<p>{0}</p></article>',
        '<article><p title=don\'t>{0}</p></article>',
        '<article><p title="a > b" data-x=\'c > d\'>{0}</p></article>',
        '<div class="cookie-wall"><p>{1}</p></div><article><p>{0}</p></article>',
        '<div class="cookie-wall"><article>{1}</article></div><article><p>{0}</p></article>',
    ],
)
def test_wrappers_and_parts(page):
    assert mt.main_text(page.format(LONG + " " + LONG, "BESIDE " + LONG)) == LONG + " " + LONG


def test_copyright_line_in_an_article_and_short_paragraphs():
    assert mt.main_text(f"<article><p>© 2024 was the year. {LONG}</p></article>") == f"© 2024 was the year. {LONG}"
    assert mt.main_text(f"<div><p>{LONG}</p><p>{LONG[:89]}</p></div>") == f"{LONG}\n{LONG[:89]}"


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<!--", "<a href='", "<select>", '<a x=">"', "<a<a", "</p", "<![CDATA[", "<p x='>' "])
def test_unclosed_markup_takes_linear_time(unit):
    from time import perf_counter

    times = []
    for size in (500_000, 5_000_000):
        page = f"<article><p>{LONG}</p>" + unit * (size // len(unit))
        start = perf_counter()
        text = mt.main_text(page)
        times.append(perf_counter() - start)
        assert text.startswith(LONG)
    assert times[1] < 30 * times[0] + 1


LAYOUTS = ["<article>{}</article>", "<main>{}</main>", "<div role='main'>{}</div>", '<div class="content with-sidebar">{}</div>', "<table><tr><td>{}</td></tr></table>"]
BESIDE = ["<nav><ul><li>{0}</ul></nav>", "<footer><p>{0}</p></footer>", "<aside>{0}</aside>", "<div class='related-posts'><p>{0}</p></div>", "<div id=comments><p>{0}</p></div>", "<header><p>{0}</p></header>"]


@pytest.mark.parametrize("seed", range(40))
def test_generated_layouts(seed):
    """Pages made of a known article and known parts beside it."""
    import random

    rng = random.Random(seed)
    words = LONG.rstrip(".").split()
    article = [" ".join(rng.choices(words, k=rng.randrange(45, 90))) + "." for _ in range(rng.randrange(2, 6))]
    parts = [rng.choice(BESIDE).format("Beside " + " ".join(rng.choices(words, k=30))) for _ in range(rng.randrange(5))]
    body = rng.choice(LAYOUTS).format("".join(f"<p>{p}</p>" for p in article))
    at = rng.randrange(len(parts) + 1)
    page = "".join([*parts[:at], body, *parts[at:]])
    if rng.random() < 0.5:
        page = f'<div class="{rng.choice(["page has-sidebar", "site no-comments", "wrap search-open", "banner-top"])}">{page}</div>'
    assert mt.main_text(f"<html><body>{page}</body></html>") == "\n".join(article)
