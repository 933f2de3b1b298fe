"""The main text of web pages by block rules in two passes.

A page is cut into blocks: runs of text between block-level elements. Pass one decides blocks by what
they stand in (a menu, a footer, an advert), by length, density of links and density of stop words;
short blocks, and blocks between the limits, stay open. In pass two an open block takes the label of
its nearest decided neighbours; where no block is decided for the text, those near the limit are.

A word in a class names a part beside the article, or only tells of one ("has-sidebar", "share-enabled" on
a wrapper). So such a word counts as a whole name or the first part of one, and not on an element that holds
all articles of the page, or, where there is none, nearly all of its text. The same holds for forms and headers.
Stop words say nothing where a page's text is in none of the languages with a list, or a
block in another script; there length and density of links decide.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass
from html import unescape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Blocks below SHORT characters are open; a block with this density of stop words is text.
SHORT = 70
LONG = 200
STOP_LOW, STOP_HIGH = 0.15, 0.25
LINK_DENSITY = 0.5
# A page is in a known language when this part of the words of its longer blocks is in one list.
KNOWN = 0.2
# A character of these scripts says about as much as so many letters.
DENSE = 3

# Frequent function words of the languages.
STOP_LISTS = tuple(
    frozenset(words.split())
    for words in (
        """
        a about after all also an and any are as at be because been but by can could did do for from had has
        have he her his how i if in into is it its more most no not of on one only or other our out over she
        so some such than that the their them then there these they this to up was we were what when which
        who will with would you your
        """,
        """
        aber als am an auch auf aus bei bis da das dass dem den der des die durch ein eine einem einen einer
        es für hat ich im in ist mit nach nicht noch nur oder sich sie sind so über um und unter von vor war
        was wenn wie wird wir zu zum zur
        """,
        """
        au aux avec ce ces cette comme dans de des du elle en est et été être il ils je la le les leur lui
        mais ne nous on ou où par pas plus pour qu que qui sa se ses son sont sur tout un une vous
        """,
        """
        al como con cuando de del el ella en entre era es esta este esto están hay la las lo los me mi muy
        más ni no nos o para pero por que qué se ser si sin sobre son su sus también tiene todo un una y ya
        """,
    )
)
STOP_WORDS = frozenset().union(*STOP_LISTS)
# Elements whose text is never shown or never part of an article.
RAW = ("script", "style", "noscript", "template", "iframe", "object", "svg", "math", "textarea", "title", "select", "button", "canvas", "audio", "video")
APART = ("nav", "footer", "aside", "menu", "dialog", "head")
WRAPPING = ("form", "fieldset", "header")
MAIN = ("article", "main")
INLINE = ("a", "abbr", "acronym", "b", "bdi", "bdo", "big", "br", "cite", "code", "data", "del", "dfn", "em", "font", "i", "img", "ins", "kbd", "label", "mark", "q", "rp", "rt", "ruby", "s", "samp", "small", "span", "strike", "strong", "sub", "sup", "time", "tt", "u", "var", "wbr", "input", "nobr")
VOID = ("area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr")
HEADINGS = ("h1", "h2", "h3", "h4", "h5", "h6")
# Words of class, id and role that name the parts of a page beside the article.
SIDE_WORDS = frozenset(
    """
    ad ads adv advert advertisement advertising banner breadcrumb breadcrumbs comment comments commentlist
    complementary consent contentinfo cookie cookies disqus footer gdpr login menu modal nav navbar
    navigation newsletter notice pager pagination popup promo promoted promotion recommended related
    replies reply respond search share sharing sidebar signup skip social sponsor sponsored subscribe
    toolbar widget widgets
    """.split()
)
HEADER_WORDS = frozenset(["header", "masthead", "topbar", "sitehead"])
# Of these, words that never stand on a wrapper of the page.
NEVER_WRAPS = frozenset(
    """
    ad ads adv advert advertisement advertising consent cookie cookies disqus gdpr login modal newsletter popup
    promo promoted promotion signup sponsor sponsored subscribe
    """.split()
)
COMMENT_WORDS = frozenset(["comment", "comments", "commentlist", "replies", "reply"])
# An element holds nearly all text of a page without articles; one that is named by the first part of a
# longer name already with less.
NEARLY_ALL, MOSTLY = 0.95, 0.8
# Elements at which raw text that is never closed ends; scripts and styles go on to the end.
_NEXT_BLOCK = re.compile(
    r"<(?:article|main|section|p|div|h[1-6]|ul|ol|table|blockquote|pre|footer|nav|aside|header)\b", re.IGNORECASE
)

_TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[.*?(?:\]\]>|\Z)|<[!?][^>]*+(?:>|\Z)|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*+)",
    re.DOTALL,
)
# The rest of a tag. Only a quote after an equals sign begins a value, and only if it ends.
_REST = re.compile(r"((?:[^=>]++|=\s*+(?:\"[^\"]*+\"|'[^']*+')?+)*+)>")
_NAMED = re.compile(r"(?:^|\s)(?:class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s>]+))", re.IGNORECASE)
_DENSE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af\uf900-\ufaff\U00020000-\U0003ffff]")
_LETTER = re.compile(r"[^\W\d_]")
_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


@dataclass
class Block:
    text: str
    linked: int  # characters inside links
    apart: bool  # inside a part of the page beside the article
    main: bool  # inside the article element
    heading: bool
    sides: tuple[int, ...] = ()  # elements around it that are named like parts beside the article


@dataclass
class _Side:
    """An element named like a part beside the article, and how sure that is."""

    limit: float  # part of the page's text that it may hold


def _hints(rest: str) -> tuple[float, set[str]]:
    """How much text an element so named may hold to count as a part beside the article (0: is none),
    and its names."""
    if "=" not in rest:
        return 0, set()
    names = {n.lower(): [p.lower() for p in _PART.findall(n)] for m in _NAMED.findall(rest) for n in "".join(m).split()}
    limit = 0.0
    for name, parts in names.items():
        words = {name, *parts[:1]}
        if words & NEVER_WRAPS:
            limit = 2.0
        elif words & SIDE_WORDS:
            whole = name in SIDE_WORDS or all(p in SIDE_WORDS for p in parts)
            limit = max(limit, NEARLY_ALL if whole else MOSTLY)
    return limit, set(names)


class _Tags:
    """Tags, comments and the like of a page, in time linear in its length."""

    def __init__(self, html: str):
        self.html, self.last, self.quoted = html, html.rfind(">"), True
        self.open: set[str] = set()  # names of raw elements that are never closed from here on

    def next(self, at: int) -> tuple[int, int, str, bool, str] | None:
        """(start, end, name, whether it ends an element, attributes) of the next one; a comment has no name."""
        found = _TOKEN.search(self.html, at)
        if found is None:
            return None
        if found["name"] is None:
            return found.start(), found.end(), "", False, ""
        if self.last < found.end():
            return None
        rest = _REST.match(self.html, found.end()) if self.quoted else None
        if rest is None:
            # All signs that could end it stand in quotes, so they count as they are, here and after it.
            self.quoted = False
            end = self.html.index(">", found.end())
            return found.start(), end + 1, found["name"].lower(), bool(found["end"]), self.html[found.end() : end]
        return found.start(), rest.end(), found["name"].lower(), bool(found["end"]), rest[1]

    def after_raw(self, name: str, at: int) -> int:
        """Where a raw element ends that begins before ``at``."""
        if name not in self.open:
            stop = re.compile(rf"</{re.escape(name)}\s*>", re.IGNORECASE).search(self.html, at)
            if stop:
                return stop.end()
            self.open.add(name)
        if name in ("script", "style"):
            return len(self.html)
        block = _NEXT_BLOCK.search(self.html, at)
        return block.start() if block else len(self.html)


def blocks(html: str) -> list[Block]:
    """The blocks of a page in order. Elements need not be closed; what is open at the end ends there."""
    out: list[Block] = []
    stack: list[tuple[str, bool, bool, tuple[int, ...]]] = []  # (name, apart, main, sides)
    sides: list[_Side] = []
    articles: list[tuple[int, ...]] = []  # elements of ``sides`` around each article
    pieces: list[str] = []
    linked = depth = 0
    heading = False

    def close() -> None:
        nonlocal pieces, linked, heading
        text = " ".join(unescape("".join(pieces)).split()) if pieces else ""
        if text:
            apart, main, around = stack[-1][1:] if stack else (False, False, ())
            out.append(Block(text, min(linked, len(text)), apart, main, heading, around))
        pieces, linked = [], 0

    def say(text: str) -> None:
        nonlocal linked
        pieces.append(text)
        if depth:
            linked += len(text.strip())

    tags, at, size = _Tags(html), 0, len(html)
    while at < size:
        found = tags.next(at)
        if found is None:
            say(html[at:])
            break
        start, end, name, ends, rest = found
        if start > at:
            say(html[at:start])
        at = end
        if not name:
            continue
        if name in RAW and not ends:
            if not rest.endswith("/"):
                at = tags.after_raw(name, at)
            pieces.append(" ")
            continue
        if name in INLINE:
            if name == "a":
                depth = max(0, depth + (-1 if ends else 1)) if ends or depth == 0 else depth
            elif name == "br":
                pieces.append(" ")
            continue
        close()
        depth = 0 if name != "li" else depth
        heading = name in HEADINGS and not ends
        if name in VOID or name == "p" or name in HEADINGS:
            continue
        if ends:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    del stack[k:]
                    break
            continue
        if rest.endswith("/"):
            continue
        apart, main, around = stack[-1][1:] if stack else (False, False, ())
        if name in ("html", "body"):
            stack.append((name, False, False, ()))
            continue
        limit, names = _hints(rest)
        comment = bool(names & COMMENT_WORDS)
        if name in MAIN or "main" in names and name == "div":
            if not (apart or comment):
                articles.append(around)
            main, limit = True, NEARLY_ALL if comment else 0
        elif name in WRAPPING and not (main and name == "header"):
            limit = max(limit, NEARLY_ALL)
        elif not main and any(n in HEADER_WORDS or _PART.findall(n)[:1] and _PART.findall(n)[0] in HEADER_WORDS for n in names):
            limit = max(limit, MOSTLY)
        if limit:
            around = (*around, len(sides))
            sides.append(_Side(limit))
        stack.append((name, apart or name in APART, main, around))
    close()
    _settle(out, sides, articles)
    return out


def _settle(found: list[Block], sides: list[_Side], articles: list[tuple[int, ...]]) -> None:
    """Sets the blocks apart that stand in elements named for it, but for elements that wrap the page: those
    around every article, or, on a page without articles, around more than their limit of its text."""
    if not sides:
        return
    if articles:
        wraps = set(articles[0]).intersection(*articles)
        wraps = {k for k in wraps if sides[k].limit <= 1}
    else:
        texts = [b for b in found if not b.apart]
        whole, held = sum(len(b.text) for b in texts), [0] * len(sides)
        for b in texts:
            for k in b.sides:
                held[k] += len(b.text)
        wraps = {k for k, n in enumerate(held) if n > sides[k].limit * whole}
    for b in found:
        b.apart = b.apart or not wraps.issuperset(b.sides)


def _words(text: str) -> list[str]:
    return [w.strip(".,;:!?()\"'") for w in text.lower().split()]


def stop_density(text: str) -> float:
    words = _words(text)
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def extent(text: str) -> int:
    """Characters, those of dense scripts counted as :data:`DENSE`."""
    return len(text) if text.isascii() else len(text) + (DENSE - 1) * len(_DENSE.findall(text))


def known_language(found: list[Block]) -> bool:
    """Whether the longer blocks outside the article, without those beside it and lists of links, are in a
    language with a list of stop words; only they are judged by stop words."""
    judged = [
        b.text for b in found
        if not (b.apart or b.main) and extent(b.text) >= SHORT and b.linked <= LINK_DENSITY * len(b.text)
    ]
    words = _words(" ".join(judged))
    return any(sum(w in known for w in words) >= KNOWN * len(words) for known in STOP_LISTS)


def _other_script(text: str) -> bool:
    """Whether most letters are beyond the Latin ones."""
    if text.isascii():
        return False
    letters = _LETTER.findall(text)
    return 2 * sum(c > "\u024f" for c in letters) > len(letters)


GOOD, BAD, SHORT_OPEN, NEAR_GOOD = "good", "bad", "short", "near"


def first_pass(block: Block, known: bool = True) -> str:
    """Label of a block by itself; ``known`` tells whether the page is in a language with stop words."""
    if block.apart or (not block.main and "\N{COPYRIGHT SIGN}" in block.text[:20]):
        return BAD
    density = block.linked / len(block.text)
    if density > LINK_DENSITY:
        return BAD
    size = extent(block.text)
    if size < SHORT:
        return BAD if block.linked and not block.main else SHORT_OPEN
    if block.main:
        return GOOD
    if not known or _other_script(block.text):
        return GOOD if size > LONG else NEAR_GOOD
    stop = stop_density(block.text)
    if stop >= STOP_HIGH:
        return GOOD if len(block.text) > LONG else NEAR_GOOD
    return NEAR_GOOD if stop >= STOP_LOW else BAD


def _nearest(found: list[Block], labels: list[str], order: range) -> list[str | None]:
    """Per block the label of the decided block last met in this order; of a block in the article only
    blocks in it count, and those set apart there decide nothing."""
    out: list[str | None] = [None] * len(found)
    last: dict[bool, str | None] = {False: None, True: None}
    for k in order:
        block, label = found[k], labels[k]
        out[k] = last[block.main]
        if label in (GOOD, BAD):
            last[False] = label
            if block.main:
                last[True] = None if block.apart else label
    return out


def second_pass(found: list[Block], labels: list[str]) -> list[bool]:
    """Whether each block is text. An open block takes the label of its nearest decided neighbours. Where
    they differ, or one is missing, a block is text if it stands in the article, or if it was near the
    limit, or is a heading before text. Neighbours beside the article say nothing about a block in it."""
    backwards = range(len(found) - 1, -1, -1)
    earlier, later = _nearest(found, labels, range(len(found))), _nearest(found, labels, backwards)
    out = []
    for k, (block, label) in enumerate(zip(found, labels, strict=True)):
        if label in (GOOD, BAD):
            out.append(label == GOOD)
            continue
        before, after = earlier[k], later[k]
        if before == after and before is not None:
            out.append(before == GOOD)
        elif block.main:
            out.append(True)
        else:
            out.append((label == NEAR_GOOD or block.heading) and GOOD in (before, after) and (after == GOOD or not block.heading))
    return out


def main_text(html: str | None) -> str:
    """The text blocks of a page, one per line; empty for null."""
    found = blocks(html or "")
    known = known_language(found)
    labels = [first_pass(b, known) for b in found]
    if GOOD not in labels:
        labels = [GOOD if x == NEAR_GOOD else x for x in labels]
    keep = second_pass(found, labels)
    return "\n".join(b.text for b, k in zip(found, keep, strict=True) if k)


def extract(pages: DataFrame, html_column: str = "html") -> DataFrame:
    """The pages with ``text``, their main text, in place of the HTML.

    Character references are decoded, white space inside a block is one space, blocks are joined by line
    feeds in page order. A page without an article has an empty text, so has a null one. Pages are read
    whole, each by itself, without a shuffle; repeated rows give repeated rows. A column ``text`` of the
    input is replaced, all others are kept.
    """
    names = [c for c in pages.columns if c not in ("text", html_column)]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [main_text(h.as_py()) for h in batch.column(len(names))]
            columns = dict(zip(names, batch.columns[:-1], strict=True))
            yield pa.RecordBatch.from_pydict(columns | {"text": pa.array(texts, pa.string())})

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name in names]
    chosen = [F.col(f"`{c}`") for c in names]
    return pages.select(*chosen, F.col(html_column).alias("ws_html")).mapInArrow(rows, ", ".join([*kinds, "text string"]))
