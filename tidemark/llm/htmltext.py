"""Main text of web pages by the line-block distribution.

Markup is stripped to lines, one for each block. Lines of menus, adverts and
the like weigh nothing, others as many characters as they have outside links.
The weights are summed over sliding windows of lines: where the sum rises from
zero is a surge point, where it falls back to zero a dive point, and the text
between the two is kept if the sum gets high enough. Every page goes this way;
marks are evidence for the weights. Where an article is marked, its lines weigh
all their characters and those outside it nothing, unless a teaser is all that
the mark holds. A part set apart between two lines of one content element, and
blanks there, open no dive.
"""

from __future__ import annotations

import re
from collections import Counter
from html import unescape
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import batches

#: Lines of a window.
WINDOW = 3
#: A stretch is kept if its highest window has this many characters, or this
#: share of the page's highest window.
LEAST_PEAK, LEAST_SHARE = 400, 0.3
#: An article with less than this share of the heaviest other text is a teaser.
TEASER_SHARE = 0.3

# Names of HTML elements and attributes, and words by which pages mark their parts.
RAW = {"script", "style", "textarea", "title", "noscript", "template", "svg", "iframe", "object", "canvas", "math", "xmp"}
APART = {"nav", "footer", "aside", "form", "menu", "dialog", "select", "button"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
BLOCKS = {
    "address", "article", "aside", "blockquote", "body", "center", "dd", "details", "dialog", "div", "dl", "dt",
    "fieldset", "figcaption", "figure", "footer", "form", "h1", "h2", "h3", "h4", "h5", "h6", "header", "hr",
    "html", "li", "main", "menu", "nav", "ol", "p", "pre", "section", "summary", "table", "tbody", "tfoot", "thead", "tr", "ul",
}
#: Elements that a new block ends even without an end tag.
LOOSE = {"p", "li", "dt", "dd", "h1", "h2", "h3", "h4", "h5", "h6"}
#: Elements whose lines, inserts between them aside, belong together.
CONTENT = {"article", "body", "div", "html", "main", "section"}
#: Words in a class, id or role that set an element apart from the article.
WORDS = {
    "ad", "ads", "adbox", "adslot", "advert", "adverts", "advertisement", "advertising", "alert", "banner", "breadcrumb",
    "breadcrumbs", "complementary", "consent", "contentinfo", "cookie", "cookies", "copyright", "disclaimer",
    "footer", "gdpr", "header", "login", "masthead", "menu", "modal", "nav", "navbar", "navigation", "newsletter",
    "notice", "overlay", "pager", "pagination", "popup", "promo", "recommended", "related", "search", "share",
    "sharing", "sidebar", "signup", "skip", "social", "sponsor", "sponsored", "subscribe", "teaser", "toolbar", "widget",
}
TALK = {"comment", "comments", "commentlist", "discussion", "disqus", "replies", "reply", "respond"}
#: Words by which pages mark the teaser of another page.
CARDS = {"card", "excerpt", "preview", "promo", "recommended", "related", "summary", "teaser"}
#: Words beside those above that tell where or what a part is, not what it is about.
PLACES = {
    "area", "article", "bar", "block", "body", "bottom", "box", "button", "buttons", "column", "container", "content", "form",
    "global", "group", "inline", "inner", "item", "items", "left", "link", "links", "list", "main", "outer", "page", "panel", "post",
    "posts", "primary", "reader", "right", "secondary", "section", "site", "stories", "thread", "top", "user", "wrap", "wrapper",
}
HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6"}

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<!\[CDATA\[|\]\]>|<[!?][^<>]*+>"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/<>]*+)(?P<rest>(?:[^\"'<>]|\"[^\"]*+\"|'[^']*+')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/<>]*+)(?P<rest2>[^<>]*+)>", re.S)
_ATTRIBUTE = re.compile(r"""([a-zA-Z-]++)\s*=\s*(?:"([^"]*+)"|'([^']*+)'|([^\s"'>]++))""")
_HIDDEN = re.compile(r"(?:^|\s)hidden(?:\s|=|/|$)|aria-hidden\s*=\s*[\"']?true|display\s*:\s*none", re.I)
_PART = re.compile(r"[a-z]+")


class Line(NamedTuple):
    """A block of a page."""

    text: str
    #: Characters, and those outside links, blanks aside.
    chars: int
    outside: int
    #: Of a part set apart, as a menu or an advert.
    apart: bool
    #: Number of the outermost article element around it, or 0; negative if that is named a teaser.
    article: int
    #: Within an article or main element.
    marked: bool
    #: Number of the outermost article or main element, else of the nearest content element.
    inside: int
    #: Of a first heading.
    title: bool


def _names(rest: str) -> list[tuple[str, list[str]]]:
    """(attribute, words) of each name in class, id and role."""
    out = []
    for key, *values in _ATTRIBUTE.findall(rest):
        if key.lower() in ("class", "id", "role"):
            out += [(key.lower(), _PART.findall(token)) for token in "".join(values).lower().split()]
    return [(key, parts) for key, parts in out if parts and parts[0] not in ("has", "with", "no", "without")]


def _apart(name: str, rest: str, in_article: bool) -> str:
    """Why an element is not of the article: 'tag', 'word', 'talk', or '' if it may be.

    An id of a heading or section is mostly made of its title, and within an
    article so may be other names; they count only if every part of the name
    says what kind of part this is.
    """
    if name in APART or name == "header" and not in_article:
        return "tag"
    if not rest or "=" not in rest and "hidden" not in rest:
        return ""
    if name in ("html", "body"):
        return ""
    if _HIDDEN.search(rest):
        return "tag"
    if name in HEADINGS:
        return ""
    found = ""
    for key, parts in _names(rest):
        titled = key == "id" and name == "section"
        if (titled or in_article) and not (WORDS | TALK | PLACES).issuperset(parts):
            continue
        if titled and in_article:  # a section on discussion, sponsors or search
            if {"comment", "comments", "commentlist", "disqus"}.intersection(parts):
                return "talk"
            continue
        if TALK.intersection(parts):
            return "talk"
        if WORDS.intersection(parts):
            found = "word"
    return "" if name in ("article", "main") else found


def lines_of(html: str) -> list[Line]:
    """The blocks of a page."""
    out: list[Line] = []
    text: list[str] = []
    outside = 0
    # name, why apart, number of the outermost article, within article or main, content element; all but the name inherited
    stack: list[tuple[str, str, int, bool, int]] = []
    opened: Counter = Counter()
    apart, article, marked, inside, links = "", 0, False, 0, 0
    elements = 0

    def close() -> None:
        nonlocal outside
        line = " ".join("".join(text).split())
        if line:
            chars = len(line) - line.count(" ")
            out.append(Line(line, chars, outside, bool(apart), article, marked, inside, opened["h1"] > 0))
        elif out and out[-1].text:
            out.append(BLANK)
        text.clear()
        outside = 0

    def add(raw: str) -> None:
        nonlocal outside
        piece = unescape(raw)
        text.append(piece)
        if not links:
            outside += len("".join(piece.split()))

    def pop(n: int) -> None:
        nonlocal apart, article, marked, inside
        opened.subtract(x[0] for x in stack[n:])
        del stack[n:]
        _, apart, article, marked, inside = stack[-1] if stack else ("", "", 0, False, 0)

    at, end = 0, len(html)
    while at < end:
        tag = _TAG.search(html, at)
        if tag is None:
            add(html[at:])
            break
        if tag.start() > at:
            add(html[at : tag.start()])
        at = tag.end()
        name = tag["name"] or tag["name2"]
        if name is None:
            continue
        name, rest = name.lower(), tag["rest"] or tag["rest2"] or ""
        if tag["end"] or tag["end2"]:
            if name in BLOCKS:
                close()
            if name == "a":
                links = max(0, links - 1)
            if opened[name]:
                n = len(stack) - 1
                while stack[n][0] != name:
                    n -= 1
                pop(n)
            continue
        if name in RAW:
            if not rest.endswith("/"):
                closing = re.compile(rf"</{name}\s*+>", re.I).search(html, at)
                at = closing.end() if closing else end
            continue
        if name in ("br", "td", "th"):
            text.append(" ")
            continue
        if name in BLOCKS:
            close()
            for n in range(len(stack) - 1, -1, -1):
                if stack[n][0] not in LOOSE or (stack[n][0] == "li") != (name == "li") and stack[n][0] != "p":
                    break
                pop(n)
        if name in VOID or rest.endswith("/") and name not in BLOCKS:
            continue
        if name == "a":
            links += 1
            continue
        why = _apart(name, rest, marked)
        if name in ("article", "main") and apart == "word" and not why:
            apart = ""  # a wrapper with a misleading name
        if name in BLOCKS or why:
            if why and name not in BLOCKS:
                close()
            opened[name] += 1
            elements += name in CONTENT
            if name == "article" and not article:
                card = any(CARDS.intersection(parts) for _, parts in _names(rest))
                article = -elements if card else elements
            if name in CONTENT and not marked:
                inside = elements
            marked = marked or name in ("article", "main")
            apart = apart or why
            stack.append((name, apart, article, marked, inside))
    close()
    return out


BLANK = Line("", 0, 0, False, 0, False, -1, False)


def _without_inserts(lines: list[Line]) -> list[Line]:
    """The lines without blanks and parts set apart that stand between lines of one content element."""
    out, held, before = [], [], None
    for line in lines:
        if line.apart or not line.text:
            held.append(line)
            continue
        if line.inside != before:
            out += held
        held, before = [], line.inside
        out.append(line)
    return out + held


def _teasers(lines: list[Line]) -> set[int]:
    """The numbers of the articles that are teasers of other pages.

    These are light beside the heaviest other article or, if they hold no first
    heading that the page has nowhere else, beside the text outside articles.
    One that is named a teaser goes if any other text is heavier.
    """
    weights: Counter = Counter()
    rest: Counter = Counter()
    titles = set()
    for line in lines:
        if not line.apart and line.text:
            if line.article:
                weights[line.article] += line.chars
            else:
                rest[line.inside] += line.outside
            if line.title:
                titles.add(line.article)
    beside = max(rest.values(), default=0)
    heavy = sorted(((w, number) for number, w in weights.items() if number > 0), reverse=True)[:2]
    out = set()
    for number, weight in weights.items():
        share = 1.0 if number < 0 else TEASER_SHARE
        others = [w for w, other in heavy if other != number]
        heaviest = max([*others, 0 if titles == {number} else beside])
        if weight < share * heaviest:
            out.add(number)
    return out


def main_text(html: str) -> str:
    lines = lines_of(html)
    teasers = _teasers(lines)
    if teasers:
        lines = [line._replace(apart=True) if line.article in teasers else line for line in lines]
    if any(line.marked and not line.apart for line in lines):
        # the page says where its article is
        lines = _without_inserts([line if line.marked else line._replace(apart=True) for line in lines])
        weights = [0 if line.apart else line.chars for line in lines]
    else:
        lines = _without_inserts(lines)
        weights = [0 if line.apart else line.outside for line in lines]
    sums, total = [], 0
    for i in range(len(weights) + WINDOW - 1):  # the window that ends at line i
        total += weights[i] if i < len(weights) else 0
        total -= weights[i - WINDOW] if i >= WINDOW else 0
        sums.append(total)
    least = min(LEAST_PEAK, LEAST_SHARE * max(sums, default=0))
    kept: list[str] = []
    surge = None
    for i, value in enumerate([*sums, 0]):
        if value and surge is None:
            surge = i
        elif not value and surge is not None:
            if max(sums[surge:i]) >= least:
                last = min(i - WINDOW, len(lines) - 1)
                kept += [lines[k].text for k in range(surge, last + 1) if lines[k].text and not lines[k].apart]
            surge = None
    return "\n".join(kept)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without the html, with ``text`` and ``n_chars`` (code points).

    Scripts, comments and other markup go, character references are decoded,
    white space within a block becomes one blank, and blocks are joined by line
    feeds. Null, empty and text-free html gives an empty text. Whole pages are
    read, however long. Rows are handled one by one, so null or repeated ids
    change nothing; columns named like the new ones are replaced.
    """

    def run(htmls: list[bytes]) -> list[pa.Array]:
        found = [main_text(h.decode()) for h in htmls]
        return [pa.array(found, pa.string()), pa.array([len(t) for t in found], pa.int64())]

    return batches.extend(pages, html_col, "text string, n_chars long", run).drop(html_col)


def op9_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    """page_id, url, text and n_chars of every page."""
    return extract(batches.table(spark, folder, "pages").select("page_id", "url", "html"))
