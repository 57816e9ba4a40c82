"""Main text of web pages by two-pass block rules.

A page is cut into blocks of text at block-level tags.  Scripts, forms and
other regions that say what they are (element, role, class or id) are bad.
First pass, on the other blocks: link density, length and stop-word density
decide good, bad, or leave the block open (short, or with few stop words); in
a language without a list of stop words, link density and length alone.
Second pass: open blocks inherit from their nearest decided neighbours, inside
the article element if the page has one.  The good blocks, in page order, are
the text.

One pass over the html per page, no exchange; a page is the unit of work.
"""

from __future__ import annotations

import html as _html
import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MIN_LONG = 70           # characters from which a block is not short
MAX_LINKS = 0.5         # share of link characters from which a block is a menu
MIN_STOPS, MANY_STOPS = 0.12, 0.25
FOREIGN_LETTERS = 0.01  # share of letters of other languages from which the stop words say nothing
WIDE = 3                # characters that a Chinese, Japanese or Korean one counts as

STOP_WORDS = frozenset("""
a about after all also an and are as at be been but by can for from had has have he her his i if in into is it its
more no not of on one or our out s she so than that the their them then there these they this to up was we were what
when which who will with would you your
aber als am an auch auf aus bei bis das dass dem den der des die doch du durch ein eine einem einen einer er es für
haben hat ich ihr im in ist ja kann man mehr mit nach nicht noch nur oder schon sein sich sie sind so über um und uns
von vor war was wenn werden wie wir wird zu zum zur
al como con cuando de del desde el ella en entre era es esta está este fue ha hay la las le lo los me más mi muy no
nos o para pero por que qué se ser si sin sobre son su sus también te tiene todo un una uno y ya
à au aux avec ce ces cette comme dans de des du elle en est et été être il ils je la le les leur lui ma mais même mes
mon ne nous on ou où par pas plus pour qu que qui sa sans se ses si son sont sur tu un une vous
""".split())

HEADINGS = {"h1", "h2", "h3", "h4", "h5", "h6", "figcaption"}
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "param", "source", "track", "wbr"}
RAW = {"script", "style", "noscript", "template", "iframe", "textarea", "title", "xmp", "noembed", "noframes"}
DROPPED = {"nav", "footer", "aside", "form", "button", "select", "dialog", "menu", "head", "svg", "canvas", "object",
           "audio", "video", "map", "datalist", "math", "applet", "label"}
CONTAINERS = DROPPED | {"html", "body", "article", "main", "section", "div", "header", "ul", "ol", "dl", "table",
                        "tbody", "thead", "tfoot", "figure", "blockquote", "details", "fieldset", "center", "hgroup",
                        "search", "span"}
BLOCKS = (CONTAINERS - {"span", "label", "button", "select", "svg", "canvas", "object", "audio", "video", "math"}) | {
    "p", "h1", "h2", "h3", "h4", "h5", "h6", "li", "dt", "dd", "tr", "td", "th", "pre", "address", "figcaption",
    "caption", "summary", "hr", "option", "legend"}
ROLES = {"navigation", "banner", "contentinfo", "complementary", "search", "alert", "alertdialog", "dialog", "form",
         "menu", "menubar", "toolbar", "status", "tablist"}
# words of a class or id that name a region around the article
REGION_WORDS = frozenset("""
ad ads adbox adslot adsense advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo
promos promotion banner banners cookie cookies consent gdpr notice notices notification notifications alert popup
modal overlay interstitial paywall newsletter subscribe subscription signup signin login register nav navbar
navigation menu menus submenu breadcrumb breadcrumbs sidebar aside rail widget widgets share sharing sharebar social
footer foot colophon header masthead topbar toolbar search searchbox pagination pager form copyright disclaimer
skip skiplink hidden
""".split())
# regions whose own articles are not the page's article
FOREIGN_WORDS = frozenset("""
comment comments commentlist disqus reply replies respond discussion related recommended recommendations teaser
teasers trending popular outbrain taboola
""".split())
ARTICLE_WORDS = frozenset("article post entry content story title headline main body text".split())

# what may follow the name of a region in a class or id
PLACE_WORDS = ARTICLE_WORDS | frozenset("""
area bar block box button column container group holder icon inline inner item items left link links list listing outer
panel posts primary region right row secondary section slot top bottom unit view wrap wrapper zone
""".split())
# classes that tell the state or layout of an element instead of naming it
STATE_FIRST = frozenset("no not has have with without hide show layout overflow backface".split())
STATE_LAST = frozenset("enabled disabled open opened closed expanded collapsed active inactive on off true false".split())

_TOKEN = re.compile(r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)"
                    r"((?:[^>\"']++|\"[^\"]*+\"|'[^']*+')*+>|[^>]*>)", re.S)
_ATTRIBUTE = re.compile(r"([a-zA-Z-]+)\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>]+)")
_SPACE = re.compile(r"\s+")
_LETTER = re.compile(r"[^\W\d_]")
_FOREIGN_LETTER = re.compile(r"[^\W\d_a-zäöüßñáéíóúàâæçèêëîïôœùûÿªº]")     # in none of the listed languages
_WIDE = re.compile(r"[\u3040-\u30ff\u3400-\u9fff\uac00-\ud7af]")
_WORD = re.compile(r"[^\W\d_]+")
_NAME_PART = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])")


@dataclass
class Block:
    text: str
    links: int              # characters inside links
    region: bool            # inside a region around the article
    article: bool           # inside the page's article
    tag: str = ""           # the heading, paragraph or item that it is


def _named(value: str) -> tuple[set[str], bool, bool, bool]:
    """What the names in a class or id say: all their words, and whether some
    name is a region with articles of its own, a region, or the article."""
    words: set[str] = set()
    foreign = region = article = False
    for name in value.split():
        parts = [w.lower() for w in _NAME_PART.findall(name)]
        words.update(parts)
        if not parts or parts[-1] in STATE_LAST:
            continue
        if parts[-1] == "hidden":
            region |= len(parts) == 1 and name.lower() == "hidden" or parts[0] in ("visually", "is", "sr")
            continue
        if STATE_FIRST.intersection(parts[:-1]):
            continue
        last = len(parts) - 1
        while last and parts[last] not in REGION_WORDS | FOREIGN_WORDS and parts[last] in PLACE_WORDS:
            last -= 1
        if parts[last] in FOREIGN_WORDS:
            foreign = True
        elif parts[last] in REGION_WORDS:
            region = True
        elif parts[-1] in ARTICLE_WORDS:
            article = True
    return words, foreign, region, article


def _region(tag: str, attributes: str) -> str:
    """'' for content, 'foreign' for regions with articles of their own, else 'region'."""
    if tag in DROPPED:
        return "foreign" if tag in ("aside", "footer") else "region"
    if not attributes or tag in ("html", "body"):
        return ""
    words: set[str] = set()
    foreign = named = content = False
    for name, value in _ATTRIBUTE.findall(attributes):
        name, value = name.lower(), value.strip("\"'")
        if name in ("class", "id"):
            said = _named(value)
            words |= said[0]
            foreign, named, content = foreign or said[1], named or said[2], content or said[3]
        elif name == "role" and value.lower() in ROLES:
            return "region"
        elif name == "aria-hidden" and value.lower() == "true":
            return "region"
        elif name == "style" and re.search(r"display\s*:\s*none|visibility\s*:\s*hidden", value, re.I):
            return "region"
    if re.search(r"(?:^|\s)hidden(?=[\s/>]|$)", re.sub(r"\"[^\"]*\"|'[^']*'", "", attributes)):
        return "region"
    if foreign:
        return "foreign"
    if tag in ("article", "main"):
        return ""
    if content or (words & REGION_WORDS <= {"header", "banner"} and words & ARTICLE_WORDS):
        named = False
    return "region" if named else ""


def blocks_of(page: str) -> list[Block]:
    """The blocks of a page in order; the text has one space for each run of
    white space and decoded character references."""
    out: list[Block] = []
    parts: list[str] = []
    link_parts: list[str] = []
    stack: list[tuple[str, str, bool]] = []     # tag, region, in article
    region, article, in_link, own, opened = "", False, 0, "", ""

    def flush() -> None:
        nonlocal own, opened
        if parts:
            text = _SPACE.sub(" ", _html.unescape("".join(parts))).strip()
            if text:
                links = len(_SPACE.sub(" ", _html.unescape("".join(link_parts))).strip())
                out.append(Block(text, links, bool(region or own), article, opened))
            parts.clear()
            link_parts.clear()
        own = opened = ""

    def add(text: str) -> None:
        if text:
            parts.append(text)
            if in_link:
                link_parts.append(text)

    at, end = 0, len(page)
    while at < end:
        m = _TOKEN.search(page, at)
        if m is None:
            add(page[at:])
            break
        add(page[at:m.start()])
        at = m.end()
        if m[2] is None:
            continue
        tag, closing = m[2].lower(), bool(m[1])
        if tag in RAW and not closing:
            stop = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(page, at)
            at = stop.end() if stop else end
            continue
        if tag == "a":
            in_link = 0 if closing else 1
        if tag == "br":
            add(" ")
        if tag in BLOCKS:
            flush()
        if tag in VOID:
            continue
        if tag in CONTAINERS:
            if closing:
                if any(s[0] == tag for s in stack):
                    while stack.pop()[0] != tag:
                        pass
                    flush()
                    region, article = (stack[-1][1], stack[-1][2]) if stack else ("", False)
            else:
                mine = _region(tag, m[3][:-1])
                if tag == "header" and not article:
                    mine = mine or "region"
                if tag in ("article", "main") and not mine and region != "foreign":
                    region, article = "", True
                elif mine == "foreign" or not region:
                    if mine:
                        flush()
                    region = mine or region
                stack.append((tag, region, article))
        elif tag in BLOCKS and not closing:
            own, opened = _region(tag, m[3][:-1]), tag
    flush()
    return out


def stop_density(text: str) -> float:
    words = _WORD.findall(text.lower())
    return sum(w in STOP_WORDS for w in words) / len(words) if words else 0.0


def text_length(text: str) -> int:
    return len(text) if text.isascii() else len(text) + (WIDE - 1) * len(_WIDE.findall(text))


def foreign_letters(text: str) -> bool:
    """Whether a text has letters that no language with stop words has."""
    if text.isascii():
        return False
    low = text.lower()
    return len(_FOREIGN_LETTER.findall(low)) > FOREIGN_LETTERS * len(_LETTER.findall(low))


def _linked(blocks: list[Block]) -> list[bool]:
    """Whether each block is mostly links and counts as such: inside the
    article a heading does not, nor a paragraph that stands alone among
    blocks of text; lists, and runs of linked paragraphs, do."""
    dense = [b.links > MAX_LINKS * max(len(b.text), 1) for b in blocks]

    def spared(i: int) -> bool:
        if not blocks[i].article or blocks[i].tag not in HEADINGS | {"p"}:
            return False
        return blocks[i].tag in HEADINGS or not any(
            0 <= j < len(blocks) and dense[j] and blocks[j].article and blocks[j].tag not in HEADINGS for j in (i - 1, i + 1))

    return [d and not spared(i) for i, d in enumerate(dense)]


def classify(blocks: list[Block]) -> list[bool]:
    """Whether each block is main text."""
    has_article = any(b.article and not b.region for b in blocks)
    linked = _linked(blocks)
    label: list[str] = []
    few: list[int] = []         # long blocks of few stop words
    known = 0                   # characters of the others
    for i, b in enumerate(blocks):
        length = text_length(b.text)
        if b.region or (has_article and not b.article) or linked[i]:
            label.append("bad")
        elif b.links > MAX_LINKS * len(b.text):
            label.append("good")                  # a heading or paragraph of the article
        elif length < MIN_LONG:
            label.append("bad" if b.links and not b.article else "open")
        else:
            stops = stop_density(b.text)
            label.append("good" if stops >= MANY_STOPS or (stops >= MIN_STOPS and length >= 2 * MIN_LONG)
                         else "open" if b.article or stops >= MIN_STOPS else "bad")
            if stops < MIN_STOPS:
                few.append(i)
            else:
                known += length
    # their language has no list if the letters say so, or if few blocks of the page have stop words
    unlisted = 2 * known < sum(text_length(blocks[i].text) for i in few)
    for i in few:
        if unlisted or foreign_letters(blocks[i].text):
            label[i] = "good" if blocks[i].links <= MAX_LINKS / 2 * len(blocks[i].text) else "open"
    before: list[str] = []
    last = ""
    for b, kind in zip(blocks, label):
        before.append(last)
        last = kind if kind != "open" and not (has_article and not b.article) else last
    good = [False] * len(blocks)
    after = ""
    for i in range(len(blocks) - 1, -1, -1):
        kind = label[i]
        if kind == "open":
            near = {before[i], after} - {""}
            # inside the article a block without links is text unless proven otherwise
            good[i] = (blocks[i].article and not blocks[i].links) or near == {"good"} or (
                near != {"bad"} and (blocks[i].article or "good" in near or not near))
        else:
            good[i] = kind == "good"
            if not (has_article and not blocks[i].article):
                after = kind
    return good


def main_text(page: str | None) -> str:
    """The main text of one page: good blocks joined by one space."""
    blocks = blocks_of(page or "")
    return " ".join(b.text for b, good in zip(blocks, classify(blocks)) if good)


def extract(pages: DataFrame, html_col: str = "html") -> DataFrame:
    """``pages`` without its html column, with ``text`` (empty if the page has
    none or is null).  Every row gives one row; a column named ``text`` is
    replaced."""
    keep = [c for c in pages.columns if c not in (html_col, "text")]

    @F.pandas_udf("string")
    def run(batch: pd.Series) -> pd.Series:
        return batch.map(main_text)

    return pages.select(*keep, run(F.coalesce(F.col(html_col), F.lit(""))).alias("text"))
