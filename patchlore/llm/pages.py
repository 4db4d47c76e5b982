"""Main text of web pages (operator 1).

A page is flattened into text blocks in page order. Each block is described by
its word count and link density, those of its neighbours, and what its enclosing
tags say; a decision tree trained on the labelled blocks below tells content
from the rest. Pages are independent, so the work is one Arrow map over the scan.

Defined results: null or empty html gives the empty text; comments and
raw-text elements that never close run to the end of the page, other elements
without text of the page hide only what lies before their own end tag; repeated rows are extracted once each;
whole pages of any length are read; further columns are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from html import unescape

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from patchlore.llm.registry import query, table
from patchlore.llm.tokens import text_slices
from patchlore.llm.tree import Tree, train_tree

# Elements whose inside is never text of the page. Markup inside RAW is not markup and ends with the page at the latest;
# HIDDEN hide what lies before their end tag, without one only the tag itself. The head needs no rule: what it
# may hold is in one of these or void, and anything else begins the body, also where its tags are omitted.
RAW = set("script style textarea title".split())
HIDDEN = set("noscript template svg math canvas audio video object iframe select datalist map".split())
FOREIGN = set("svg math".split())   # here '/>' closes an element
# Elements that end the block before and after them.
BLOCK = set("address article aside blockquote body br button caption center dd details dialog dir div dl dt fieldset figcaption figure footer form h1 h2 h3 h4 h5 h6 header hgroup hr html label legend li main menu nav ol option output p pre search section summary table tbody td tfoot th thead tr ul".split())
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
HEADINGS = set("h1 h2 h3 h4 h5 h6".split())
# Elements that are page furniture by their name or role.
FURNITURE_TAGS = set("nav header footer aside form dialog menu button fieldset search".split())
FURNITURE_ROLES = set("navigation banner contentinfo complementary search form dialog alert alertdialog menu menubar toolbar status".split())
# Words in class and id values that mark furniture; compared with the words of the value.
FURNITURE_WORDS = set(
    "ad ads adv advert adverts advertisement advertising advertorial sponsor sponsored sponsors promo promos promotion promoted banner banners teaser "
    "nav navbar navigation menu menus breadcrumb breadcrumbs crumb crumbs pagination pager toc "
    "header masthead topbar toolbar footer foot copyright colophon legal "
    "sidebar sidebars side rail aside widget widgets related recommended recommendations more trending popular "
    "notice notices notification notifications alert alerts cookie cookies consent gdpr disclaimer warning popup modal overlay lightbox paywall "
    "comment comments commentlist commenter disqus reply replies respond responses discussion feedback "
    "share sharing social follow newsletter subscribe subscription signup login signin register search form skip hidden".split())
FURNITURE_STEMS = re.compile(r"cookie|comment|sidebar|advert|sponsor|newsletter|breadcrumb|promo|notif|recommend|subscri|footer|consent|navig|social|popup|disclaimer")
# Articles of others: a list of these is no wrapper around the article of the page.
OTHER_ARTICLES = set("comment comments commentlist reply replies responses discussion related recommended recommendations popular trending teaser promo promos sponsored".split())
STATES = ("has-", "no-", "with-", "without-", "has_", "no_", "with_", "without_")
ARTICLE_TAGS = set("article main".split())
ARTICLE_WORDS = set("article post story entry content main body text".split())

TOKEN = re.compile(
    r"<!--.*?(?:-->|\Z)"
    r"|<!\[CDATA\[.*?(?:\]\]>|\Z)"
    r"|<(?P<end>/?)(?P<tag>[a-zA-Z][a-zA-Z0-9:-]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*)>"
    r"|<[!?/][^>]*>", re.S | re.I)
RAW_END = {t: re.compile(rf"</{t}(?=[\s/>])[^>]*>", re.I) for t in RAW}
FOREIGN_END = re.compile(r"</(?:svg|math)(?=[\s/>])", re.I)
ATTR = re.compile(r"\b(class|id|role|hidden|aria-hidden|style)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?", re.I)
WORDS = re.compile(r"[A-Za-z][a-z]*|[A-Z]+")


@dataclass
class Block:
    text: str
    words: int
    linked: int      # words inside links
    furniture: int   # inside a furniture element
    article: int     # inside an article element
    heading: int
    list_item: int


def furniture_names(values: list[str], known_article: bool) -> tuple[set[str], bool]:
    """Words that mark an element as furniture, and whether a name of it is that of an article.

    A name that begins with has, no, with or without tells what else the page has. Beside the name of an
    article (or on an article element) only names that begin with a furniture word count: ``post category-social``
    is a post, ``comment-body content`` a comment.
    """
    names = [[w.lower() for w in WORDS.findall(name)] for v in values for name in v.split() if not name.lower().startswith(STATES)]
    marks = [{w for w in n if w in FURNITURE_WORDS or FURNITURE_STEMS.match(w)} for n in names]
    article = any(ARTICLE_WORDS & set(n) and not m for n, m in zip(names, marks, strict=True))
    marked = {w for n, m in zip(names, marks, strict=True) if n and (n[0] in m or not (known_article or article)) for w in m}
    return marked, article or any(ARTICLE_WORDS & set(n) for n in names)


@lru_cache(maxsize=1 << 12)
def role_of(tag: str, attrs: str, in_article: bool) -> tuple[bool, bool, bool]:
    """Is the element furniture, is it an article, may an article inside show that it is only a wrapper?"""
    values: list[str] = []
    for key, a, b, c in ATTR.findall(attrs) if attrs else ():
        key, value = key.lower(), a or b or c
        if key in ("class", "id"):
            values.append(value)
        elif key == "role" and value.lower() in FURNITURE_ROLES:
            return True, False, False
        elif key == "hidden" or key == "aria-hidden" and value.lower() == "true" or key == "style" and re.search(r"display\s*:\s*none", value, re.I):
            return True, False, False
    if tag in ("body", "html"):
        return False, False, False
    marked, named_article = furniture_names(values, tag in ARTICLE_TAGS)
    if tag in ARTICLE_TAGS:
        return bool(marked & OTHER_ARTICLES), True, False
    if values and tag not in HEADINGS:
        headline = marked <= {"header", "masthead"} and (in_article or named_article)  # a post-header is part of the post
        if marked and not headline:
            return True, False, not marked & OTHER_ARTICLES and tag not in FURNITURE_TAGS - {"form"}
        if named_article:
            return tag in FURNITURE_TAGS and tag != "header", True, tag == "form"
    # A header inside an article carries its headline.
    return tag in FURNITURE_TAGS and not (tag == "header" and in_article), False, tag == "form"


def tags_of(html: str) -> list[tuple[int, int, str, bool, str]]:
    """Start, end, name, is it an end tag and attributes of each tag in order; what is no text of the page is one entry, without a name unless it is a title."""
    found: list[tuple[int, int, str, bool, str]] = []
    unclosed: list[tuple[str, int]] = []   # hidden element, its place in ``found``
    count: Counter[str] = Counter()
    endless: set[str] = set()              # raw elements without any further end tag
    at = 0
    while m := TOKEN.search(html, at):
        start, at = m.span()
        tag, attrs = (m["tag"] or "").lower(), m["attrs"] or ""
        if attrs and not (attrs[0].isspace() or attrs[0] == "/") or tag not in RAW and tag not in HIDDEN:
            found.append((start, at, tag, bool(m["end"]), attrs))
        elif m["end"]:
            if count[tag]:
                while True:
                    name, i = unclosed.pop()
                    count[name] -= 1
                    if name == tag:
                        break
                start = found[i][0]
                del found[i:]
            found.append((start, at, "", True, ""))
        elif tag in HIDDEN:
            if not (tag in FOREIGN and attrs.endswith("/")):
                unclosed.append((tag, len(found)))
                count[tag] += 1
            found.append((start, at, "", False, ""))
        else:
            inside = count["svg"] + count["math"] > 0
            if not (inside and attrs.endswith("/")):
                end = None if tag in endless else RAW_END[tag].search(html, at)
                if end is None:
                    endless.add(tag)
                    at = at if inside else len(html)
                elif not (inside and FOREIGN_END.search(html, at, end.start())):
                    at = end.end()
            found.append((start, at, tag if tag == "title" else "", False, ""))
    return found


def blocks_of(html: str) -> list[Block]:
    """Text blocks of a page in order, white space collapsed, character references decoded."""
    blocks: list[Block] = []
    open_: list[tuple[str, bool, bool]] = []   # element, furniture, article
    wrappers: list[int] = []                   # places in it of furniture that may be a wrapper
    met = False                                # the article of the page has begun
    furniture = article = links = heading = items = 0
    parts: list[str] = []
    linked: list[str] = []

    def flush() -> None:
        if parts:
            words = "".join(parts).split()
            if words:
                blocks.append(Block(" ".join(words), len(words), len("".join(linked).split()), int(furniture > 0), int(article > 0), int(heading > 0), int(items > 0)))
            parts.clear()
            linked.clear()

    def text(raw: str) -> None:
        raw = unescape(raw) if "&" in raw else raw
        parts.append(raw)
        if links:
            linked.append(raw)

    def leave(entry: tuple[str, bool, bool]) -> None:
        nonlocal furniture, article, links, heading, items
        tag, was_furniture, was_article = entry
        furniture -= was_furniture
        article -= was_article
        links -= tag == "a"
        heading -= tag in HEADINGS
        items -= tag == "li"

    at = 0
    for start, end, tag, closing, attrs in tags_of(html):
        if start > at:
            text(html[at:start])
        at = end
        if tag in ("head", "title"):
            flush()
        if tag in ("", "head", "title"):
            continue
        if tag in BLOCK:
            flush()
        if closing:
            # Close the innermost such element and all that it left open; paragraphs and inline tags never close an outer container.
            for i in range(len(open_) - 1, -1, -1):
                if open_[i][0] == tag:
                    for entry in open_[i:]:
                        leave(entry)
                    del open_[i:]
                    break
                if tag not in CONTAINERS and open_[i][0] in CONTAINERS:
                    break
        elif tag not in VOID and not attrs.endswith("/"):
            if tag in CLOSES:
                stop = CLOSES[tag]
                for i in range(len(open_) - 1, -1, -1):
                    if open_[i][0] in stop:
                        for entry in open_[i:]:
                            leave(entry)
                        del open_[i:]
                        break
                    if open_[i][0] in CONTAINERS:
                        break
            f, a, soft = role_of(tag, attrs, article > 0)
            while wrappers and wrappers[-1] >= len(open_):
                wrappers.pop()
            if a and not f and not met and tag in ARTICLE_TAGS:
                if furniture == len(wrappers):   # nothing else around it
                    met = True
                    for i in wrappers:
                        open_[i] = (open_[i][0], False, open_[i][2])
                    furniture = 0
                    wrappers.clear()
            if f and soft:
                wrappers.append(len(open_))
            open_.append((tag, f, a))
            furniture += f
            article += a
            links += tag == "a"
            heading += tag in HEADINGS
            items += tag == "li"
    if at < len(html):
        text(html[at:])
    flush()
    return blocks


CONTAINERS = set("html body article main section div nav header footer aside form table tr td th ul ol dl blockquote figure dialog menu details fieldset".split())
# A new such element ends an open one of these kinds.
CLOSES = {t: {"p"} for t in BLOCK - {"br"}} | {"li": {"li", "p"}, "dt": {"dt", "dd", "p"}, "dd": {"dt", "dd", "p"}, "tr": {"tr", "td", "th", "p"}, "td": {"td", "th", "p"}, "th": {"td", "th", "p"}, "option": {"option"}}

FEATURES = ["words", "density", "prev_words", "prev_density", "next_words", "next_density", "furniture", "article", "page_article", "heading", "list_item"]


def features(blocks: list[Block]) -> np.ndarray:
    n = len(blocks)
    words = np.array([b.words for b in blocks], dtype=np.float64)
    density = np.array([b.linked for b in blocks], dtype=np.float64) / np.maximum(words, 1)
    x = np.zeros((n, len(FEATURES)))
    x[:, 0], x[:, 1] = words, density
    x[1:, 2], x[1:, 3] = words[:-1], density[:-1]
    x[:-1, 4], x[:-1, 5] = words[1:], density[1:]
    for k, name in ((6, "furniture"), (7, "article"), (9, "heading"), (10, "list_item")):
        x[:, k] = [getattr(b, name) for b in blocks]
    x[:, 8] = float(any(b.article and not b.furniture for b in blocks))
    return x


# Labelled blocks: the features in the order of FEATURES, then 1 for content. Written for this
# table from typical page layouts: furniture around an article, pages without any article
# element (told by words and links), and headings, lists and short closing lines in each.
LABELLED = [
    (6, 1.0, 0, 0.0, 4, 1.0, 1, 0, 1, 0, 1, 0), (1, 1.0, 1, 1.0, 1, 1.0, 1, 0, 1, 0, 1, 0), (2, 1.0, 1, 1.0, 12, 0.0, 1, 0, 1, 0, 1, 0),
    (12, 0.0, 1, 1.0, 8, 0.0, 1, 0, 1, 0, 0, 0), (60, 0.0, 1, 1.0, 8, 0.0, 1, 0, 1, 0, 0, 0), (9, 0.2, 70, 0.0, 0, 0.0, 1, 0, 1, 0, 0, 0),
    (8, 0.0, 12, 0.0, 40, 0.0, 0, 1, 1, 1, 0, 1), (40, 0.0, 8, 0.0, 75, 0.0, 0, 1, 1, 0, 0, 1), (1, 0.0, 40, 0.0, 9, 0.0, 0, 1, 1, 0, 0, 1),
    (75, 0.1, 40, 0.0, 3, 0.0, 0, 1, 1, 0, 0, 1), (3, 0.0, 75, 0.0, 9, 0.2, 0, 1, 1, 0, 0, 1), (5, 1.0, 40, 0.0, 60, 0.0, 0, 1, 1, 0, 0, 1),
    (7, 0.0, 30, 0.0, 6, 0.0, 0, 1, 1, 0, 1, 1), (4, 1.0, 5, 1.0, 6, 1.0, 0, 1, 1, 0, 1, 1), (5, 0.0, 60, 0.0, 50, 0.0, 0, 1, 1, 1, 0, 1),
    (35, 0.0, 30, 0.0, 9, 0.0, 1, 1, 1, 0, 0, 0), (20, 0.0, 35, 0.0, 9, 0.1, 1, 1, 1, 0, 0, 0), (3, 0.0, 80, 0.0, 20, 0.0, 1, 1, 1, 1, 0, 0),
    (4, 1.0, 80, 0.0, 4, 1.0, 1, 1, 1, 0, 1, 0), (90, 0.0, 20, 0.0, 15, 0.0, 1, 1, 1, 0, 0, 0), (6, 0.0, 50, 0.0, 5, 0.5, 1, 1, 1, 0, 0, 0),
    (6, 0.0, 0, 0.0, 5, 1.0, 0, 0, 1, 0, 0, 0), (30, 0.0, 5, 1.0, 10, 0.0, 0, 0, 1, 0, 0, 0), (4, 1.0, 0, 0.0, 4, 1.0, 0, 0, 1, 0, 0, 0),
    (15, 0.0, 60, 0.0, 0, 0.0, 0, 0, 1, 0, 0, 0), (5, 0.0, 3, 1.0, 60, 0.0, 0, 0, 1, 1, 0, 0), (100, 0.0, 9, 0.0, 7, 0.0, 0, 0, 1, 0, 0, 0),
    (4, 1.0, 0, 0.0, 3, 1.0, 0, 0, 0, 0, 1, 0), (3, 1.0, 4, 1.0, 5, 1.0, 0, 0, 0, 0, 1, 0), (5, 0.8, 3, 1.0, 2, 1.0, 0, 0, 0, 0, 0, 0),
    (2, 1.0, 0, 0.0, 25, 0.0, 0, 0, 0, 0, 0, 0), (1, 1.0, 9, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0), (6, 1.0, 40, 0.0, 30, 0.0, 0, 0, 0, 0, 0, 0),
    (3, 1.0, 50, 0.0, 5, 1.0, 0, 0, 0, 0, 1, 0), (9, 0.9, 0, 0.0, 45, 0.1, 0, 0, 0, 0, 0, 0), (4, 0.75, 12, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 0),
    (2, 0.0, 5, 1.0, 4, 1.0, 0, 0, 0, 0, 0, 0), (30, 0.7, 4, 1.0, 6, 1.0, 0, 0, 0, 0, 0, 0), (14, 0.5, 60, 0.0, 3, 1.0, 0, 0, 0, 0, 0, 0),
    (25, 0.0, 3, 0.0, 45, 0.0, 0, 0, 0, 0, 0, 1), (45, 0.1, 25, 0.0, 70, 0.05, 0, 0, 0, 0, 0, 1), (70, 0.05, 45, 0.1, 12, 0.0, 0, 0, 0, 0, 0, 1),
    (12, 0.0, 70, 0.05, 30, 0.0, 0, 0, 0, 0, 0, 1), (16, 0.0, 5, 1.0, 5, 1.0, 0, 0, 0, 0, 0, 1), (110, 0.2, 4, 1.0, 2, 0.0, 0, 0, 0, 0, 0, 1),
    (7, 0.0, 2, 1.0, 25, 0.0, 0, 0, 0, 1, 0, 1), (4, 0.0, 70, 0.0, 45, 0.0, 0, 0, 0, 1, 0, 1), (3, 0.0, 5, 1.0, 4, 1.0, 0, 0, 0, 1, 0, 0),
    (4, 0.0, 40, 0.0, 50, 0.0, 0, 0, 0, 0, 0, 1), (2, 0.0, 30, 0.0, 40, 0.0, 0, 0, 0, 0, 0, 1), (3, 0.0, 40, 0.0, 4, 1.0, 0, 0, 0, 0, 0, 0), (7, 0.0, 25, 0.0, 1, 1.0, 0, 0, 0, 0, 0, 1),
    (5, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (80, 0.0, 0, 0.0, 0, 0.0, 0, 0, 0, 0, 0, 1), (12, 0.0, 4, 1.0, 60, 0.0, 1, 0, 0, 0, 0, 0),
    (40, 0.0, 60, 0.0, 5, 0.0, 1, 0, 0, 0, 0, 0), (5, 1.0, 60, 0.0, 6, 1.0, 1, 0, 0, 0, 0, 0), (6, 0.0, 5, 0.0, 60, 0.0, 1, 0, 0, 1, 0, 0),
]


def train() -> Tree:
    rows = np.array(LABELLED, dtype=np.float64)
    return train_tree(rows[:, :-1], rows[:, -1])


def main_text(html: str | None, tree: Tree) -> str:
    blocks = blocks_of(html) if html else []
    if not blocks:
        return ""
    keep = tree.predict(features(blocks)) >= 0.5
    return " ".join(b.text for b, k in zip(blocks, keep, strict=True) if k)


def extract(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """(page_id, url, text, n_chars, n_blocks, n_kept) for every row of ``pages``."""
    tree = train()

    def texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [blocks_of(h) if h else [] for _, part in text_slices(batch.column(2)) for h in part]
            sizes = [len(b) for b in found]
            full = [features(b) for b in found if b]
            keep = tree.predict(np.concatenate(full)) >= 0.5 if full else np.zeros(0, dtype=bool)
            out, kept, at = [], [], 0
            for blocks, n in zip(found, sizes, strict=True):
                own = keep[at:at + n]
                at += n
                out.append(" ".join(b.text for b, k in zip(blocks, own, strict=True) if k))
                kept.append(int(own.sum()))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(out, pa.string()), pa.array([len(t) for t in out], pa.int64()), pa.array(sizes, pa.int64()), pa.array(kept, pa.int64())],
                names=["page_id", "url", "text", "n_chars", "n_blocks", "n_kept"])

    picked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    return picked.mapInArrow(texts, "page_id long, url string, text string, n_chars long, n_blocks long, n_kept long")


@query("op1_html_text")
def op1_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")
