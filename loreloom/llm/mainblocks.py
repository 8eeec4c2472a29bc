"""Main text of web pages: flat text blocks, classified by a small decision tree.

A page is read once into a flat list of text blocks. Each is described by its number of words and the
share of them in links, the same of the blocks before and after it, and by where it stands: in a
region that names itself (navigation, footer, advert, form, comments, ...), in an article, or outside
the article of a page that has one, and in a paragraph or heading or elsewhere. A tree grown on the
labelled table below decides which are text. Where a page names its regions these decide; in a page
that does not, the words, the links and the neighbours do.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import groups_of_rows

SPACE = re.compile(r"\s+")
NO_TEXT = (
    r"<!--.*?(?:-->|\Z)"
    r"|<(?P<raw>script|style|textarea|title)(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>.*?(?:</(?P=raw)\s*>|\Z)"
)
# A comment, an element of raw text (without an end tag it goes to the page's end), a declaration, or a tag.
MARKUP = re.compile(
    NO_TEXT +
    r"|<[!?][^>]*(?:>|\Z)"
    r"|<(?P<end>/?)(?P<name>[a-zA-Z][^\s/>]*)(?P<attrs>(?:[^>\"']|\"[^\"]*\"|'[^']*')*+)>"
    r"|<(?P<end2>/?)(?P<name2>[a-zA-Z][^\s/>]*)(?P<attrs2>[^>]*)(?:>|\Z)",
    re.S | re.I,
)
# Elements that are left out with all they hold; one without an end tag holds nothing.
SKIPPED = set("noscript template svg math iframe object select".split())
SKIPPED_TAG = re.compile(
    NO_TEXT + rf"|<(?P<end>/?)(?P<name>{'|'.join(sorted(SKIPPED))})(?=[\s/>])(?:[^>\"']|\"[^\"]*\"|'[^']*')*+>",
    re.S | re.I,
)
HIDDEN = re.compile(r"display\s*:\s*none|visibility\s*:\s*hidden", re.I)
# One attribute: its name and, if it has one, its value. Nothing inside a value is a name.
ATTRIBUTE = re.compile(r"([^\s=\"'/>]+)(?:\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+)))?")
NAME_PARTS = re.compile(r"[a-z]+|[A-Z][a-z]*|\d+")

INLINE = set(
    "a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt "
    "ruby s samp small span strike strong sub sup time tt u var wbr img picture source".split()
)
VOID = set("area base br col embed hr img input link meta param source track wbr".split())
ASIDE_TAGS = set("nav footer aside form button dialog menu header option fieldset label".split())
ASIDE_NAMES = set(
    "ad ads adv advert adverts advertisement advertising banner breadcrumb breadcrumbs comment "
    "comments consent cookie cookies disqus footer form gdpr header login masthead menu menubar modal "
    "nav navbar navigation newsletter notice notices notification overlay pagination pager popup "
    "promo promoted promotion recommended related respond reply replies search share sharing sidebar "
    "signup skip social sponsor sponsored subscribe tags toolbar widget widgets".split()
)
# Words that say no more than that an element is a part of a page. A joined name puts an element aside
# if it names such a region and nothing else (post-comments), not if it says more (related-work).
PART_NAMES = set(
    "area bar block body bottom box btn button buttons card cell col column container content cta "
    "element entry global group holder icon icons inner item items left link links list main menu "
    "mobile outer page panel post posts primary right row secondary section site slot small strip "
    "text title top unit wrap wrapper".split()
)
MAIN_TAGS = {"article", "main"}
MAIN_NAMES = set("article articlebody entry story post".split())
MAIN_ROLES = {"article", "main"}
ASIDE_ROLES = set("navigation banner contentinfo complementary search form dialog alert menu".split())
KEPT_IN_HEADER = {"h1", "h2", "h3", "h4", "h5", "h6"}
PROSE_TAGS = {*KEPT_IN_HEADER, "p", "blockquote", "pre", "dd"}

FEATURES = (
    "words", "links", "words_before", "links_before", "words_after", "links_after", "aside",
    "in_main", "outside", "prose",
)
# Labelled blocks: the features in the order above, then 1 for main text. Fixed values.
LABELLED = """
8 0.00 0 0.00 45 0.00 0 1 0 1 1
45 0.00 8 0.00 60 0.00 0 1 0 1 1
60 0.05 45 0.00 2 0.00 0 1 0 1 1
2 0.00 60 0.05 33 0.00 0 1 0 1 1
1 0.00 33 0.00 12 1.00 0 1 0 0 1
33 0.10 2 0.00 1 0.00 0 1 0 1 1
120 0.02 6 0.00 80 0.00 0 1 0 1 1
6 1.00 80 0.00 40 0.00 0 1 0 1 1
5 0.00 0 0.00 0 0.00 0 1 0 1 1
14 0.00 1 1.00 9 0.00 0 1 0 0 1
3 0.60 20 0.00 70 0.00 0 1 0 1 1
1 0.00 0 0.00 3 0.00 0 1 0 1 1
3 0.00 1 0.00 2 0.00 0 1 0 1 1
2 0.00 3 0.00 0 0.00 0 1 0 1 1
4 0.00 2 0.00 5 0.00 0 1 0 0 1
2 0.50 4 0.00 3 0.30 0 1 0 0 1
3 1.00 2 1.00 4 1.00 0 1 0 0 1
6 0.00 3 0.00 7 0.00 0 1 0 1 1
7 0.00 6 0.00 2 0.00 0 1 0 1 1
5 1.00 7 0.00 4 1.00 0 1 0 1 1
9 0.00 1 1.00 8 0.00 0 1 0 1 1
12 0.00 2 1.00 1 1.00 0 1 0 0 1
20 0.80 6 1.00 5 0.00 0 1 0 1 1
4 0.00 30 0.00 0 0.00 0 1 0 1 1
8 0.00 2 0.00 2 0.00 0 1 0 0 1
25 0.00 10 0.00 6 1.00 1 1 0 0 0
12 0.00 40 0.00 30 0.00 1 1 0 1 0
4 1.00 50 0.00 3 1.00 1 1 0 1 0
60 0.00 30 0.00 55 0.00 1 1 0 1 0
90 0.03 60 0.00 20 0.00 1 1 0 1 0
1 1.00 0 0.00 1 1.00 1 0 1 0 0
1 1.00 1 1.00 1 1.00 1 0 1 0 0
9 0.00 1 1.00 8 0.00 1 0 1 0 0
40 0.00 7 0.00 8 0.00 1 0 1 0 0
70 0.00 30 0.00 12 0.00 1 0 1 0 0
7 0.30 45 0.00 0 0.00 1 0 1 0 0
12 0.00 60 0.00 0 0.00 1 0 1 0 0
9 0.00 1 1.00 8 0.00 0 0 1 1 0
40 0.00 7 0.00 8 0.00 0 0 1 1 0
25 0.00 60 0.00 0 0.00 0 0 1 1 0
3 1.00 0 0.00 3 1.00 0 0 1 0 0
100 0.00 50 0.00 4 0.00 0 0 1 1 0
2 0.00 3 0.00 2 0.00 0 0 1 0 0
45 0.00 6 0.00 50 0.00 0 0 0 1 1
50 0.04 45 0.00 30 0.10 0 0 0 1 1
30 0.10 50 0.04 20 0.00 0 0 0 0 1
20 0.00 30 0.10 3 1.00 0 0 0 1 1
25 0.20 40 0.00 40 0.00 0 0 0 1 1
18 0.00 60 0.00 2 0.00 0 0 0 0 1
80 0.00 2 1.00 4 1.00 0 0 0 1 1
150 0.30 12 0.00 90 0.00 0 0 0 0 1
7 0.00 0 0.00 45 0.00 0 0 0 1 1
4 0.00 50 0.00 60 0.00 0 0 0 1 1
6 0.00 35 0.00 42 0.10 0 0 0 1 1
3 0.00 70 0.00 28 0.00 0 0 0 1 1
2 1.00 2 1.00 2 1.00 0 0 0 0 0
1 1.00 0 0.00 3 1.00 0 0 0 0 0
3 1.00 2 1.00 50 0.00 0 0 0 0 0
4 1.00 60 0.00 3 1.00 0 0 0 0 0
25 0.90 4 1.00 30 0.80 0 0 0 1 0
40 0.70 20 0.90 10 1.00 0 0 0 1 0
16 0.60 45 0.00 20 0.80 0 0 0 0 0
3 0.00 3 0.00 2 0.00 0 0 0 0 0
5 0.00 30 0.90 4 1.00 0 0 0 0 0
4 0.00 2 1.00 3 1.00 0 0 0 0 0
6 0.00 5 0.00 0 0.00 0 0 0 0 0
2 0.00 0 0.00 1 1.00 0 0 0 0 0
60 0.00 20 0.00 45 0.00 1 0 0 0 0
14 0.00 0 0.00 6 1.00 1 0 0 0 0
30 0.10 40 0.00 3 0.00 1 0 0 0 0
3 1.00 4 1.00 3 1.00 1 0 0 0 0
9 0.00 2 0.00 0 0.00 0 0 0 1 1
2 0.00 0 0.00 9 0.00 0 0 0 1 1
5 0.00 4 0.00 3 0.00 0 0 0 1 1
12 0.00 1 1.00 11 0.00 0 0 0 1 1
4 1.00 3 1.00 5 1.00 0 0 0 1 0
6 1.00 30 0.00 8 0.80 0 0 0 1 0
2 0.00 9 0.00 1 0.00 0 0 0 0 0
8 0.00 1 1.00 12 0.00 1 0 0 1 0
30 0.00 9 0.00 4 0.00 0 0 0 1 1
10 0.00 30 0.00 2 1.00 0 0 0 1 1
3 0.00 0 0.00 3 0.00 0 0 0 1 1
7 0.10 3 0.00 6 0.00 0 0 0 1 1
1 0.00 4 0.00 1 0.00 0 0 0 1 1
8 0.00 2 1.00 1 0.00 0 0 0 1 1
3 1.00 1 0.00 8 0.00 0 0 0 0 0
2 1.00 3 1.00 1 0.00 0 0 0 0 0
2 1.00 40 0.00 30 0.00 0 0 0 0 0
9 0.60 3 1.00 3 1.00 0 0 0 0 0
2 0.00 3 1.00 1 0.00 0 0 0 0 0
2 0.00 7 0.00 0 0.00 0 0 0 0 0
5 0.00 2 1.00 4 0.00 0 0 0 0 0
7 0.00 3 0.00 2 0.00 0 0 0 0 0
4 0.00 60 0.00 0 0.00 0 0 0 0 0
40 0.00 3 1.00 60 0.00 0 0 0 0 1
22 0.00 4 0.00 2 0.00 0 0 0 0 1
35 0.00 22 0.00 3 1.00 0 0 0 0 1
70 0.10 1 0.00 1 0.00 0 0 0 0 1
5 1.00 9 0.00 10 0.00 0 0 0 1 0
12 0.90 3 0.00 3 1.00 0 0 0 1 0
8 0.00 4 0.00 5 0.00 0 0 1 1 0
35 0.00 20 0.00 12 0.00 0 0 1 0 0
3 0.00 40 0.00 8 0.00 0 0 1 1 0
60 0.00 3 1.00 25 0.00 0 0 1 1 0
"""


def grow(rows: np.ndarray, labels: np.ndarray, least: int = 2) -> tuple:
    """A tree of (feature, threshold, below, above) by Gini impurity; leaves are True or False."""
    share = labels.mean()
    if share in (0.0, 1.0) or len(labels) < least:
        return bool(share >= 0.5)
    best = None
    for feature in range(rows.shape[1]):
        values = np.unique(rows[:, feature])
        for cut in (values[:-1] + values[1:]) / 2:
            low = rows[:, feature] <= cut
            cost = sum(
                len(part) * 2 * part.mean() * (1 - part.mean()) for part in (labels[low], labels[~low])
            )
            if best is None or cost < best[0] - 1e-9:
                best = (cost, feature, float(cut), low)
    if best is None:
        return bool(share >= 0.5)
    _, feature, cut, low = best
    return feature, cut, grow(rows[low], labels[low], least), grow(rows[~low], labels[~low], least)


@lru_cache(maxsize=1)
def block_tree() -> tuple:
    table = np.array([[float(x) for x in line.split()] for line in LABELLED.split("\n") if line])
    return grow(table[:, :-1], table[:, -1])


def decide(tree: tuple | bool, rows: np.ndarray) -> np.ndarray:
    """The tree's answer for each row."""
    if isinstance(tree, bool):
        return np.full(len(rows), tree)
    feature, cut, below, above = tree
    low = rows[:, feature] <= cut
    out = np.zeros(len(rows), dtype=bool)
    out[low] = decide(below, rows[low])
    out[~low] = decide(above, rows[~low])
    return out


def _self_closed(name: str, tag: str) -> bool:
    return name in ("svg", "math") and tag.endswith("/>")


def _skipped_ends(page: str) -> dict[int, int]:
    """Where each of the SKIPPED elements that have an end tag ends, by where it starts."""
    ends: dict[int, int] = {}
    opened: dict[str, list[int]] = {name: [] for name in SKIPPED}
    for found in SKIPPED_TAG.finditer(page):
        if not found["name"]:
            continue
        name = found["name"].lower()
        if not found["end"]:
            if not _self_closed(name, found[0]):
                opened[name].append(found.start())
        elif opened[name]:
            ends[opened[name].pop()] = found.end()
    return ends


def _region(name: str, attrs: str) -> tuple[bool, bool, bool]:
    """Whether an element is a region beside the text, whether it holds the article, and whether
    nothing but its class or id says that it is beside the text."""
    aside, main, named = name in ASIDE_TAGS, name in MAIN_TAGS, False
    if attrs:
        for key, *values in ATTRIBUTE.findall(attrs):
            key, value = key.lower(), "".join(values)
            if key == "hidden":
                aside = True
            elif key in ("class", "id"):
                for word in value.split():
                    parts = {p.lower() for p in NAME_PARTS.findall(word) if not p.isdigit()}
                    region = word.lower() in ASIDE_NAMES or (
                        bool(parts & ASIDE_NAMES) and parts <= ASIDE_NAMES | PART_NAMES
                    )
                    named |= region and name not in KEPT_IN_HEADER
                    main |= word.lower().replace("-", "") in MAIN_NAMES
            elif key == "role":
                aside |= value.lower() in ASIDE_ROLES
                main |= value.lower() in MAIN_ROLES
            elif key == "itemprop":
                main |= value.lower() == "articlebody"
            elif (key == "aria-hidden" and value == "true") or (key == "style" and HIDDEN.search(value)):
                aside = True
    if main and name in MAIN_TAGS:
        return False, True, False
    return aside or named, main, named and not aside


def blocks(page: str) -> list[tuple[str, int, int, bool, bool, bool]]:
    """(text, words, words in links, aside, in an article, prose) of each text block of a page.

    A class or id around an article or main element does not put it aside, unless another article of
    the page stands in fewer elements with such names (the teasers of a sidebar).
    """
    out: list[tuple[str, int, int, bool, bool, bool]] = []
    around: list[int | None] = []  # per block: aside names around its outermost article, none outside
    stack: list[tuple[str, bool, bool, bool]] = []  # open elements: name, aside, main, named
    article: tuple[int, int, int] | None = None  # outermost: place in stack, names around it, as counted
    skipped: dict[int, int] | None = None
    parts: list[str] = []
    linked: list[str] = []
    in_link = False
    aside = main = 0
    heading = False
    kind = ""  # the element that the text stands in

    def close() -> None:
        if parts:
            text = SPACE.sub(" ", "".join(parts)).strip()
            if text:
                beside = aside - (article[1] if article else 0)
                only_header = beside == 1 and main and heading and any(
                    n == "header" and a for n, a, *_ in stack
                )
                words = len(text.split())
                links = len("".join(linked).split())
                beside_text = beside > 0 and not only_header
                out.append((text, words, min(links, words), beside_text, main > 0, kind in PROSE_TAGS))
                around.append(article[2] if article else None)
            parts.clear()
            linked.clear()

    def shut(depth: int) -> None:
        nonlocal aside, main, article
        for _, was_aside, was_main, _ in stack[depth:]:
            aside -= was_aside
            main -= was_main
        del stack[depth:]
        if article and depth <= article[0]:
            article = None

    def add(raw: str) -> None:
        text = html.unescape(raw) if "&" in raw else raw
        parts.append(text)
        if in_link:
            linked.append(text)

    at = 0
    while found := MARKUP.search(page, at):
        if found.start() > at:
            add(page[at : found.start()])
        at = found.end()
        name = found["name"] or found["name2"]
        if name is None:
            if found["raw"] and found["raw"].lower() == "textarea":
                close()
            continue
        name = name.lower()
        ending = bool(found["end"] or found["end2"])
        if name in SKIPPED:
            if name == "select":
                close()
            if not ending and not _self_closed(name, found[0]):
                skipped = _skipped_ends(page) if skipped is None else skipped
                at = skipped.get(found.start(), at)
            continue
        if name == "a":
            in_link = not ending
            if in_link and linked:
                linked.append(" ")
            continue
        if name == "br":
            parts.append(" ")
            continue
        if name in INLINE and name != "label":
            if not ending and name not in VOID:
                attrs = found["attrs"] or found["attrs2"] or ""
                if "hidden" in attrs or "none" in attrs:
                    region = _region(name, attrs)
                    if region[0]:
                        close()
                        stack.append((name, True, False, False))
                        aside += 1
            elif ending and stack and stack[-1][0] == name:
                close()
                shut(len(stack) - 1)
            continue
        close()
        if not ending and stack and stack[-1][0] == "option":
            shut(len(stack) - 1)
        if ending:
            in_link = False
            heading = False
            depth = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][0] == name), None)
            if depth is not None:
                shut(depth)
            kind = stack[-1][0] if stack else ""
            continue
        heading = name in KEPT_IN_HEADER
        kind = name
        if name in VOID or name in ("p", "li", "dt", "dd", "tr", "td", "th", "html", "head", "body"):
            region = _region(name, found["attrs"] or found["attrs2"] or "")
            if not region[0] or name in VOID or name in ("html", "head", "body"):
                # An element that need not be closed ends one of its kind; it opens no region.
                if stack and stack[-1][0] == name:
                    shut(len(stack) - 1)
                continue
            if stack and stack[-1][0] == name:
                shut(len(stack) - 1)
        else:
            region = _region(name, found["attrs"] or found["attrs2"] or "")
        if name in MAIN_TAGS and not article:
            names = sum(entry[3] for entry in stack)
            article = len(stack), names, 0 if name == "main" else names
        stack.append((name, *region))
        aside += region[0]
        main += region[1]
    if at < len(page):
        add(page[at:])
    close()
    least = min((n for n, b in zip(around, out, strict=True) if n is not None and not b[3]), default=0)
    return [
        (*b[:3], b[3] or (n is not None and n > least), *b[4:]) for n, b in zip(around, out, strict=True)
    ]


def described(found: list[tuple[str, int, int, bool, bool, bool]]) -> np.ndarray:
    """The features of a page's blocks."""
    rows = np.zeros((len(found), len(FEATURES)))
    if not found:
        return rows
    words = np.array([b[1] for b in found], dtype=float)
    links = np.array([b[2] for b in found], dtype=float) / words
    rows[:, 0], rows[:, 1] = words, links
    rows[1:, 2], rows[1:, 3] = words[:-1], links[:-1]
    rows[:-1, 4], rows[:-1, 5] = words[1:], links[1:]
    rows[:, 6] = [b[3] for b in found]
    rows[:, 7] = [b[4] for b in found]
    has_main = any(b[4] for b in found)
    rows[:, 8] = [has_main and not b[4] for b in found]
    rows[:, 9] = [b[5] for b in found]
    return rows


def main_texts(pages: list[str | None]) -> list[str]:
    """The blocks of main text of each page, in order, one per line."""
    lists = [blocks(page or "") for page in pages]
    rows = np.concatenate([described(found) for found in lists]) if lists else np.zeros((0, len(FEATURES)))
    keep = decide(block_tree(), rows)
    out, at = [], 0
    for found in lists:
        out.append("\n".join(b[0] for b, k in zip(found, keep[at : at + len(found)], strict=True) if k))
        at += len(found)
    return out


def extract_main_text(pages: DataFrame, page: str = "html", out: str = "text") -> DataFrame:
    """All columns of `pages` but the page itself, with its main text in `out`.

    A null or empty page, and one without text, gives the empty string; every row gives one row,
    repeated ones too; an empty table gives an empty table. A column called like `out` is replaced.
    """
    names = [c for c in pages.columns if c not in (page, out)]
    columns = [F.col(f"`{c}`") for c in names]
    source = pages.select(*columns, F.col(f"`{page}`").alias("__page"))
    schema = pages.select(*columns).schema.add(out, "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups_of_rows(batches, "__page"):
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(main_texts(texts), pa.string())], names=[*names, out]
            )

    return source.mapInArrow(run, schema)
