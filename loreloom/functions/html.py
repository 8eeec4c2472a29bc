"""Article text from HTML, in Arrow batches."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

VOID = frozenset(
    "area base br col embed hr img input link meta param source track wbr".split()
)
LINE_TAGS = frozenset("p li h2 h3 h4 br".split())
SKIPPED = frozenset("script style sup".split())


class ArticleParser(HTMLParser):
    """Collects the text below one root element.

    Tags are matched by a stack: void tags open nothing, an end tag closes down to its own start
    tag, and a skipped element ends where it closes, however deeply things are nested in it.
    """

    def __init__(self, root_id: str | None, root_tag: str | None, keep_tables: bool) -> None:
        super().__init__()
        self.root_id, self.root_tag, self.keep_tables = root_id, root_tag, keep_tables
        self.open: list[tuple[str, bool]] = []  # below the root: (tag, skipped)
        self.skipping = 0
        self.lines: list[list[str]] = [[]]  # words, and a bar before each cell of a table

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        given = dict(attrs)
        if not self.open:
            named = self.root_id is not None and given.get("id") == self.root_id
            if (named or tag == self.root_tag) and tag not in VOID:
                self.open.append((tag, False))
            return
        skipped = (
            tag in SKIPPED
            or (tag == "table" and not self.keep_tables)
            or "mw-editsection" in (given.get("class") or "")
        )
        if tag in LINE_TAGS or (self.keep_tables and tag == "tr"):
            self.lines.append([])
        if self.keep_tables and tag in ("td", "th"):
            self.lines[-1].append("|")
        if tag not in VOID:
            self.open.append((tag, skipped))
            self.skipping += skipped

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.handle_starttag(tag, attrs)
        if self.open and tag not in VOID:
            self.handle_endtag(tag)

    def handle_endtag(self, tag: str) -> None:
        if all(tag != name for name, _ in self.open):
            return
        while True:
            name, skipped = self.open.pop()
            self.skipping -= skipped
            if name == tag:
                return

    def handle_data(self, data: str) -> None:
        if not self.open or self.skipping:
            return
        first, *others = data.strip().splitlines() or [""]
        self.lines[-1] += first.split()
        self.lines += [line.split() for line in others]

    def text(self) -> str:
        """The lines that say something; bars stand between cells only."""
        edge = " |" if self.keep_tables else " "
        made = [" ".join(words).strip(edge) for words in self.lines]
        return "\n".join(filter(None, made))


def article_text(
    html: str, root_id: str | None = None, root_tag: str | None = None, keep_tables: bool = False
) -> str:
    parser = ArticleParser(root_id, root_tag, keep_tables)
    parser.feed(html)
    parser.close()
    return parser.text()


def article_text_of(
    html: Column, root_id: str | None = "mw-content-text", root_tag: str | None = None,
    keep_tables: bool = False,
) -> Column:
    """Text column; empty where no article was found."""

    @F.pandas_udf("string")
    def extract(pages: pd.Series) -> pd.Series:
        return pages.map(lambda h: article_text(h or "", root_id, root_tag, keep_tables))

    return extract(html)
