"""Documents to sections. Each document is one row and stays one row: nothing is shuffled.

The lines of a document become an array; the positions of its heading lines cut that array into
slices, and every slice is cleaned and joined into the text of one section.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import fixed
from loreloom.functions import text as tx

SECTION_TYPE = "array<struct<ord:int,section:string,text:string,spoiler_level:string>>"


@dataclass(frozen=True)
class SectionRules:
    """What one family of pages calls a heading, a block to drop, a footer and a spoiler."""

    headings: tuple[str, ...]
    blocked: tuple[str, ...]
    footers: tuple[str, ...]
    spoilers: tuple[str, ...]
    parents: tuple[str, ...] = ()
    block_starts: tuple[str, ...] = ()
    block_ends: tuple[str, ...] = ()
    drop_inline_metadata: bool = False
    spoilers_in_text: bool = False
    blocked_lead_type: str | None = None


WIKI_A = SectionRules(
    headings=tuple(fixed.WIKI_A_HEADINGS),
    blocked=tuple(fixed.WIKI_A_BLOCKED),
    footers=tuple(fixed.WIKI_A_FOOTERS),
    spoilers=tuple(fixed.WIKI_A_SPOILERS),
    parents=tuple(fixed.WIKI_A_PARENTS),
    block_starts=tuple(fixed.WIKI_A_BLOCK_STARTS),
    block_ends=tuple(fixed.WIKI_A_BLOCK_ENDS),
    drop_inline_metadata=True,
    blocked_lead_type="character",
)
WIKI_B = SectionRules(
    headings=tuple(fixed.WIKI_B_HEADINGS),
    blocked=tuple(fixed.WIKI_B_BLOCKED),
    footers=tuple(fixed.WIKI_B_FOOTERS),
    spoilers=tuple(fixed.WIKI_B_SPOILERS),
    spoilers_in_text=True,
)


# Letters beyond ASCII that a pattern without case takes for one of a to z.
ODD_CASE = ["\u017f", "\u0130", "\u0131", "\u212a"]


def only_if(condition: Column, changed: Column, text: Column) -> Column:
    """`changed` where a cheap look says that it may differ from `text`."""
    return F.when(condition, changed).otherwise(text)


def clean_heading(line: Column) -> Column:
    line = only_if(F.contains(line, F.lit("[")), F.regexp_replace(line, r"\[.*?\]", ""), line)
    return F.btrim(F.regexp_replace(line, tx.SPACE + "+", " "), F.lit(" #"))


def is_heading(clean: Column, rules: SectionRules) -> Column:
    return (
        (F.length(clean) <= 80)
        & ~F.endswith(clean, F.lit("."))
        & tx.fold(clean).isin(list(rules.headings))
    )


def clean_line(line: Column, rules: SectionRules) -> Column:
    """Patterns are tried only on lines that hold a part each match has."""
    line = only_if(F.contains(line, F.lit("[")), F.regexp_replace(line, r"(?U)\[ *\d+ *\]", ""), line)
    if rules.block_starts:
        line = tx.let(F.replace(line, F.lit("⁠"), F.lit(" ")), lambda x: _without_blocks(x, rules))
    if rules.drop_inline_metadata:
        line = tx.let(line, _without_metadata)
    return tx.squeeze(line)


def _without_blocks(line: Column, rules: SectionRules) -> Column:
    ends, out = "|".join(rules.block_ends), line
    for start in rules.block_starts:
        out = F.regexp_replace(out, rf"(?iu)\b{start}\b.*?(?=\b(?:{ends})\b|$)", "")
    return only_if(
        tx.contains_any(F.lower(line), [s.lower() for s in rules.block_starts])
        | tx.contains_any(line, ODD_CASE),
        out, line,
    )


def _without_metadata(line: Column) -> Column:
    out = line
    for pattern in (
        r"\bUID\s+[A-Za-z0-9_]+",
        r"\bUUID\s+[A-Fa-f0-9-]{8,}",
        r"\bStats\s+[A-Za-z0-9_]+",
        r"\bEqp\.\s+[A-Za-z0-9_]+",
    ):
        out = F.regexp_replace(out, pattern, "")
    return only_if(tx.contains_any(line, ["UID", "Stats", "Eqp."]), out, line)


def cut_footer(text: Column, footers: tuple[str, ...]) -> Column:
    """Drop everything from the earliest footer marker on."""
    markers = "|".join(re.escape(m) for m in footers)

    def cut(text: Column) -> Column:
        shorter = F.regexp_replace(text, rf"(?s)(?:{markers}).*$", "")
        return only_if(tx.contains_any(text, list(footers)), shorter, text)

    return tx.let(text, cut)


def spoiler_level(text: Column, markers: tuple[str, ...] | list[str]) -> Column:
    return F.when(tx.contains_any(tx.fold(text), list(markers)), "spoiler_heavy").otherwise(
        "standard"
    )


def is_blocked(section: Column, content_type: Column, rules: SectionRules) -> Column:
    parts = F.transform(F.split(tx.fold(section), ">"), tx.strip)
    blocked = F.exists(parts, lambda p: p.isin(list(rules.blocked)))
    if rules.blocked_lead_type:
        blocked = blocked | (
            (content_type == F.lit(rules.blocked_lead_type)) & (section == F.lit("Lead"))
        )
    return blocked


def split_sections(
    raw: DataFrame, rules: SectionRules, text: str = "text_en", content_type: str = "content_type"
) -> DataFrame:
    """Add `sections`, the kept sections of each document in order."""
    lines = F.filter(
        F.transform(F.split(F.col(text), tx.LINE_BREAK), tx.strip), lambda x: x != ""
    )

    def cut(lines: Column) -> Column:
        return tx.let(F.transform(lines, clean_heading), lambda clean: tx.let(
            _cuts(clean, rules), lambda cuts: tx.let(
                _paths(_titles(clean, cuts), rules),
                lambda paths: _bodies(lines, cuts, paths, rules),
            ),
        ))

    kept = F.filter(
        tx.let(lines, cut),
        lambda s: (s["text"] != "") & ~is_blocked(s["section"], F.col(content_type), rules),
    )
    labelled = F.transform(
        kept,
        lambda s, i: F.struct(
            (i + 1).alias("ord"),
            s["section"].alias("section"),
            s["text"].alias("text"),
            spoiler_level(
                F.concat_ws(" ", s["section"], s["text"])
                if rules.spoilers_in_text
                else s["section"],
                rules.spoilers,
            ).alias("spoiler_level"),
        ),
    )
    return raw.withColumn("sections", labelled.cast(SECTION_TYPE))


def _cuts(clean: Column, rules: SectionRules) -> Column:
    """0 for the lead, then the 1-based position of every heading line."""
    positions = F.transform(
        clean, lambda c, i: F.when(is_heading(c, rules), i + 1).otherwise(F.lit(0))
    )
    return F.concat(F.array(F.lit(0)), F.filter(positions, lambda p: p > 0))


def _titles(clean: Column, cuts: Column) -> Column:
    return F.transform(cuts, lambda p: F.when(p == 0, "Lead").otherwise(F.get(clean, p - 1)))


def _bodies(lines: Column, cuts: Column, paths: Column, rules: SectionRules) -> Column:
    """The cleaned text between each cut and the next one."""

    def body(position: Column, index: Column) -> Column:
        following = F.coalesce(F.get(cuts, index + 1), F.size(lines) + 1)
        kept = F.transform(
            F.slice(lines, position + 1, following - position - 1),
            lambda x: clean_line(x, rules),
        )
        joined = F.array_join(F.filter(kept, lambda x: x != ""), " ")
        return F.struct(
            F.get(paths, index).alias("section"),
            tx.squeeze(cut_footer(joined, rules.footers)).alias("text"),
        )

    return F.transform(cuts, body)


def _paths(titles: Column, rules: SectionRules) -> Column:
    """`Parent > Child` for headings inside an open parent; a blocked heading closes it."""
    if not rules.parents:
        return titles
    low = F.lower

    def event(title: Column) -> Column:
        """'' closes the scope, a title opens one, null leaves it as it is."""
        return F.when(low(title).isin(list(rules.blocked)), F.lit("")).when(
            low(title).isin(list(rules.parents)), title
        )

    def with_scope(titles: Column, events: Column) -> Column:
        def path(title: Column, index: Column) -> Column:
            known = F.filter(F.slice(events, 1, index + 1), lambda e: e.isNotNull())
            scope = F.coalesce(F.try_element_at(known, F.lit(-1)), F.lit(""))
            own = low(title).isin([*rules.blocked, *rules.parents])
            return F.when(own | (scope == ""), title).otherwise(
                F.concat_ws(" > ", scope, title)
            )

        return F.transform(titles, path)

    return tx.let(
        titles, lambda bound: tx.let(F.transform(bound, event), lambda e: with_scope(bound, e))
    )


def explode_sections(documents: DataFrame) -> DataFrame:
    """One row per section."""
    return tx.explode_once(documents, F.col("sections"), "__s").select(
        *[c for c in documents.columns if c != "sections"], "__s.*"
    )


def thread_sections(threads: DataFrame) -> DataFrame:
    """Forum threads (see sources.threads) to `Post` and `Top comments` sections."""
    link = F.concat(F.lit("https://www.reddit.com"), F.col("permalink"))
    post = tx.squeeze(
        F.concat_ws(
            "\n",
            F.concat(F.lit("Reddit post: "), F.col("title")),
            F.concat(F.lit("Author: u/"), F.col("author")),
            F.concat(F.lit("Score: "), F.col("score").cast("string")),
            F.col("selftext"),
            F.concat(F.lit("Permalink: "), link),
        )
    )
    blocks = F.transform(
        "comments",
        lambda c, i: tx.squeeze(
            F.concat_ws(
                "\n",
                F.concat(F.lit("Comment "), (i + 1).cast("string"), F.lit(" by u/"), c["author"]),
                F.concat(F.lit("Score: "), c["score"].cast("string")),
                c["body"],
                F.concat(F.lit("Permalink: https://www.reddit.com"), c["permalink"]),
            )
        ),
    )
    staged = threads.withColumn("__post", post).withColumn(
        "__comments", F.array_join(blocks, "\n\n")
    )
    named = F.array(
        F.struct(F.lit("Post").alias("section"), F.col("__post").alias("text")),
        F.struct(F.lit("Top comments").alias("section"), F.col("__comments").alias("text")),
    )
    staged = staged.withColumn("__named", F.filter(named, lambda s: s["text"] != ""))
    return staged.withColumn(
        "sections",
        F.transform(
            "__named",
            lambda s, i: F.struct(
                (i + 1).alias("ord"),
                s["section"].alias("section"),
                s["text"].alias("text"),
                spoiler_level(
                    F.concat_ws(" ", F.col("content_type"), s["text"]), fixed.THREAD_SPOILERS
                ).alias("spoiler_level"),
            ),
        ).cast(SECTION_TYPE),
    ).drop("__post", "__comments", "__named")
