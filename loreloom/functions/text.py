"""Text expressions. Every function takes and returns a Column, so the work stays in the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import fixed

WORD = r"[\p{L}\p{N}_]+"
SPACE = r"(?U)[\s\x1C-\x1F]"
# The same characters one by one.
BLANKS = "\t\n\x0b\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"
LINE_BREAK = r"\r\n|[\n\x0B\f\r\x1C-\x1E\x85\u2028\u2029]"
URL_NAMESPACE_HEX = "6ba7b8119dad11d180b400c04fd430c8"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """Bind `value` once and use it many times in `body`.

    A lambda that mentions a column mentions its whole expression, so without the binding a
    costly value would be computed again for every element.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def explode_once(df: DataFrame, array: Column, name: str, position: str | None = None) -> DataFrame:
    """One row per element of a computed array.

    A plain explode makes the optimizer test the array for emptiness first, below the projection,
    and so compute it twice. The outer form with the test afterwards computes it once.
    """
    if position is None:
        rows = df.select("*", F.explode_outer(array).alias(name))
    else:
        rows = df.select("*", F.posexplode_outer(array).alias(position, name))
    return rows.filter(F.col(name).isNotNull())


def fold(text: Column) -> Column:
    """Case-fold: lower case, with the sharp s spelled out."""
    return F.replace(F.lower(text), F.lit("ß"), F.lit("ss"))


def squeeze(text: Column) -> Column:
    """One space for every run of white space, none at the ends."""
    return F.trim(F.regexp_replace(text, SPACE + "+", " "))


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(BLANKS))


def normalise(text: Column) -> Column:
    return squeeze(fold(F.coalesce(text, F.lit(""))))


def words(text: Column) -> Column:
    """Word tokens as written."""
    return F.regexp_extract_all(text, F.lit(WORD), F.lit(0))


def tokens(text: Column) -> Column:
    """Case-folded word tokens."""
    return words(fold(F.coalesce(text, F.lit(""))))


def string_array(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values]).cast("array<string>")


def important_tokens(text: Column) -> Column:
    """Distinct tokens that are longer than one character and no stop words."""
    return F.array_distinct(
        F.filter(
            tokens(text),
            lambda t: (F.length(t) > 1) & ~t.isin(fixed.RANKING_STOP_WORDS),
        )
    )


def contains_any(text: Column, markers: list[str]) -> Column:
    """True when one of a fixed list of markers is a substring."""
    return reduce(lambda a, b: a | b, [F.contains(text, F.lit(m)) for m in markers])


def has_word(text: Column, vocabulary: list[str]) -> Column:
    """True when one of the tokens is in a fixed vocabulary."""
    return F.exists(tokens(text), lambda t: t.isin(vocabulary))


def starts_with_any(text: Column, prefixes: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.startswith(text, F.lit(p)) for p in prefixes])


def is_comparative(query: Column) -> Column:
    return has_word(query, fixed.COMPARATIVE_WORDS)


def is_definitional(query: Column) -> Column:
    return has_word(query, fixed.DEFINITION_WORDS)


def is_hint(query: Column) -> Column:
    return has_word(query, fixed.HINT_WORDS)


def is_follow_up(query: Column) -> Column:
    """A phrase marker anywhere, or a pronoun between spaces once ? . , are blanked."""
    low = strip(fold(query))
    parts = F.split(squeeze(F.translate(low, "?.,", "   ")), " ")
    return (low != "") & (
        contains_any(low, fixed.FOLLOW_UP_PHRASES)
        | F.exists(parts, lambda p: p.isin(fixed.FOLLOW_UP_WORDS))
    )


def spellings() -> tuple[str, str, dict[str, str]]:
    """Letters for one `translate` (those that disappear last), their Latin letters, and the rest."""
    both = dict(fixed.CYRILLIC_SPELLING)
    both |= {letter.upper(): spelled.capitalize() for letter, spelled in fixed.CYRILLIC_SPELLING.items()}
    short = {letter: spelled for letter, spelled in both.items() if len(spelled) == 1}
    dropped = "".join(letter for letter, spelled in both.items() if not spelled)
    longer = {letter: spelled for letter, spelled in both.items() if len(spelled) > 1}
    return "".join(short) + dropped, "".join(short.values()), longer


def latin(text: Column) -> Column:
    """Cyrillic letters spelled with Latin ones."""
    letters, single, longer = spellings()
    out = F.translate(text, letters, single)
    for letter, spelled in longer.items():
        out = F.replace(out, F.lit(letter), F.lit(spelled))
    return out


def entity_name(text: Column) -> Column:
    return squeeze(F.replace(fold(latin(text)), F.lit("_"), F.lit(" ")))


def slug(text: Column) -> Column:
    cleaned = F.regexp_replace(F.regexp_replace(text, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    return F.coalesce(F.nullif(F.lower(cleaned), F.lit("")), F.lit("section"))


def forum_text(text: Column) -> Column:
    """Three HTML entities, ampersand first, then white space."""
    out = F.coalesce(text, F.lit(""))
    for entity, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
        out = F.replace(out, F.lit(entity), F.lit(plain))
    return squeeze(out)


def content_hash(text: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(text, 256))


def point_id(key: Column) -> Column:
    """Name-based UUID (version 5, URL namespace) of a key."""
    digest = F.sha1(F.concat(F.unhex(F.lit(URL_NAMESPACE_HEX)), F.encode(key, "UTF-8")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat(
        F.substring(digest, 1, 8), F.lit("-"),
        F.substring(digest, 9, 4), F.lit("-5"),
        F.substring(digest, 14, 3), F.lit("-"),
        variant, F.substring(digest, 18, 3), F.lit("-"),
        F.substring(digest, 21, 12),
    )


def url_quote(text: Column, keep_colon: bool = False) -> Column:
    """Percent encoding that leaves letters, digits and _.-~ alone."""
    out = F.url_encode(text)
    for found, wanted in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(found), F.lit(wanted))
    return F.replace(out, F.lit("%3A"), F.lit(":")) if keep_colon else out


def thread_slug(url: Column) -> Column:
    """`id_name` of a thread URL, or the last 120 characters of the cleaned URL."""
    pattern = r"/comments/([^/]+)/([^/?#]+)"
    cleaned = F.lower(
        F.regexp_replace(F.regexp_replace(url, "[^a-zA-Z0-9]+", "_"), "^_+|_+$", "")
    )
    tail = F.when(F.length(cleaned) > 120, F.substring(cleaned, -120, 120)).otherwise(cleaned)
    return F.when(
        F.regexp_like(url, F.lit(pattern)),
        F.concat_ws("_", F.regexp_extract(url, pattern, 1), F.regexp_extract(url, pattern, 2)),
    ).otherwise(F.coalesce(F.nullif(tail, F.lit("")), F.lit("reddit_post")))


def content_type_of(title: Column, categories: Column) -> Column:
    """First matching rule over the title and the category names."""
    haystack = fold(F.concat_ws(" ", title, categories))
    out = F.lit(None).cast("string")
    for name, found in reversed(fixed.CONTENT_TYPE_RULES):
        out = F.when(contains_any(haystack, found), F.lit(name)).otherwise(out)
    return F.coalesce(out, F.lit(fixed.DEFAULT_CONTENT_TYPE))
