"""White space and line patterns against the plain patterns they stand for."""

import random

from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators import sections
from loreloom.operators.sections import WIKI_A, WIKI_B


def plain_line(line, rules):
    """Every pattern on every line."""
    line = F.regexp_replace(line, r"(?U)\[ *\d+ *\]", "")
    if rules.block_starts:
        line = F.replace(line, F.lit("⁠"), F.lit(" "))
        ends = "|".join(rules.block_ends)
        for start in rules.block_starts:
            line = F.regexp_replace(line, rf"(?iu)\b{start}\b.*?(?=\b(?:{ends})\b|$)", "")
    if rules.drop_inline_metadata:
        for pattern in (r"\bUID\s+[A-Za-z0-9_]+", r"\bUUID\s+[A-Fa-f0-9-]{8,}", r"\bStats\s+[A-Za-z0-9_]+",
                        r"\bEqp\.\s+[A-Za-z0-9_]+"):
            line = F.regexp_replace(line, pattern, "")
    return plain_squeeze(line)


def plain_squeeze(text):
    return F.trim(F.regexp_replace(text, tx.SPACE + "+", " "))


def odd_texts():
    chance = random.Random(4)
    parts = [
        "word", "Technical details", "technical⁠details", "TECHNICAL DETAıLS", "ſpell flags", "Spell Flags", "notes",
        "Where to find", "UID a_1", "UUID 0a1b2c3d-4", "Stats x", "Eqp. y", "eqp", "[ 3 ]", "[12]", "[edit]", "[", "]",
        "#", "##", "Overview", "Retrieved from", "Categories :", "", "é", "日本", "ẞ", "\U0001f600",
    ]
    gaps = [" ", " ", " ", "", *tx.BLANKS, "  ", " \t", "  ", "​", "᠎", "﻿"]
    return ["".join(chance.choice(parts) + chance.choice(gaps) for _ in range(chance.randint(0, 9))) for _ in range(3000)]


def test_blanks_are_the_pattern(spark):
    every = spark.range(0x110000).filter("id < 55296 OR id > 57343").select(
        F.decode(F.encode(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')"), "UTF-8"), "UTF-8").alias("c")
    )
    found = every.filter(F.regexp_like("c", F.lit(f"^{tx.SPACE}$")) & (F.length("c") == 1)).collect()
    assert sorted(r["c"] for r in found) == sorted(tx.BLANKS)


def test_text_equals_the_plain_patterns(spark):
    x = F.col("x")
    texts = spark.createDataFrame([(t,) for t in [None, *odd_texts()]], "x string")
    pairs = {
        "squeeze": (tx.squeeze(x), plain_squeeze(x)),
        "strip": (tx.strip(x), F.regexp_replace(x, rf"^{tx.SPACE}+|{tx.SPACE}+$", "")),
        "heading": (sections.clean_heading(x),
                    F.btrim(F.regexp_replace(F.regexp_replace(x, r"\[.*?\]", ""), tx.SPACE + "+", " "), F.lit(" #"))),
        "line_a": (sections.clean_line(x, WIKI_A), plain_line(x, WIKI_A)),
        "line_b": (sections.clean_line(x, WIKI_B), plain_line(x, WIKI_B)),
    }
    for name, (new, old) in pairs.items():
        wrong = texts.select(x, new.alias("new"), old.alias("old")).filter("NOT new <=> old").collect()
        assert not wrong, (name, wrong[:3])
