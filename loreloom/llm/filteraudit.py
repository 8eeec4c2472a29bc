"""How a set of corpus filters interact, over every order they can be applied in.

The result of any order follows from the set of filters a text fails, its mask. So texts are counted
once per part and mask (at most 32 cells per part, summed before they are shuffled). A cell is then
folded across the array of all orders, a literal that goes out with the plan: `transform` takes each
order, `aggregate` walks its five steps with the filters applied so far, and 600 structs come out,
weighted by the texts of the cell. The cells of a part are merged by elementwise sums.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import SPACES
from loreloom.session import materialise

FILTERS = "ABCDE"
BITS = {name: 1 << i for i, name in enumerate(FILTERS)}

MIN_WORDS = 50
DISTINCT_PERCENT = 65
CAPITAL_PERCENT = 5
CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SIGNS = "[#$%&*|]"

COUNTS = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost"]
CELL = "array<struct<" + ", ".join(f"{c}: bigint" for c in COUNTS) + ">>"


def word_counts(text: Column) -> Column:
    """Struct of the number of words and of distinct words; the words are made once."""
    words = F.filter(F.split(text, SPACES), lambda w: w != "")
    counted = F.transform(
        F.array(words),
        lambda w: F.struct(F.size(w).alias("n"), F.size(F.array_distinct(w)).alias("distinct")),
    )
    return F.get(counted, F.lit(0))


def text_mask(text: Column, words: Column) -> Column:
    """The failures that a text shows by itself: A few words, B repeats, C capitals, D signs."""
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, CAPITALS, ""))
    fails = {
        "A": words["n"] < MIN_WORDS,
        "B": 100 * words["distinct"] < DISTINCT_PERCENT * words["n"],
        "C": 100 * capitals > CAPITAL_PERCENT * F.char_length(text),
        "D": text.rlike(SIGNS),
    }
    return sum((F.when(v, BITS[k]).otherwise(0) for k, v in fails.items()), F.lit(0))


def masks(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, good, toxic) per row of `docs` (doc_id, text, source).

    A later copy is a row with the same text as a row of smaller id anywhere in the table; texts are
    told apart by length and SHA-256. The smallest id of each text is found by an aggregate with
    map-side sums, and rows meet it on text and id, so a text of which there are many copies is no
    hot key.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = materialise(
        docs.select(
            "doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"),
            text.alias("text"), word_counts(text).alias("words"),
        ).select(
            "doc_id", "part", text_mask(F.col("text"), F.col("words")).alias("mask"),
            F.octet_length("text").alias("size"), F.unhex(F.sha2("text", 256)).alias("digest"),
        )
    )
    first = (
        rows.filter("doc_id IS NOT NULL").groupBy("digest", "size").agg(F.min("doc_id").alias("doc_id"))
        .withColumn("leads", F.lit(True))
    )
    wanted = (
        labels.groupBy("doc_id")
        .agg(F.max(F.col("quality") == 1).alias("good"), F.max(F.col("toxic") == 1).alias("toxic"))
        .filter("good OR toxic")
    )
    known = rows.join(first, ["digest", "size", "doc_id"], "left").join(wanted, "doc_id", "left")
    copy = F.col("leads").isNull() & F.col("doc_id").isNotNull()
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("long").alias(c)
    return known.select(
        "part", (F.col("mask") + F.when(copy, BITS["E"]).otherwise(0)).alias("mask"),
        flag("good"), flag("toxic"),
    )


def all_orders() -> Column:
    """The 120 orders, as arrays of filter bits."""
    return F.array(*[F.array(*[F.lit(BITS[x]) for x in order]) for order in permutations(FILTERS)])


def fold(cell: Column) -> Column:
    """600 structs of counts for a cell (mask, n, good, toxic): five steps for each order."""

    def step(state: Column, bit: Column) -> Column:
        before = state["before"]
        fails = cell["mask"].bitwiseAND(bit) != 0
        gone = cell["mask"].bitwiseAND(before) != 0
        if_so = lambda what, n: F.when(what, cell[n]).otherwise(F.lit(0).cast("long"))
        made = F.struct(
            if_so(~gone & ~fails, "n").alias("kept"),
            if_so(~gone & fails, "n").alias("removed"),
            if_so(gone & fails, "n").alias("redundant"),
            if_so(cell["mask"] == bit, "n").alias("unique_fails"),
            if_so(~gone & fails, "good").alias("good_lost"),
            if_so(~gone & fails, "toxic").alias("toxic_lost"),
        )
        return F.struct(
            before.bitwiseOR(bit).alias("before"), F.concat(state["made"], F.array(made)).alias("made")
        )

    start = F.struct(F.lit(0).alias("before"), F.array().cast(CELL).alias("made"))
    return F.flatten(
        F.transform(all_orders(), lambda order: F.aggregate(order, start, step, lambda s: s["made"]))
    )


def merged(cells: Column) -> Column:
    """Elementwise sums of the folded cells of a part."""
    add = lambda a, b: F.struct(*[(a[c] + b[c]).alias(c) for c in COUNTS])
    nothing = F.array_repeat(
        F.struct(*[F.lit(0).cast("long").alias(c) for c in COUNTS]), 120 * len(FILTERS)
    )
    return F.aggregate(cells, nothing, lambda total, cell: F.zip_with(total, fold(cell), add))


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per part of `docs` (doc_id, text, source), order and step: what the step's filter does there.

    Columns: part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    and shapley, the filter's `removed` summed over all orders. `labels` has doc_id, quality, toxic; a
    label counts if any row of the id has it. A null text is the empty text, a null or empty source the
    part "". A row without an id is never a later copy, makes none, and has no labels; repeated rows
    of one id are no copies of each other, as neither id is smaller. An empty table has no parts.
    """
    cells = (
        masks(docs, labels).groupBy("part", "mask")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
        .groupBy("part").agg(F.collect_list(F.struct("mask", "n", "good", "toxic")).alias("cells"))
    )
    totals = materialise(cells.select("part", merged(F.col("cells")).alias("made")))
    orders = ["".join(order) for order in permutations(FILTERS)]
    steps = totals.select("part", F.posexplode("made").alias("at", "c"))
    steps = steps.select(
        "part", F.get(F.lit(orders), (F.col("at") / 5).cast("int")).alias("filter_order"),
        (F.col("at") % 5 + 1).cast("int").alias("step"), "c.*",
    ).withColumn("__filter", F.substring("filter_order", F.col("step"), F.lit(1)))
    shares = steps.groupBy("part", "__filter").agg(F.sum("removed").alias("shapley"))
    return steps.join(shares, ["part", "__filter"]).drop("__filter")
