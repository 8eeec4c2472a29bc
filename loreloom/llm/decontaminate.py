"""Texts that hold a benchmark item or most of it. DataFrame functions only.

1. Windows. A window of the item's length that is similar enough has, of its m shingles, at least
   `least_common` in common with the item. The positions of a text whose shingle occurs anywhere in
   the item are its hits; while a window slides, the similarity can only rise where a hit enters, so
   it is enough to look at the windows that end on a hit and hold enough hits. Neither the order of
   the item's parts nor what lies between them matters. Windows of equal words count once.
2. Fingerprints. A window and its item get a SimHash of 64 bits; each occurrence of a shingle is a
   feature of its own, so that counts weigh as they do in the similarity. A similar window exchanges
   at most `slack` features, so a bit whose votes lean further to one side cannot change. The other
   bits are the radius of the item: no window that is similar enough lies outside it.
3. Blocks. Fingerprints are cut into one block more than the radius. Within the radius at least one
   block is equal, so windows meet their item by equality on (item, block, value); the bits that
   differ are then counted. An item so long that any bit may change has no blocks, and its windows
   go on as they are.
4. The exact similarity of the weighted shingles decides: the sum of the smaller over the sum of the
   larger counts.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import keyed, numbered
from loreloom.session import join_small, materialise

WIDTH = 5
SIMILARITY = 0.8
BROADCAST_ROWS = 100_000
BROADCAST_SHINGLES = 200_000
BROADCAST_BLOCKS = 50_000  # rows of 64 bits and a value
BITS = 64


def words_of(text: Column) -> Column:
    """Words in lower case, without anything but letters and digits; null has none."""
    bare = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}\x20\x09-\x0D]+", "")
    return F.filter(F.split(bare, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def _bounded(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """A written table, marked for broadcast if it is known to be small."""
    return F.broadcast(df) if df.count() <= rows else df


def _positions(rows: DataFrame, width: int, *keys: str) -> DataFrame:
    """(keys, pos, shingle): every run of `width` words, as a struct of words."""
    shifted = [F.slice("words", i + 1, F.greatest(F.size("words"), F.lit(1))) for i in range(width)]
    zipped = F.arrays_zip(*[s.alias(f"w{i}") for i, s in enumerate(shifted)])
    names = [f"w{i}" for i in range(width)]
    runs = rows.select(*keys, F.posexplode(zipped).alias("pos", "s"))
    out = runs.select(*keys, "pos", *[F.col("s").getField(n).alias(n) for n in names])
    return out.filter(F.col(names[-1]).isNotNull())


def _hash(width: int) -> Column:
    return F.xxhash64(*[F.col(f"w{i}") for i in range(width)])


def _counted(rows: DataFrame, *keys: str) -> DataFrame:
    """(keys, shingle, c): the shingles of rows of words as text, with their counts.

    Fewer words than a shingle has are one, all of them.
    """
    spread = F.transform(
        F.sequence(F.lit(1), F.greatest(F.size("words") - WIDTH + 1, F.lit(1))),
        lambda i: F.array_join(F.slice("words", i, WIDTH), " "),
    )
    return (
        rows.select(*keys, F.explode(spread).alias("shingle"))
        .groupBy(*keys, "shingle").agg(F.count(F.lit(1)).alias("c"))
    )


def shingle_count(words: Column | int) -> Column:
    return F.greatest(words - WIDTH + 1, F.lit(1))


def least_common(window: Column, item: Column, similarity: float) -> Column:
    """Common shingles that a similarity takes, for the numbers of shingles of both sides."""
    return F.ceil((window + item) * (similarity / (1 + similarity)) - 1e-9).cast("int")


def _hits(plain: DataFrame, items: DataFrame) -> DataFrame:
    """(row_key, item, at): positions of texts with a shingle of the item, in order."""
    lengths = [r[0] for r in items.select(F.least(F.size("words"), F.lit(WIDTH)).alias("k")).distinct().collect()]
    found = [plain.select("row_key", F.lit(None).cast("long").alias("item"), F.lit(0).alias("pos")).limit(0)]
    for width in sorted(lengths):
        size = F.least(F.size("words"), F.lit(WIDTH))
        seeds = materialise(
            _positions(items.filter(size == width).select("item", "words"), width, "item")
            .select("item", _hash(width).alias("h")).distinct()
        )
        seen = _positions(plain.select("row_key", "words"), width, "row_key").select(
            "row_key", "pos", _hash(width).alias("h")
        )
        found.append(seen.join(_bounded(seeds, BROADCAST_SHINGLES), "h").select("row_key", "item", "pos"))
    rows = reduce(DataFrame.unionAll, found)
    return rows.groupBy("row_key", "item").agg(F.sort_array(F.collect_set("pos")).alias("at"))


def _windows(plain: DataFrame, items: DataFrame, similarity: float) -> DataFrame:
    """(win, row_key, doc_id, item, start, words): windows that end on a hit and hold enough of them."""
    sizes = items.select("item", F.size("words").alias("length"), shingle_count(F.size("words")).alias("m"))
    # The text may be shorter than the item: then it is one window with as few as s * m shingles.
    fewest = F.greatest(F.ceil(F.col("m") * similarity - 1e-9).cast("int"), F.lit(1))
    hits = materialise(_hits(plain, items))
    grouped = hits.join(_bounded(sizes), "item").withColumn("fewest", fewest)
    ends = F.filter(
        "at",
        lambda q, i: (i + 1 >= F.col("fewest"))
        & (F.get("at", F.greatest(i - F.col("fewest") + 1, F.lit(0))) > q - F.col("m")),
    )
    starts = F.array_distinct(F.transform(ends, lambda q: F.greatest(q - F.col("m") + 1, F.lit(0))))
    laid = materialise(grouped.select("row_key", "item", "length", F.explode(starts).alias("start")))
    cut = plain.join(_bounded(laid), "row_key").select(
        "row_key", "doc_id", "item", "start",
        F.slice("words", F.col("start") + 1, F.col("length")).alias("words"),
    )
    return materialise(
        cut.groupBy("row_key", "item", F.xxhash64("words").alias("same"))
        .agg(F.min("start").alias("start"), F.first("doc_id").alias("doc_id"), F.first("words").alias("words"))
        .select(
            F.monotonically_increasing_id().alias("win"), "row_key", "doc_id", "item", "start", "words"
        )
    )


def _votes(counted: DataFrame, key: str) -> DataFrame:
    """(key, votes, features): for each bit, how many features have it set."""
    each = counted.select(key, "shingle", F.explode(F.sequence(F.lit(1), F.col("c").cast("int"))).alias("nth"))
    held = each.groupBy(key).agg(F.collect_list(F.xxhash64("shingle", "nth")).alias("f"))
    votes = F.transform(
        F.sequence(F.lit(0), F.lit(BITS - 1)),
        lambda b: F.aggregate(
            "f", F.lit(0), lambda n, f: n + F.getbit(f, b).cast("int")
        ),
    )
    return held.select(key, votes.alias("votes"), F.size("f").alias("features"))


def _bit_values(bits: Column, low: Column, high: Column) -> Column:
    """The bits from `low` up to `high` of an array of bits, as a string."""
    return F.array_join(F.slice(bits, low + 1, high - low), "")


def _within_radius(windows: DataFrame, window_counts: DataFrame, items: DataFrame, item_counts: DataFrame,
                   similarity: float) -> DataFrame:
    """(win): windows whose fingerprints lie within the radius of their item, by equal blocks."""
    bits = lambda c: F.transform("votes", lambda v: (2 * v > F.col(c)).cast("int"))
    # Of at most m shingles a similar window keeps so many that no vote moves by more than `slack`.
    slack = 2 * F.col("features") * ((1 - similarity) / (1 + similarity)) + 1e-9
    known = (
        _votes(item_counts.select("item", "shingle", "c"), "item")
        .select(
            "item", bits("features").alias("item_bits"),
            F.size(F.filter("votes", lambda v: F.abs(2 * v - F.col("features")) <= slack)).alias("radius"),
        )
    )
    known = materialise(known)
    prints = materialise(
        _votes(window_counts, "win").select("win", bits("features").alias("bits"))
        .join(windows.select("win", "item"), "win")
    )
    open_items = known.filter(F.col("radius") >= BITS).select("item")
    edge = lambda i: F.floor(i * BITS / (F.col("radius") + 1)).cast("int")
    block = lambda c: F.transform(
        F.sequence(F.lit(0), F.col("radius")),
        lambda i: F.struct(i.alias("no"), _bit_values(F.col(c), edge(i), edge(i + 1)).alias("value")),
    )
    small = known.filter(F.col("radius") < BITS)
    index = small.select("item", "radius", "item_bits", F.explode(block("item_bits")).alias("b"))
    index = materialise(index.select("item", "radius", "item_bits", "b.no", "b.value"))
    asked = prints.join(_bounded(small.select("item", "radius")), "item").select(
        "win", "item", "bits", F.explode(block("bits")).alias("b")
    ).select("win", "item", "bits", "b.no", "b.value")
    differ = F.size(F.filter(F.zip_with("bits", "item_bits", lambda x, y: x != y), lambda d: d))
    near = (
        asked.join(_bounded(index, BROADCAST_BLOCKS), ["item", "no", "value"])
        .filter(differ <= F.col("radius")).select("win")
    )
    rest = prints.join(_bounded(open_items), "item", "left_semi").select("win")
    return near.unionByName(rest).distinct()


def contaminated(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(row_key, doc_id, item_id, similarity, start, n_words) for `docs` (row_key, doc_id, text).

    One row per text and item: the window of the item's number of words that is most similar (the
    first of equals), if its similarity is `similarity` or more. `start` counts words from 0. A text
    shorter than the item is one window. Null and empty texts and items hold no words and match
    nothing. An item_id that repeats is an item for each of its texts, and the best one counts; rows
    with a null item_id count too. Repeated rows of texts match on their own. Empty tables give an
    empty table.
    """
    items = materialise(
        benchmark.select("item_id", words_of(F.col("text")).alias("words"))
        .filter(F.size("words") > 0).distinct()
        .withColumn("item", F.monotonically_increasing_id())
    )
    plain = docs.select("row_key", "doc_id", words_of(F.col("text")).alias("words"))
    windows = _windows(plain, items, similarity)
    item_counts = materialise(_counted(items.select("item", "words"), "item"))
    window_counts = materialise(_counted(windows.select("win", "item", "words"), "win", "item"))
    near = materialise(_within_radius(windows, window_counts, items, item_counts, similarity))
    common = (
        join_small(
            window_counts.join(near, "win"), item_counts.withColumnRenamed("c", "d"), ["item", "shingle"]
        )
        .groupBy("win").agg(F.sum(F.least("c", "d")).alias("common"))
    )
    size = F.size("words")
    scored = (
        common.join(
            windows.select(
                "win", "row_key", "doc_id", "item", "start", size.alias("n_words"),
                shingle_count(size).alias("total"),
            ),
            "win",
        )
        .join(_bounded(items.select("item", "item_id", shingle_count(size).alias("item_total"))), "item")
        .withColumn("similarity", F.col("common") / (F.col("total") + F.col("item_total") - F.col("common")))
        .filter(F.col("similarity") >= similarity)
    )
    best = F.struct("similarity", (-F.col("start")).alias("s"), "n_words")
    return (
        scored.groupBy("row_key", "doc_id", "item_id").agg(F.max(best).alias("b"))
        .select(
            "row_key", "doc_id", "item_id", "b.similarity", (-F.col("b.s")).cast("long").alias("start"),
            F.col("b.n_words").cast("long").alias("n_words"),
        )
    )


def drop_contaminated(
    docs: DataFrame, benchmark: DataFrame, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """The rows of `docs` that hold no benchmark item, with their columns."""
    shell, names, at = numbered(docs)
    rows = keyed(shell)
    plain = rows.select("row_key", F.col(at[doc_id]).alias("doc_id"), F.col(at[text]).alias("text"))
    bad = materialise(contaminated(plain, benchmark).select("row_key").distinct())
    return rows.join(_bounded(bad), "row_key", "left_anti").drop("row_key").toDF(*names)
