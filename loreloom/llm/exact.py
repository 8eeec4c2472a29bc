"""Exact duplicates by naming blocks.

Normalised texts are cut into blocks of a fixed length. The distinct blocks are sorted and numbered;
then adjacent numbers are paired, the distinct pairs sorted and numbered, and so on, until each
document has one number left. Two documents of equally many blocks have the same number exactly if
their texts are equal: no step compares digests in place of what they stand for.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import SPACES, keyed, numbered
from loreloom.session import materialise

BLOCK_CHARS = 16_384
NOTHING = -1


def normalised(text: Column) -> Column:
    """The text with each run of white space replaced by one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACES, " ")


def _block_names(blocks: DataFrame) -> DataFrame:
    """(row_key, pos, name) for rows of (row_key, pos, block).

    Blocks are compared whole, once, where equal ones meet. Their many occurrences then look their
    number up by a fingerprint; fingerprints that stand for more than one block are left out of that
    and looked up by the block itself.
    """
    marks = [F.xxhash64("block").alias("mark"), F.hash("block").alias("mark2")]
    distinct = blocks.select("block").distinct().sortWithinPartitions("block")
    named = materialise(distinct.select(*marks, F.monotonically_increasing_id().alias("name")))
    shared = materialise(
        named.groupBy("mark", "mark2").count().filter("count > 1").select("mark", "mark2")
    )
    marked = blocks.select("row_key", "pos", "block", *marks)
    places = marked.drop("block")
    if shared.isEmpty():
        return places.join(named, ["mark", "mark2"]).select("row_key", "pos", "name")
    plain = (
        places.join(named, ["mark", "mark2"])
        .join(shared, ["mark", "mark2"], "left_anti")
        .select("row_key", "pos", "name")
    )
    # Numbers below any other: the blocks behind shared fingerprints are sorted on their own.
    unclear = marked.join(shared, ["mark", "mark2"], "left_semi")
    own = materialise(
        unclear.select("block").distinct().sortWithinPartitions("block")
        .withColumn("name", -2 - F.monotonically_increasing_id())
    )
    return plain.unionByName(unclear.join(own, "block").select("row_key", "pos", "name"))


def identities(docs: DataFrame, text: str = "text", block_chars: int = BLOCK_CHARS) -> DataFrame:
    """One row per row of `docs` with row_key: (row_key, n_blocks, name).

    Rows have equal (n_blocks, name) exactly if their normalised texts are equal.
    """
    clean = docs.select("row_key", normalised(F.col(f"`{text}`")).alias("text"))
    cut = F.regexp_extract_all("text", F.lit(f"(?s).{{1,{block_chars}}}"), F.lit(0))
    parts = F.when(F.length("text") <= block_chars, F.array("text")).otherwise(cut)
    blocks = clean.select("row_key", F.posexplode(parts).alias("pos", "block"))
    level = materialise(_block_names(blocks))
    sizes = level.groupBy("row_key").agg((F.max("pos") + 1).cast("long").alias("n_blocks"))
    longest = sizes.agg(F.max("n_blocks")).first()[0] or 1
    if longest == 1:
        return level.select("row_key", F.lit(1).cast("long").alias("n_blocks"), "name")
    level = materialise(level.join(sizes, "row_key"))
    done = level.filter("n_blocks = 1").select("row_key", "n_blocks", "name")
    reach = 1
    while reach < longest:
        reach *= 2
        side = lambda k: F.max(F.when(F.col("pos") % 2 == k, F.col("name")))
        pairs = materialise(
            level.filter(F.col("n_blocks") > reach // 2)
            .groupBy("row_key", "n_blocks", F.shiftright("pos", 1).alias("pos"))
            .agg(side(0).alias("left"), F.coalesce(side(1), F.lit(NOTHING)).alias("right"))
        )
        distinct = pairs.select("left", "right").distinct().sortWithinPartitions("left", "right")
        names = materialise(distinct.withColumn("name", F.monotonically_increasing_id()))
        level = materialise(
            pairs.join(names, ["left", "right"]).select("row_key", "n_blocks", "pos", "name")
        )
        ended = level.filter(F.col("n_blocks") <= reach).select("row_key", "n_blocks", "name")
        done = done.unionByName(ended)
    return done


def exact_groups(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """Per row of `docs` (which has row_key): doc_id, row_key, keep_id, group_size, kept.

    Of rows with equal normalised text, the one with the smallest id stays; a null id comes after all
    others, and of rows with the same id the first in the files stays. Null texts equal empty ones,
    and texts of white space alone equal a single space, not the empty text. Repeated rows are
    members of their own: exactly one row of a group is kept. An empty table gives an empty table.
    """
    key = docs.select("row_key", F.col(f"`{doc_id}`").alias("doc_id"))
    rows = materialise(identities(docs, text).join(key, "row_key"))
    rank = F.struct(F.col("doc_id").isNull().alias("n"), F.col("doc_id"), F.col("row_key"))
    groups = materialise(
        rows.groupBy("n_blocks", "name")
        .agg(F.min(rank).alias("first"), F.count(F.lit(1)).alias("group_size"))
        .filter("group_size > 1")
    )
    joined = rows.join(groups, ["n_blocks", "name"], "left")
    single = F.col("group_size").isNull()
    return joined.select(
        "row_key", "doc_id",
        F.when(single, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("keep_id"),
        F.coalesce("group_size", F.lit(1)).alias("group_size"),
        (single | (F.col("first.row_key") == F.col("row_key"))).alias("kept"),
    )


def drop_copies(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, with their columns."""
    plain, names, at = numbered(docs)
    rows = keyed(plain)
    kept = exact_groups(rows, at[text], at[doc_id]).filter("kept").select("row_key")
    return rows.join(kept, "row_key", "left_semi").drop("row_key").toDF(*names)
