"""Near duplicates by SimHash fingerprints at most two bits apart, through deletion variants.

A 64-bit fingerprint is cut into two segments of 32 bits. Of two differing bits at most one falls
into one of the segments, so that segment is equal but for one bit. The index therefore holds, per
distinct fingerprint, its segments whole and the first segment with each of its bits struck out (a
wildcard). Two fingerprints that link have one of these keys in common: an equal first segment, an
equal second one, or, with one differing bit in each, the first segment without that bit. Keys meet
by equality, and the bits that differ are counted in the join.

Copies of a fingerprint are one entry. Where many different fingerprints share a key (large groups
of near copies), they are not compared with each other: a second wildcard is struck out of the other
segment, after which at most four fingerprints can share a key, and all that do are links.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import groups_of_rows, keyed, numbered
from loreloom.llm.components import components
from loreloom.session import materialise

SEED = 42
WIDTH = 3
BITS = 32
LOW = (1 << BITS) - 1
COMPARED = 256  # members of a key that are compared with each other; beyond, a second wildcard
BLOCK = 1 << 14

# A key is its slot and, below it, 32 bits: the first segment, the second, the first without bit i.
FIRST, SECOND, STRUCK = 0, 1, 2


def shingle_hashes(text: str | None, width: int = WIDTH) -> np.ndarray:
    """XXH64 of each shingle of the text, repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # A-Z and 09-0D, 20 only
    if not words:
        return np.zeros(0, dtype=np.uint64)
    line = b" ".join(words)
    ends = np.cumsum([len(w) + 1 for w in words])
    starts = np.r_[0, ends[:-1]].tolist()
    ends = (ends - 1).tolist()
    span = min(width, len(words))
    digest = xxhash.xxh64_intdigest
    made = (digest(line[a:b], SEED) for a, b in zip(starts, ends[span - 1 :], strict=False))
    return np.fromiter(made, dtype=np.uint64, count=len(words) - span + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of the hashes; zero without hashes."""
    votes = np.zeros(64, dtype=np.int64)
    for at in range(0, len(hashes), BLOCK):
        part = np.ascontiguousarray(hashes[at : at + BLOCK], dtype="<u8")
        bits = np.unpackbits(part.view(np.uint8), bitorder="little").reshape(-1, 64)
        votes += bits.sum(axis=0, dtype=np.int32)
    return int(np.packbits(2 * votes > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(row_key, doc_id, fp) for rows of (row_key, doc_id, text); fp is signed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups_of_rows(batches, "text"):
            made = np.array([fingerprint(shingle_hashes(t, width)) for t in texts], dtype=np.uint64)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(made.view(np.int64))],
                ["row_key", "doc_id", "fp"],
            )

    kinds = docs.select("row_key", "doc_id").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
    return docs.select("row_key", "doc_id", "text").mapInArrow(run, f"{schema}, fp long")



def first_segment(fp: str) -> Column:
    return F.shiftrightunsigned(fp, BITS)


def second_segment(fp: str) -> Column:
    return F.col(fp).bitwiseAND(F.lit(LOW))


def index_keys(distinct: DataFrame) -> DataFrame:
    """(key, fp): the 34 keys of each distinct fingerprint."""
    struck = F.transform(
        F.array(*[
            F.struct(
                F.lit((STRUCK + i) << BITS).alias("slot"), F.lit(LOW ^ 1 << i).cast("long").alias("mask")
            )
            for i in range(BITS)
        ]),
        lambda m: m["slot"].bitwiseOR(first_segment("fp").bitwiseAND(m["mask"])),
    )
    whole = F.array(
        first_segment("fp"), F.lit(SECOND << BITS).bitwiseOR(second_segment("fp"))
    )
    return distinct.select(F.explode(F.concat(whole, struck)).alias("key"), "fp")


def fingerprint_links(distinct: DataFrame, compared: int = COMPARED) -> DataFrame:
    """(a, b) for a table of distinct fingerprints `fp`: links, two bits apart at most.

    Any two that link are connected by the links returned. `compared` decides by which way the members
    of a key meet; it changes the work, never what is connected.
    """
    keys = index_keys(distinct)
    is_struck = F.shiftright("key", BITS) >= STRUCK
    # Members of a struck key that have the whole first segment in common meet there.
    sizes = materialise(
        keys.groupBy("key")
        .agg(
            F.count(F.lit(1)).alias("size"),
            F.min(first_segment("fp")).alias("low"), F.max(first_segment("fp")).alias("high"),
        )
        .filter((F.col("size") > 1) & (~is_struck | (F.col("low") < F.col("high"))))
        .select("key", "size")
    )
    members = materialise(keys.join(sizes, "key"))
    few = members.filter(F.col("size") <= compared).select("key", F.col("fp").alias("a"))
    met = few.join(few.withColumnRenamed("a", "b"), "key").filter(
        (F.col("a") < F.col("b"))
        & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= 2)
        & (~is_struck | (first_segment("a") != first_segment("b")))
    )
    return met.select("a", "b").unionByName(_crowded(members.filter(F.col("size") > compared))).distinct()


def _crowded(members: DataFrame) -> DataFrame:
    """Links (a, b) inside keys of many members, by further wildcards in the other segment.

    One beside a struck bit and two beside a whole segment: at most two bits are free, so at most four
    fingerprints agree on the rest, and all of them link.
    """
    slot = F.shiftright("key", BITS)
    other = F.when(slot == SECOND, first_segment("fp")).otherwise(second_segment("fp"))
    one = [LOW ^ 1 << i for i in range(BITS)]
    two = [LOW ^ 1 << i ^ 1 << j for i in range(BITS) for j in range(i)]
    masks = F.when(slot >= STRUCK, F.lit(one)).otherwise(F.lit(two))
    spread = members.select("key", "fp", other.alias("rest"), F.explode(masks).alias("mask"))
    agreed = (
        spread.groupBy("key", "mask", F.col("rest").bitwiseAND(F.col("mask")).alias("rest"))
        .agg(F.collect_set("fp").alias("fps"))
        .filter(F.size("fps") > 1)
    )
    return agreed.select(F.array_min("fps").alias("a"), F.explode("fps").alias("b")).filter("a != b")


def simhash_groups(docs: DataFrame, width: int = WIDTH, compared: int = COMPARED) -> DataFrame:
    """Per row of `docs` (row_key, doc_id, text): row_key, doc_id, fp, component, kept.

    Fingerprints link at two or fewer differing bits; `component` is the smallest id reachable by
    links, `kept` marks one row of each component, the first by id (a null id after all others), then
    by place. A null text is the empty text; texts without words have fingerprint zero, which links
    like any other. A text with fewer words than `width` has its whole sequence as its one shingle.
    Repeated rows share a fingerprint. If all ids of a component are null, so is `component`. An empty
    table gives an empty table.
    """
    rows = materialise(fingerprints(docs, width))
    rank = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("row_key"))
    distinct = materialise(rows.groupBy("fp").agg(F.min(rank).alias("head")))
    labels = components(fingerprint_links(distinct.select("fp"), compared))
    placed = distinct.join(labels.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "label", F.coalesce("label", "fp")
    )
    heads = placed.groupBy("label").agg(F.min("head").alias("first"))
    named = materialise(placed.join(heads, "label").select("fp", "first"))
    return rows.join(named, "fp").select(
        "row_key", "doc_id", "fp", F.col("first.doc_id").alias("component"),
        (F.col("first.row_key") == F.col("row_key")).alias("kept"),
    )


def drop_simhash_duplicates(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """The rows of `docs` that stay, one of each component, with their columns."""
    shell, names, at = numbered(docs)
    rows = keyed(shell)
    plain = rows.select("row_key", F.col(at[doc_id]).alias("doc_id"), F.col(at[text]).alias("text"))
    kept = simhash_groups(plain).filter("kept").select("row_key")
    return rows.join(kept, "row_key", "left_semi").drop("row_key").toDF(*names)
