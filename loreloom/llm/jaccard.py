"""Near-duplicate texts: an exact join on the Jaccard similarity of word shingles.

A text is the set of its distinct shingles, held as sorted 64-bit hashes. Texts with equal sets are
one class, and only classes are joined. Two sets of the wanted similarity share one of the first few
of their shingles in any common order; frequent shingles come last in ours. Each class goes to one
tile per such shingle and band of set sizes (and to each larger band where partners may lie), so
every pair of similar classes meets in a tile. In a tile

1. each class is compared with one centre only, a class that shares many tiles and so stands in the
   middle of its group; this joins large groups of near copies in as many comparisons as they have
   members;
2. classes outside the largest component of a tile are compared with a centre of that component;
3. classes of different components are compared with each other; a tile whose members are all
   connected already has nothing left to do.

A comparison first bounds the overlap from above by the bit counts of hashed bitmaps, then
intersects the sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.llm.common import groups_of_rows, keyed, numbered
from loreloom.llm.components import components
from loreloom.llm.hashing import U, mix, shingles
from loreloom.session import materialise

FREQUENT = 1 << 19
COUNTED_AT_ONCE = 1 << 20
BAND = 1.5


def frequent_shingles(docs: DataFrame, width: int, most: int = FREQUENT) -> tuple:
    """Shingles that recur within a stretch of about a million, with their counts; `most` at most.

    The table only decides in which order the shingles of a text are looked at. Any order gives the
    same result, so its bound is one of memory.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def recurring(parts: list[np.ndarray]) -> pa.RecordBatch:
            values, counts = np.unique(np.concatenate(parts), return_counts=True)
            often = counts > 1
            return pa.RecordBatch.from_arrays(
                [pa.array(values[often].view(np.int64)), pa.array(counts[often])], ["s", "n"]
            )

        parts, held = [], 0
        for _, texts in groups_of_rows(batches, "text"):
            hashes, _ = shingles(texts, width)
            parts.append(hashes)
            held += len(hashes)
            if held >= COUNTED_AT_ONCE:
                yield recurring(parts)
                parts, held = [], 0
        if parts:
            yield recurring(parts)

    counted = docs.select("text").mapInArrow(run, "s long, n long").groupBy("s").agg(
        F.sum("n").alias("n")
    )
    top = counted.orderBy(F.desc("n"), "s").limit(most).toArrow()
    values = top["s"].to_numpy().astype(np.int64).view(U)
    counts = top["n"].to_numpy().astype(np.int64)
    order = np.argsort(values)
    return values[order], counts[order]


def band_floors(largest: int = 1 << 40) -> np.ndarray:
    """Smallest set size of each band."""
    floors = [1]
    while floors[-1] < largest:
        floors.append(max(floors[-1] + 1, int(floors[-1] * BAND)))
    return np.array(floors, dtype=np.int64)


def bitmap_bits(size: np.ndarray) -> np.ndarray:
    """Bits of the bitmap of a set: a power of two, twice to four times its size."""
    return np.int64(1) << np.ceil(np.log2(np.maximum(size, 4) * 2)).astype(np.int64)


def bitmap(hashes: np.ndarray, bits: int) -> np.ndarray:
    out = np.zeros(bits, dtype=np.uint8)
    out[(hashes & U(bits - 1)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little")


def folded(bitmap_bytes: np.ndarray, bits: int) -> np.ndarray:
    """The bitmap of the same set with fewer bits."""
    return np.bitwise_or.reduce(bitmap_bytes.reshape(-1, bits // 8), axis=0)


def overlap_bound(a: np.ndarray, size_a: int, b: np.ndarray, size_b: int) -> int:
    """No fewer than the common members: a bit of one map alone stands for a member of one alone."""
    bits = min(len(a), len(b)) * 8
    a, b = folded(a, bits), folded(b, bits)
    only_a = int(np.bitwise_count(a & ~b).sum())
    only_b = int(np.bitwise_count(b & ~a).sum())
    return min(size_a - only_a, size_b - only_b)


def _records(docs: DataFrame, width: int, percent: int, frequent) -> DataFrame:
    """Per row: set size, digest of the set, its tiles, and its bitmap."""
    floors = band_floors()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        often, times = frequent.value
        for batch, texts in groups_of_rows(batches, "text"):
            hashes, counts = shingles(texts, width)
            doc = np.repeat(np.arange(len(texts)), counts)
            ends = np.cumsum(counts)
            heads = ends - counts
            marks = mix(hashes ^ U(0x5851F42D4C957F2D)), mix(hashes + U(0x14057B7EF767814F))
            digests = []
            for mark in marks:
                sums = np.r_[U(0), np.cumsum(mark)]
                digests.append((sums[ends] - sums[heads]).view(np.int64))
            if len(often):
                at = np.minimum(np.searchsorted(often, hashes), len(often) - 1)
                weight = np.where(often[at] == hashes, times[at], 0)
            else:
                weight = np.zeros(len(hashes), dtype=np.int64)
            order = np.lexsort((hashes, weight, doc))
            need = -(-counts * percent // 100)
            head_size = np.where(counts > 0, counts - need + 1, 0)
            within = np.arange(len(hashes)) - np.repeat(heads, counts)
            pick = within < np.repeat(head_size, counts)
            tokens, owner = hashes[order][pick], doc[pick]
            band = np.searchsorted(floors, np.maximum(counts, 1), side="right") - 1
            # Home, then a guest of each larger band that may hold sets of the similarity.
            tiles, whose = [], []
            for step in range(len(floors)):
                visits = floors[np.minimum(band + step, len(floors) - 1)] * percent <= 100 * counts
                guest = visits[owner] if step else slice(None)
                if step and not guest.any():
                    break
                place = band[owner[guest]].astype(U) + U(step + 1)
                tiles.append(mix(tokens[guest] + place * U(0x9E3779B97F4A7C15)))
                whose.append(owner[guest])
            tiles, whose = np.concatenate(tiles), np.concatenate(whose)
            line = np.argsort(whose, kind="stable")
            per_doc = np.bincount(whose, minlength=len(texts))
            bits = bitmap_bits(counts)
            maps = [
                bitmap(hashes[heads[i] : ends[i]], int(bits[i])).tobytes() if counts[i] else b""
                for i in range(len(texts))
            ]
            offsets = np.r_[0, np.cumsum(per_doc)].astype(np.int32)
            lists = pa.ListArray.from_arrays(
                pa.array(offsets), pa.array(tiles[line].view(np.int64))
            )
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(counts.astype(np.int64)),
                    pa.array(digests[0]), pa.array(digests[1]), lists, pa.array(maps, pa.binary()),
                ],
                ["row_key", "doc_id", "n", "d1", "d2", "tiles", "bits"],
            )

    kinds = docs.select("row_key", "doc_id").schema
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in kinds)
    return docs.select("row_key", "doc_id", "text").mapInArrow(
        run, f"{schema}, n long, d1 long, d2 long, tiles array<long>, bits binary"
    )


def _bounded(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) whose sizes and bitmaps allow the similarity."""
    side = lambda s: classes.select(
        F.col("cls").alias(s), F.col("n").alias(f"n_{s}"), F.col("bits").alias(f"bits_{s}")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i).to_pylist() for i in range(batch.num_columns)]
            keep = []
            for n_a, n_b, bits_a, bits_b in zip(*columns[2:], strict=True):
                bound = overlap_bound(
                    np.frombuffer(bits_a, np.uint8), n_a, np.frombuffer(bits_b, np.uint8), n_b
                )
                keep.append((100 + percent) * bound >= percent * (n_a + n_b))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    sized = pairs.join(side("a"), "a").join(side("b"), "b").filter(
        F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent
    )
    return sized.select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(
        run, "a long, b long"
    )


def _linked(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """Pairs (a, b) whose shingle sets have the similarity, counted on their sorted arrays."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, left in groups_of_rows(batches, "text_a"):
            right = batch.column(batch.schema.get_field_index("text_b")).to_pylist()
            sets = []
            for side in (left, right):
                hashes, counts = shingles(side, width)
                sets.append((hashes, np.r_[0, np.cumsum(counts)]))
            keep = []
            for i in range(len(left)):
                (a, b) = (h[e[i] : e[i + 1]] for h, e in sets)
                at = np.minimum(np.searchsorted(b, a), max(len(b) - 1, 0))
                common = int((b[at] == a).sum()) if len(a) and len(b) else 0
                keep.append(100 * common >= percent * (len(a) + len(b) - common))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    side = lambda s: texts.select(F.col("cls").alias(s), F.col("text").alias(f"text_{s}"))
    both = pairs.join(side("b"), "b").join(side("a"), "a").select("a", "b", "text_a", "text_b")
    return both.mapInArrow(run, "a long, b long")


def _best_centre(seats: DataFrame) -> DataFrame:
    """(a, b): of the centres `b` of the tiles of a class, the one of most tiles."""
    return (
        seats.groupBy("cls", "b").agg(F.count(F.lit(1)).alias("c"))
        .groupBy("cls").agg(F.max_by("b", F.struct("c", -F.col("b"))).alias("b"))
        .select(F.col("cls").alias("a"), "b")
    )


def _open_seats(seats: DataFrame, labels: DataFrame) -> DataFrame:
    """Seats of the tiles that hold several components, with their own, the largest, and its centre."""
    placed = seats.join(labels.withColumnRenamed("node", "cls"), "cls", "left").select(
        "tile", "cls", "n", "guest", "w", "upto", "rest", F.coalesce("label", "cls").alias("label")
    )
    parts = placed.groupBy("tile", "label").agg(
        F.count(F.lit(1)).alias("c"), F.max_by("cls", "w").alias("centre")
    )
    mixed = materialise(
        parts.groupBy("tile")
        .agg(
            F.count(F.lit(1)).alias("parts"),
            F.max_by(F.struct("label", "centre"), F.struct("c", "label")).alias("top"),
        )
        .filter("parts > 1")
        .select("tile", F.col("top.label").alias("main"), F.col("top.centre").alias("centre"))
    )
    return materialise(placed.drop("w").join(mixed, "tile"))


def near_duplicates(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """Per row of `docs` (row_key, doc_id, text): row_key, doc_id, n_shingles, component, kept.

    Rows link when 100 * intersection >= percent * union of their sets of `width`-word shingles;
    `component` is the smallest id reachable by links and `kept` marks one row of each component, the
    first by id (a null id after all others), then by place. A null or empty text, or one of white
    space alone, has no shingles and links with nothing; it is kept, and its component is its own id.
    A text with fewer words than `width` is one shingle, the whole sequence. Repeated rows are
    members of one class. An empty table gives an empty table.
    """
    spark = docs.sparkSession
    frequent = spark.sparkContext.broadcast(frequent_shingles(docs, width))
    records = materialise(_records(docs, width, percent, frequent))
    rank = F.struct(F.col("doc_id").isNull().alias("x"), F.col("doc_id"), F.col("row_key"))
    classes = materialise(
        records.filter("n > 0").groupBy("n", "d1", "d2")
        .agg(
            F.min(rank).alias("head"), F.first("tiles").alias("tiles"),
            F.first("bits").alias("bits"),
        )
        .withColumn("cls", F.monotonically_increasing_id())
    )
    # The tiles of a class: one per token of its prefix, then as many as a guest of each larger band.
    prefix = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1
    seats = classes.select("cls", prefix.alias("p"), F.posexplode("tiles").alias("pos", "tile"))
    seats = seats.select(
        "cls", "tile", (F.col("pos") % F.col("p")).cast("int").alias("token"),
        (F.col("pos") >= F.col("p")).alias("guest"),
    )
    tiles = materialise(
        seats.groupBy("tile").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("tile")
    )
    seats = materialise(seats.join(tiles, "tile"))
    # A class with few shingles of its own has many shared tiles: it stands in the middle of a group.
    shared = materialise(seats.groupBy("cls").agg(F.count(F.lit(1)).alias("shared")))
    # Of the tokens two classes have in common, as many as the smaller `upto` come up to a shared one
    # (all of them shared ones), and as many as the smaller `rest` after it.
    seats = materialise(
        seats.join(shared, "cls").join(classes.select("cls", "n"), "cls").select(
            "tile", "cls", "n", "guest", F.struct("shared", -F.col("cls")).alias("w"),
            F.dense_rank().over(Window.partitionBy("cls").orderBy("token")).alias("upto"),
            (F.col("n") - F.col("token") - 1).alias("rest"),
        )
    )
    nodes = shared.select("cls").join(
        classes.select("cls", F.col("head.row_key").alias("row_key")), "cls"
    )
    texts = materialise(docs.select("row_key", "text").join(nodes, "row_key").select("cls", "text"))

    def similar(pairs: DataFrame) -> DataFrame:
        return materialise(_linked(_bounded(pairs, classes, percent), texts, width, percent))

    # First pass: each class with one centre of its tiles, the one it shares most tiles with.
    centres = materialise(seats.groupBy("tile").agg(F.max_by("cls", "w").alias("b")))
    near = _best_centre(seats.join(centres, "tile").filter("cls != b"))
    links = similar(near)
    labels = components(links)

    # Second pass: classes outside the largest part of a tile with the centre of that part.
    open_seats = _open_seats(seats, labels)
    near = _best_centre(
        open_seats.filter("label != main").select("tile", "cls", F.col("centre").alias("b"))
    )
    more = similar(near)
    if not more.isEmpty():
        links = materialise(links.unionByName(more))
        labels = components(links)
        open_seats = _open_seats(seats, labels)

    # Third pass: all members of a tile that are in different components so far.
    few = open_seats.filter("label != main").select(
        "tile", *[F.col(c).alias(f"{c}_x") for c in ("cls", "label", "n", "guest", "upto", "rest")]
    )
    # The first common token of a pair leaves enough of both; two guests meet in their own band too.
    enough = (F.col("n") + F.col("n_x")) * percent
    common = F.least("upto", "upto_x") + F.least("rest", "rest_x")
    pairs = (
        few.join(
            open_seats,
            (few["tile"] == open_seats["tile"])
            & F.expr("label != label_x AND (label = main OR cls < cls_x)")
            & (F.least("n", "n_x") * 100 >= F.greatest("n", "n_x") * percent)
            & F.expr("NOT (guest AND guest_x)")
            & ((F.least("rest", "rest_x") + 1) * (100 + percent) >= enough)
            & (common * (100 + percent) >= enough),
        )
        .select(F.greatest("cls_x", "cls").alias("a"), F.least("cls_x", "cls").alias("b"))
        .distinct()
    )
    more = similar(pairs)
    if not more.isEmpty():
        labels = components(links.unionByName(more))

    parts = classes.select("n", "d1", "d2", "cls", "head").join(
        labels.withColumnRenamed("node", "cls"), "cls", "left"
    ).withColumn("label", F.coalesce("label", "cls"))
    heads = parts.groupBy("label").agg(F.min("head").alias("first"))
    named = materialise(parts.join(heads, "label").select("n", "d1", "d2", "first"))
    joined = records.select("row_key", "doc_id", "n", "d1", "d2").join(
        named, ["n", "d1", "d2"], "left"
    )
    alone = F.col("first").isNull()
    return joined.select(
        "row_key", "doc_id", F.col("n").alias("n_shingles"),
        F.when(alone, F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("component"),
        (alone | (F.col("first.row_key") == F.col("row_key"))).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, width: int = 5, percent: int = 80, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """The rows of `docs` that stay, one of each component, with their columns."""
    shell, names, at = numbered(docs)
    rows = keyed(shell)
    plain = rows.select("row_key", F.col(at[doc_id]).alias("doc_id"), F.col(at[text]).alias("text"))
    kept = near_duplicates(plain, width, percent).filter("kept").select("row_key")
    return rows.join(kept, "row_key", "left_semi").drop("row_key").toDF(*names)
