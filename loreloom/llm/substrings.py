"""Repeated passages of words: seed on winnowed anchors, extend both ways, keep the maximal repeats."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.llm.common import groups_of_rows
from loreloom.llm.hashing import U, mix, prefix_sums, run_hash
from loreloom.llm.repeats import Unit, merged, recurring
from loreloom.session import materialise

WORDS, SEED = 35, 11


def _extended(docs: DataFrame, reps: DataFrame, unit: Unit) -> DataFrame:
    """Every window over the given spans: (anchor, span, window, row_key, start).

    `window` stands for the symbols of the window and for where the anchor lies in it, that is, for
    one way to extend the anchor to both sides.
    """
    per_doc = reps.groupBy("row_key").agg(
        F.collect_list(F.struct("anchor", "span", "start", "owned", "lead")).alias("seeds")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups_of_rows(batches, "text"):
            symbols, counts, _ = unit.symbols(texts)
            seeds = batch.column(1)
            per_text = np.diff(seeds.offsets.to_numpy())
            flat = seeds.flatten()
            anchor, span, start, owned, lead = (
                flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(5)
            )
            doc = np.repeat(np.arange(len(texts)), per_text)
            heads = np.cumsum(counts) - counts
            each = np.repeat(np.arange(len(doc)), owned)
            step = np.arange(len(each)) - np.repeat(np.cumsum(owned) - owned, owned)
            first = start[each] + step
            at = heads[doc[each]] + first
            sums = prefix_sums(symbols, base=1)
            window = mix(
                run_hash(sums, at, at + unit.length, base=1)
                + (lead[each] - step).view(U) * U(0x9E3779B97F4A7C15)
            )
            for low in range(0, len(each), 200_000):
                part = slice(low, low + 200_000)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[each[part]]), pa.array(span[each[part]]),
                        pa.array(window[part].view(np.int64)),
                        batch.column(0).take(pa.array(doc[each[part]])), pa.array(first[part]),
                    ],
                    ["anchor", "span", "window", "row_key", "start"],
                )

    key = reps.schema["row_key"].dataType.simpleString()
    return (
        docs.join(per_doc, "row_key").select("row_key", "seeds", "text")
        .mapInArrow(run, f"anchor long, span long, window long, row_key {key}, start long")
    )


def repeated_runs(docs: DataFrame, unit: Unit) -> DataFrame:
    """(row_key, start, end) runs of symbols covered by windows that recur anywhere; runs overlap."""
    seats = recurring(
        docs, unit, ["anchor", "span", "row_key", "start", "owned", "lead", "mixed"]
    )
    end = (F.col("start") + F.col("owned") - 1 + unit.length).alias("end")
    classes = materialise(
        seats.filter("mixed").groupBy("anchor", "span").agg(
            F.count(F.lit(1)).alias("c"),
            F.min(F.struct("row_key", "start", "owned", "lead")).alias("first"),
        )
    )
    reps = classes.select("anchor", "span", "c", "first.*")
    windows = materialise(_extended(docs, reps, unit))
    # Written, so that adaptive execution sees two shuffled sides and splits hot windows.
    shared = materialise(
        windows.groupBy("anchor", "window").agg(F.count(F.lit(1)).alias("c"))
        .filter("c > 1").select("anchor", "window")
    )
    # The windows of a class with two members recur anyway; of the others, those that a class shares.
    single = classes.filter("c = 1").select("anchor", "span")
    alone = (
        windows.join(shared, ["anchor", "window"]).join(single, ["anchor", "span"], "left_semi")
        .select("row_key", "start", (F.col("start") + unit.length).alias("end"))
    )
    copies = seats.filter("mixed").join(
        classes.filter("c > 1").select("anchor", "span"), ["anchor", "span"], "left_semi"
    )
    return (
        seats.filter("NOT mixed").select("row_key", "start", end)
        .unionByName(copies.select("row_key", "start", end))
        .unionByName(alone)
    )


def drop_repeats(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """Per row of `docs` (row_key, doc_id, text): row_key, doc_id, n_words, n_removed, starts, ends, kept.

    Removes every word covered by a window of `words` words that starts anywhere else too, in this or
    another text; windows are judged on the texts as given. `starts` and `ends` are the maximal
    removed runs in words, `kept` the words left, joined by one space. Null and empty texts have no
    words and keep the empty string; shorter texts than a window keep all words. Repeated rows repeat
    each other. An empty table gives an empty table.
    """
    unit = Unit(words=True, length=words, seed=min(seed, words))
    runs = (
        repeated_runs(docs, unit).groupBy("row_key")
        .agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups_of_rows(batches, "text"):
            _, counts, (raw, first, last) = unit.symbols(texts)
            found = batch.column(batch.schema.get_field_index("runs")).to_pylist()
            heads = np.cumsum(counts) - counts
            keep = np.ones(len(first), dtype=bool)
            starts, ends = [], []
            for i, spans in enumerate(found):
                pairs = np.array([(s["start"], s["end"]) for s in spans or ()], dtype=np.int64)
                pairs = pairs.reshape(-1, 2)
                low, high = merged(pairs[:, 0], pairs[:, 1])
                starts.append(low.tolist())
                ends.append(high.tolist())
                for s, e in zip(low, high, strict=True):
                    keep[heads[i] + s : heads[i] + e] = False
            kept = []
            for i, n in enumerate(counts):
                mine = slice(heads[i], heads[i] + n)
                here = keep[mine]
                spots = zip(first[mine][here].tolist(), last[mine][here].tolist(), strict=True)
                kept.append(b" ".join([raw[a:b].tobytes() for a, b in spots]).decode())
            removed = [sum(b - a for a, b in zip(s, e, strict=True)) for s, e in zip(starts, ends, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(counts.astype(np.int64)),
                    pa.array(removed, pa.int64()), pa.array(starts, pa.list_(pa.int64())),
                    pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.string()),
                ],
                ["row_key", "doc_id", "n_words", "n_removed", "starts", "ends", "kept"],
            )

    plain = docs.select("row_key", "doc_id", "text")
    schema = T.StructType(plain.schema.fields[:2])
    for name, kind in (
        ("n_words", "long"), ("n_removed", "long"), ("starts", "array<long>"),
        ("ends", "array<long>"), ("kept", "string"),
    ):
        schema = schema.add(name, kind if "array" not in kind else T.ArrayType(T.LongType()))
    return plain.join(runs, "row_key", "left").select(
        "row_key", "doc_id", "text", "runs"
    ).mapInArrow(run, schema)
