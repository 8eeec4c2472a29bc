"""Long repeats: which windows of a fixed number of symbols occur more than once.

Symbols are the bytes or the words of a text. Every window of `length` symbols is owned by one
anchor, the run of `seed` symbols in it with the smallest hash (the leftmost of equals). Equal windows
have equal anchors at the same place in them, so windows need comparing with others of the same
anchor only, and an anchor is far rarer than a window. The windows that one occurrence of an anchor
owns start next to each other; the symbols they cover are its span. Occurrences with equal spans are
one class, whose windows all recur if it has two members. What is left, finding the windows shared by
different spans of one anchor, is up to the caller.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.llm.common import groups_of_rows
from loreloom.llm.hashing import U, joined, mix, prefix_sums, run_hash, word_hashes, word_spans
from loreloom.session import materialise


@dataclass(frozen=True)
class Unit:
    """What a symbol is, how long a window is, and how long an anchor."""

    words: bool
    length: int
    seed: int

    def symbols(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, tuple]:
        """Symbols of all texts, the number of them in each, and where words lie in the bytes."""
        raw, starts = joined(texts)
        if self.words:
            first, last, counts = word_spans(raw, starts)
            return word_hashes(raw, first, last), counts, (raw, first, last)
        inside = np.ones(len(raw), dtype=bool)
        inside[starts[1:] - 1] = False
        kept = raw[inside]
        return kept.astype(U) + U(1), np.diff(starts) - 1, (kept, None, None)


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Least of each `width` neighbours, by running minima of blocks from both sides."""
    size = len(values) - width + 1
    if size <= 0:
        return values[:0]
    padded = np.full(-(-len(values) // width) * width, np.iinfo(U).max, dtype=U)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:size], ahead[width - 1 : width - 1 + size])


@dataclass
class Anchors:
    """Anchors of a batch: the text each is in, its hash, the first window it owns, how many, and
    how far into that window it lies. Starts count symbols of the whole batch."""

    doc: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    owned: np.ndarray
    lead: np.ndarray


def anchors(symbols: np.ndarray, counts: np.ndarray, unit: Unit) -> Anchors:
    """The anchors of all windows of the texts of a batch."""
    none = np.zeros(0, dtype=np.int64)
    ends = np.cumsum(counts)
    heads = ends - counts
    if len(symbols) < unit.length or not (counts >= unit.length).any():
        return Anchors(none, none.view(U), none, none, none)
    sums = prefix_sums(symbols)
    at = np.arange(len(symbols) - unit.seed + 1)
    seeds = run_hash(sums, at, at + unit.seed)
    # High half of the hash first, then the place: the least is the leftmost of the least seeds.
    ranked = (seeds & U(0xFFFFFFFF00000000)) | at.astype(U)
    least = sliding_least(ranked, unit.length - unit.seed + 1)
    place = (least & U(0xFFFFFFFF)).astype(np.int64)
    doc = np.repeat(np.arange(len(counts)), np.maximum(counts - unit.length + 1, 0))
    windows = np.arange(len(doc)) - np.repeat(
        np.cumsum(np.maximum(counts - unit.length + 1, 0)) - np.maximum(counts - unit.length + 1, 0),
        np.maximum(counts - unit.length + 1, 0),
    ) + heads[doc]
    owner = place[windows]
    edge = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
    start = windows[edge]
    owned = np.diff(np.r_[edge, len(windows)])
    return Anchors(doc[edge], seeds[owner[edge]], start, owned, owner[edge] - start)


def span_hash(symbols: np.ndarray, found: Anchors, unit: Unit) -> np.ndarray:
    """Hash of each anchor's span and of where the anchor lies in it."""
    sums = prefix_sums(symbols, base=1)
    end = found.start + found.owned - 1 + unit.length
    here = run_hash(sums, found.start, end, base=1)
    return mix(here + found.owned.astype(U) * U(0x9E3779B97F4A7C15) + found.lead.astype(U))


def occurrences(docs: DataFrame, unit: Unit) -> DataFrame:
    """(row_key, doc_id, anchor, span, start, owned, lead) of all anchors of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups_of_rows(batches, "text"):
            symbols, counts, _ = unit.symbols(texts)
            found = anchors(symbols, counts, unit)
            if not len(found.doc):
                continue
            heads = np.cumsum(counts) - counts
            rows = pa.array(found.doc)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0).take(rows), batch.column(1).take(rows),
                    pa.array(found.hash.view(np.int64)),
                    pa.array(span_hash(symbols, found, unit).view(np.int64)),
                    pa.array((found.start - heads[found.doc]).astype(np.int64)),
                    pa.array(found.owned.astype(np.int32)), pa.array(found.lead.astype(np.int32)),
                ],
                ["row_key", "doc_id", "anchor", "span", "start", "owned", "lead"],
            )

    head = ", ".join(
        f"{f.name} {f.dataType.simpleString()}" for f in docs.select("row_key", "doc_id").schema
    )
    return docs.select("row_key", "doc_id", "text").mapInArrow(
        run, f"{head}, anchor long, span long, start long, owned int, lead int"
    )


def recurring(docs: DataFrame, unit: Unit, columns: list[str]) -> DataFrame:
    """The occurrences of anchors that occur more than once; `mixed` says if their spans differ.

    Anchors are counted with partial sums before they are shuffled; the occurrences then meet the
    recurring anchors in a plain equi-join, whose hot keys adaptive execution splits.
    """
    all_found = occurrences(docs, unit)
    often = materialise(
        all_found.groupBy("anchor")
        .agg(
            F.count(F.lit(1)).alias("c"), F.min("span").alias("least"), F.max("span").alias("most"),
        )
        .filter("c > 1")
        .select("anchor", (F.col("least") != F.col("most")).alias("mixed"))
    )
    return materialise(all_found.join(often, "anchor").select(*columns))


def merged(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The union of half-open intervals as disjoint ones that do not touch."""
    if not len(starts):
        return starts, ends
    order = np.argsort(starts, kind="stable")
    starts, ends = starts[order], np.maximum.accumulate(ends[order])
    fresh = np.r_[True, starts[1:] > ends[:-1]]
    return starts[fresh], ends[np.r_[np.flatnonzero(fresh)[1:] - 1, len(ends) - 1]]
