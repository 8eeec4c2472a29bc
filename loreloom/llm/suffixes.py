"""Repeated byte strings, found in suffix arrays made by two-stage sorting.

Texts are cut into the spans of their anchors (see `repeats`). Equal spans need no sorting: all but
the first are repeats as a whole. The first occurrences of the different spans of an anchor are laid
out next to each other and their suffixes sorted in two stages: those smaller than their successor
are sorted directly, all others follow from the order of their successors by scanning the buckets of
the first byte from the smallest to the largest. Neighbours in that order with a common prefix of the
wanted length are the repeats.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.llm.common import groups_of_rows
from loreloom.llm.bpe import spans
from loreloom.llm.hashing import U, prefix_sums, run_hash
from loreloom.llm.repeats import Unit, merged, recurring
from loreloom.session import materialise

LENGTH, SEED = 100, 32
SPANS_PER_SHARD = 2048
SORTED_AT_ONCE = 1 << 19  # bytes of spans, besides a whole shard; sorting holds many times as much
SPANS_SENT = 1024  # spans that a Python worker is sent at once


def _packed(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Eight bytes from each place as one number, the first byte highest."""
    out = np.zeros(len(at), dtype=U)
    for k in range(8):
        out = (out << U(8)) | text[at + k].astype(U)
    return out


def _sorted_directly(text: np.ndarray, at: np.ndarray, depth: int) -> np.ndarray:
    """The places in the order of the `depth` bytes from them, eight bytes at a time."""
    order = np.argsort(_packed(text, at), kind="stable")
    at = at[order]
    first = _packed(text, at)
    group = np.cumsum(np.r_[False, first[1:] != first[:-1]])
    for step in range(8, depth, 8):
        tied = np.zeros(len(at), dtype=bool)
        same = group[1:] == group[:-1]
        tied[1:] |= same
        tied[:-1] |= same
        spot = np.flatnonzero(tied)
        if not len(spot):
            break
        key = _packed(text, at[spot] + step)
        line = np.lexsort((key, group[spot]))
        at[spot] = at[spot][line]
        key = key[line]
        fresh = np.zeros(len(at), dtype=bool)
        fresh[1:] = group[1:] != group[:-1]
        inner = np.r_[False, (key[1:] != key[:-1]) & (group[spot][1:] == group[spot][:-1])]
        fresh[spot[inner]] = True
        group = np.cumsum(fresh)
    return at


def suffix_order(text: np.ndarray, wanted: np.ndarray, depth: int) -> np.ndarray:
    """The marked places of `text` in the order of the `depth` bytes from them.

    `text` holds the spans with a zero after each, and zeros enough to read past the end; bytes are
    above zero. Only marked places and the successors they need are sorted.
    """
    size = len(text) - depth - 16
    here, after = text[:size], text[1 : size + 1]
    # Smaller than its successor: by the first differing byte to the right.
    differs = np.flatnonzero((here != after) | (here == 0))
    nearest = differs[np.minimum(np.searchsorted(differs, np.arange(size)), len(differs) - 1)]
    small = (here[nearest] < after[nearest]) | (here == 0)
    # Beyond the marked places, on to the next one that is sorted directly.
    ends = np.flatnonzero(small)
    marked = np.flatnonzero(wanted[:size])
    stop = ends[np.searchsorted(ends, marked)]
    cover = np.bincount(marked, minlength=size + 1) - np.bincount(stop + 1, minlength=size + 1)
    needed = np.cumsum(cover[:size]) > 0
    direct = _sorted_directly(text, np.flatnonzero(needed & small), depth)
    induced = needed & ~small
    by_byte = text[direct]
    edges = np.searchsorted(by_byte, np.arange(257))
    waiting: list[list[np.ndarray]] = [[] for _ in range(256)]
    out = []

    def before(places: np.ndarray) -> np.ndarray:
        prior = places[places > 0] - 1
        return prior[induced[prior]]

    for byte in range(256):
        bucket = []
        step = np.concatenate(waiting[byte]) if waiting[byte] else np.zeros(0, dtype=np.int64)
        waiting[byte] = []
        while len(step):
            bucket.append(step)
            prior = before(step)
            step = prior[text[prior] == byte]
        bucket.append(direct[edges[byte] : edges[byte + 1]])
        places = np.concatenate(bucket)
        if not len(places):
            continue
        out.append(places)
        prior = before(places)
        prior = prior[text[prior] > byte]
        if not len(prior):
            continue
        value = text[prior]
        line = np.argsort(value, kind="stable")
        prior, value = prior[line], value[line]
        cuts = np.flatnonzero(np.r_[True, value[1:] != value[:-1]])
        for low, high in zip(cuts, [*cuts[1:], len(value)], strict=True):
            waiting[value[low]].append(prior[low:high])
    order = np.concatenate(out) if out else np.zeros(0, dtype=np.int64)
    return order[wanted[order]]


def common_prefix(text: np.ndarray, order: np.ndarray, most: int) -> np.ndarray:
    """Bytes that each place but the first has in common with the one before, `most` at most."""
    out = np.zeros(max(len(order) - 1, 0), dtype=np.int64)
    alive = np.arange(len(out))
    for step in range(0, most, 8):
        if not len(alive):
            break
        a, b = _packed(text, order[alive] + step), _packed(text, order[alive + 1] + step)
        apart = a ^ b
        whole = apart == 0
        width = np.zeros(len(alive), dtype=np.int64)
        rest = apart[~whole]
        lead = np.zeros(len(rest), dtype=np.int64)
        for k in range(1, 8):
            lead += (rest >> U(8 * (8 - k))) == 0
        width[whole], width[~whole] = 8, lead
        out[alive] += width
        alive = alive[whole]
    return np.minimum(out, most)


def repeated_starts(
    data: np.ndarray, sizes: np.ndarray, marks: np.ndarray, counts: np.ndarray, rank: np.ndarray,
    length: int,
) -> np.ndarray:
    """Which marked starts of spans begin a string that begins earlier too.

    `data` holds the spans one after another, `marks` the places marked in each, `counts` of them;
    `rank` orders all marked starts from the earliest.
    """
    text = np.zeros(len(data) + len(sizes) + length + 16, dtype=np.uint8)
    heads = np.cumsum(sizes + 1) - sizes - 1
    text[spans(heads, sizes)] = data + 1
    at = np.repeat(heads, counts) + marks
    wanted = np.zeros(len(text), dtype=bool)
    wanted[at] = True
    number = np.zeros(len(text), dtype=np.int32)
    number[at] = np.arange(len(at))
    order = suffix_order(text, wanted, length)
    equal = common_prefix(text, order, length) >= length
    run = np.cumsum(np.r_[False, ~equal]) if len(order) else np.zeros(0, dtype=np.int64)
    which = number[order]
    least = np.full(int(run[-1]) + 1 if len(run) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, run, rank[which])
    out = np.zeros(len(at), dtype=bool)
    out[which] = rank[which] > least[run]
    return out


def _flat(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """The numbers in a column of binaries, one after another, and how many each holds."""
    _, offsets, data = column.buffers()
    edge = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[edge[0] : edge[-1]] if len(column) else np.zeros(0, np.uint8)
    return raw.view(kind), np.diff(edge).astype(np.int64) // np.dtype(kind).itemsize


def _binary(data: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.r_[0, np.cumsum(sizes)].astype(np.int32)
    return pa.BinaryArray.from_buffers(
        pa.binary(), len(sizes), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(data.tobytes())]
    )


def _laid_out(docs: DataFrame, reps: DataFrame, unit: Unit) -> DataFrame:
    """Spans as rows for sorting: (anchor, shard, row_key, doc_id, start, marks, bytes).

    An anchor with very many different spans is dealt to several shards: each start goes to the shard
    of the hash of its window, so equal windows still meet.
    """
    per_doc = reps.groupBy("row_key").agg(
        F.collect_list(F.struct("anchor", "start", "owned", "shards")).alias("seeds")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups_of_rows(batches, "text"):
            symbols, counts, (raw, _, _) = unit.symbols(texts)
            heads = np.cumsum(counts) - counts
            seeds = batch.column(2)
            per_text = np.diff(seeds.offsets.to_numpy())
            flat = seeds.flatten()
            anchor, start, owned, shards = (
                flat.field(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)
            )
            doc = np.repeat(np.arange(len(texts)), per_text)
            # A row per span, or per span and shard that some of its windows go to.
            seat = np.repeat(np.arange(len(doc)), owned)
            mark = np.arange(len(seat)) - np.repeat(np.cumsum(owned) - owned, owned)
            shard = np.zeros(len(seat), dtype=np.int64)
            many = np.flatnonzero(shards[seat] > 1)
            if len(many):
                low = (heads[doc] + start)[seat[many]] + mark[many]
                sums = prefix_sums(symbols, base=1)
                window = run_hash(sums, low, low + unit.length, base=1)
                shard[many] = (window % shards[seat[many]].astype(U)).astype(np.int64)
                order = np.lexsort((mark, shard, seat))
                seat, mark, shard = seat[order], mark[order], shard[order]
            edge = np.flatnonzero(
                np.r_[True, (seat[1:] != seat[:-1]) | (shard[1:] != shard[:-1])][: len(seat)]
            )
            bounds = np.r_[edge, len(seat)]
            marks = mark.astype(np.int16)
            for first in range(0, len(edge), 10_000):
                rows = np.arange(first, min(first + 10_000, len(edge)))
                mine = seat[edge[rows]]
                low = heads[doc[mine]] + start[mine]
                size = owned[mine] - 1 + unit.length
                whose = pa.array(doc[mine])
                cut = marks[bounds[rows[0]] : bounds[rows[-1] + 1]]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor[mine]), pa.array(shard[edge[rows]]),
                        batch.column(0).take(whose), batch.column(1).take(whose),
                        pa.array(start[mine]),
                        _binary(cut.view(np.uint8), np.diff(bounds[rows[0] : rows[-1] + 2]) * 2),
                        _binary(raw[spans(low, size)], size),
                    ],
                    ["anchor", "shard", "row_key", "doc_id", "start", "marks", "span"],
                )

    key, ids = (docs.schema[c].dataType.simpleString() for c in ("row_key", "doc_id"))
    return (
        docs.join(per_doc, "row_key").select("row_key", "doc_id", "seeds", "text").mapInArrow(
            run,
            f"anchor long, shard long, row_key {key}, doc_id {ids}, start long, marks binary, "
            "span binary",
        )
    )


def _sorted_repeats(laid: DataFrame, length: int) -> DataFrame:
    """(row_key, start, end) runs of the given spans covered by windows that also start earlier."""
    key = laid.schema["row_key"].dataType.simpleString()

    def found(rows: pa.Table) -> pa.RecordBatch:
        rows = rows.combine_chunks()
        column = lambda name: rows[name].chunk(0)
        f, r = (column("row_key").field(i).to_numpy() for i in range(2))
        by_place = pa.table({"doc_id": column("doc_id"), "f": f, "r": r})
        keys = [(name, "ascending") for name in by_place.column_names]
        order = pc.sort_indices(by_place, keys, null_placement="at_end").to_numpy().astype(np.int64)
        other = np.r_[False, (f[order][1:] != f[order][:-1]) | (r[order][1:] != r[order][:-1])]
        doc = np.zeros(len(order), dtype=np.int64)
        doc[order] = np.cumsum(other)
        data, sizes = _flat(column("span"), np.uint8)
        marks, counts = _flat(column("marks"), np.int16)
        start = np.repeat(column("start").to_numpy(), counts) + marks
        whose = np.repeat(doc, counts)
        order = np.lexsort((start, whose))
        fresh = np.r_[False, np.diff(start[order]) != 0] | np.r_[False, np.diff(whose[order]) != 0]
        rank = np.zeros(len(order), dtype=np.int64)
        rank[order] = np.cumsum(fresh)
        hit = repeated_starts(data, sizes, marks.astype(np.int64), counts, rank, length)
        row, start = np.repeat(np.arange(len(sizes)), counts)[hit], start[hit]
        # Windows of a span that overlap or touch are one run.
        fresh = np.r_[True, (row[1:] != row[:-1]) | (start[1:] > start[:-1] + length)][: len(row)]
        last = np.r_[fresh[1:], True][: len(row)]
        keys = column("row_key").take(pa.array(row[fresh]))
        return pa.RecordBatch.from_arrays(
            [keys, pa.array(start[fresh]), pa.array(start[last] + length)], ["row_key", "start", "end"]
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        size = 0
        for batch in batches:
            held.append(batch)
            size += batch.column(batch.schema.get_field_index("span")).nbytes
            if size < SORTED_AT_ONCE:
                continue
            # All but the last shard, of which there may be more to come.
            rows = pa.Table.from_batches(held)
            anchor, shard = rows["anchor"].to_numpy(), rows["shard"].to_numpy()
            whole = np.flatnonzero((anchor != anchor[-1]) | (shard != shard[-1]))
            done = int(whole[-1]) + 1 if len(whole) else 0
            if done:
                yield found(rows.slice(0, done))
            held = rows.slice(done).combine_chunks().to_batches()
            size = sum(b.column(b.schema.get_field_index("span")).nbytes for b in held)
        if held:
            yield found(pa.Table.from_batches(held))

    dealt = laid.repartition("anchor", "shard").sortWithinPartitions("anchor", "shard")
    return materialise(dealt.mapInArrow(run, f"row_key {key}, start long, end long"), SPANS_SENT)


def earlier_runs(docs: DataFrame, unit: Unit) -> DataFrame:
    """(row_key, start, end) runs of bytes covered by windows that also start earlier; runs overlap.

    Earlier is a smaller doc_id (null after all others), the place of the row for equal ids, and the
    smaller start within a row.
    """
    seats = recurring(docs, unit, ["anchor", "span", "row_key", "doc_id", "start", "owned", "mixed"])
    place = F.struct(F.col("doc_id").isNull().alias("x"), "doc_id", "row_key", "start")
    classes = materialise(
        seats.groupBy("anchor", "span", "mixed", "owned").agg(F.min(place).alias("first"))
    )
    end = (F.col("start") + F.col("owned") - 1 + unit.length).alias("end")
    firsts = classes.select("anchor", "span", F.col("first.row_key").alias("k"), F.col("first.start").alias("s"))
    copies = (
        seats.join(firsts, ["anchor", "span"])
        .filter("NOT (row_key = k AND start = s)").select("row_key", "start", end)
    )
    mixed = classes.filter("mixed")
    shards = mixed.groupBy("anchor").agg(
        F.ceil(F.count(F.lit(1)) / SPANS_PER_SHARD).cast("long").alias("shards")
    )
    reps = materialise(
        mixed.join(shards, "anchor").select("anchor", "first.row_key", "first.start", "owned", "shards")
    )
    found = _sorted_repeats(_laid_out(docs, reps, unit), unit.length)
    return materialise(copies).unionByName(found)


def drop_repeated_bytes(docs: DataFrame, length: int = LENGTH, seed: int = SEED) -> DataFrame:
    """Per row of `docs` (row_key, doc_id, text): row_key, doc_id, n_bytes, n_removed, starts, ends, kept.

    Removes every byte of the UTF-8 text covered by a string of `length` bytes that also starts
    earlier; strings are judged on the texts as given, may overlap, and never cross texts. `starts`
    and `ends` are the maximal removed runs, `kept` the bytes left (binary, as a run may end inside a
    letter). Null and empty texts have no bytes; texts shorter than `length` stay whole. Of repeated
    rows all but the first are removed. An empty table gives an empty table.
    """
    unit = Unit(words=False, length=length, seed=min(seed, length))
    runs = (
        earlier_runs(docs, unit).groupBy("row_key")
        .agg(F.collect_list(F.struct("start", "end")).alias("runs"))
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups_of_rows(batches, "text"):
            found = batch.column(batch.schema.get_field_index("runs")).to_pylist()
            sizes, removed, starts, ends, kept = [], [], [], [], []
            for value, spans in zip(texts, found, strict=True):
                raw = (value or "").encode("utf-8", "surrogatepass")
                pairs = np.array([(s["start"], s["end"]) for s in spans or ()], dtype=np.int64)
                pairs = pairs.reshape(-1, 2)
                low, high = merged(pairs[:, 0], pairs[:, 1])
                edges = [0, *np.stack([low, high], axis=1).ravel().tolist(), len(raw)]
                kept.append(b"".join(raw[edges[i] : edges[i + 1]] for i in range(0, len(edges), 2)))
                sizes.append(len(raw))
                removed.append(int((high - low).sum()))
                starts.append(low.tolist())
                ends.append(high.tolist())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1), pa.array(sizes, pa.int64()),
                    pa.array(removed, pa.int64()), pa.array(starts, pa.list_(pa.int64())),
                    pa.array(ends, pa.list_(pa.int64())), pa.array(kept, pa.binary()),
                ],
                ["row_key", "doc_id", "n_bytes", "n_removed", "starts", "ends", "kept"],
            )

    plain = docs.select("row_key", "doc_id", "text")
    schema = T.StructType(plain.schema.fields[:2]).add("n_bytes", "long").add("n_removed", "long")
    for name in ("starts", "ends"):
        schema = schema.add(name, T.ArrayType(T.LongType()))
    schema = schema.add("kept", "binary")
    return plain.join(runs, "row_key", "left").select(
        "row_key", "doc_id", "text", "runs"
    ).mapInArrow(run, schema)
