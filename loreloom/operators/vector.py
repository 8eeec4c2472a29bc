"""Exact cosine top-k per query inside a tenant.

Vectors and queries are packed into matrix blocks per tenant, block pairs meet by an equi-join on
the tenant, and one matrix product per pair keeps k rows per query. Single pairs never become
rows; what travels is query blocks one way and k rows per query and block the other.
"""

from __future__ import annotations

from collections.abc import Hashable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.operators.topk import top_k
from loreloom.session import fits_broadcast, is_written, join_small, materialise

BLOCK_BYTES = 1 << 20
SLICE_BYTES = 4 << 20  # of a tenant's vectors that its query blocks are sent to at once
MOST_SLICES = 16
PAIR_ROWS = 4  # pairs of blocks that a Python worker holds at once
LEADERS_BYTES = 32 << 20  # of best scores that a task remembers
DIGITS = 6  # scores are compared rounded
MARK = "__mark"  # column with the cell of a vector, and with the cells that a query asks


def _kind(vectors: DataFrame) -> type:
    single = vectors.schema["embedding"].dataType.simpleString() == "array<float>"
    return np.float32 if single else np.float64


def _unit(matrix: bytes, rows: int, kind: type) -> np.ndarray:
    """The unit vectors of a block, as doubles."""
    vectors = np.frombuffer(matrix, dtype=kind).astype(np.float64).reshape(rows, -1)
    norms = np.linalg.norm(vectors, axis=1, keepdims=True)
    return vectors / np.where(norms == 0, 1.0, norms)


def pack_blocks(vectors: DataFrame, key: str, prefix: str) -> DataFrame:
    """Rows (key, ord, game_id, embedding) to blocks of vectors per tenant, as wide as they come.

    Marks, all of one length, are put in a row as well.
    """
    kind, marked = _kind(vectors), MARK in vectors.columns
    key_type = vectors.schema[key].dataType.simpleString()
    schema = (
        f"game_id string, {prefix}ids array<{key_type}>, {prefix}ords array<bigint>, "
        f"{prefix}matrix binary" + (f", {prefix}marks binary" if marked else "")
    )

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(pc.is_valid(batch.column("embedding")))
            if batch.num_rows == 0:
                continue
            flat = batch.column("embedding").flatten().to_numpy(zero_copy_only=False)
            matrix = flat.astype(kind).reshape(batch.num_rows, -1)
            games = np.array(batch.column("game_id").to_pylist(), dtype=object)
            ids, ords = batch.column("key"), batch.column("ord")
            step = max(1, BLOCK_BYTES // (8 * matrix.shape[1]))  # of the doubles they become
            marks = np.array(batch.column(MARK).to_pylist() if marked else [], dtype=object)
            out: dict[str, list] = {"g": [], "i": [], "o": [], "m": [], "k": []}
            for game in sorted(set(games)):
                rows = np.flatnonzero(games == game)
                for start in range(0, len(rows), step):
                    part = rows[start : start + step]
                    out["g"].append(game)
                    out["i"].append(ids.take(pa.array(part)).to_pylist())
                    out["o"].append(ords.take(pa.array(part)).to_pylist())
                    out["m"].append(matrix[part].tobytes())
                    out["k"].append(b"".join(marks[part]) if marked else None)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(out["g"], pa.string()),
                    pa.array(out["i"], pa.list_(ids.type)),
                    pa.array(out["o"], pa.list_(pa.int64())),
                    pa.array(out["m"], pa.binary()),
                    *([pa.array(out["k"], pa.binary())] if marked else []),
                ],
                names=["game_id", *[prefix + n for n in ("ids", "ords", "matrix", "marks")[: 4 if marked else 3]]],
            )

    chosen = vectors.select(
        F.col(key).alias("key"), F.col("ord").cast("bigint").alias("ord"),
        F.col("game_id").cast("string").alias("game_id"), "embedding", *([MARK] if marked else []),
    ).filter(F.col("game_id").isNotNull())
    return chosen.mapInArrow(pack, schema)


def best_rows(scores: np.ndarray, ords: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best scores, equal scores by `ords`."""
    if len(scores) > k:
        kept = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        kept = np.arange(len(scores))
    return kept[np.lexsort((ords[kept], -scores[kept]))][:k]


def _best_of_each(scores: np.ndarray, ords: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lines, columns and scores of the `best_rows` of each line."""
    best = [best_rows(line, ords, k) for line in scores]
    line, column = np.repeat(np.arange(len(best)), [len(b) for b in best]), np.concatenate(best)
    return line, column, scores[line, column]


class Leaders:
    """The k best scores of each query that a task has seen, so that later blocks give only what may enter.

    Blocks of queries are known by the ids of their queries. Those not met for longest are forgotten
    beyond LEADERS_BYTES; then more rows leave the task, never fewer.
    """

    def __init__(self, k: int, least: float = -np.inf):
        self.k, self.least, self.held, self.size = k, least, {}, 0

    def enter(self, queries: Hashable, scores: np.ndarray, ords: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lines, columns and rounded scores of the k best of each line (equal scores by `ords`) that may
        be among the k best of their query. Scores below `least` do not count."""
        lines, width = scores.shape
        best = self.held.pop(queries, None)
        if best is None:
            best = np.full((lines, self.k), -np.inf)
            floor = np.full(lines, -np.inf)
            if width > self.k:
                floor = np.round(np.partition(scores, width - self.k, axis=1)[:, width - self.k], DIGITS)
        else:
            self.size -= best.nbytes
            floor = best[:, 0]
        # Rounding moves a score by less than a unit of the last digit.
        line, column = np.nonzero(scores >= np.maximum(floor - 10.0**-DIGITS, self.least)[:, None])
        value = np.round(scores[line, column], DIGITS)
        order = np.lexsort((ords[column], -value, line))
        line, column, value = line[order], column[order], value[order]
        place = np.arange(len(line)) - np.searchsorted(line, line)
        first = place < self.k
        line, column, value, place = line[first], column[first], value[first], place[first]
        entering = np.full((lines, self.k), -np.inf)
        entering[line, place] = value
        best = np.partition(np.concatenate([best, entering], axis=1), self.k, axis=1)[:, self.k :].copy()
        self.held[queries] = best
        self.size += best.nbytes
        while self.size > LEADERS_BYTES:
            self.size -= self.held.pop(next(iter(self.held))).nbytes
        stays = value >= best[line, 0]
        return line[stays], column[stays], value[stays]


def met(left: DataFrame, right: DataFrame, size: str = "v_matrix", ids: str = "v_ids") -> DataFrame:
    """Pairs of blocks of the same tenant; `size` and `ids` are columns of the left ones.

    Where neither side can be broadcast, a tenant's vectors are spread over slices of
    SLICE_BYTES and its query blocks repeated per slice: those of a small tenant travel once.
    """
    if fits_broadcast(right):
        return left.join(F.broadcast(right), "game_id")
    left = left if is_written(left) else materialise(left)
    if fits_broadcast(left):
        return F.broadcast(left).join(right, "game_id")
    slices = F.ceil(F.sum(F.octet_length(size)) / SLICE_BYTES).cast("int")
    sizes = materialise(
        left.groupBy("game_id").agg(F.greatest(F.lit(1), F.least(F.lit(MOST_SLICES), slices)).alias("__slices"))
    )
    own = F.pmod(F.xxhash64(ids), F.col("__slices")).cast("int")
    dealt = join_small(left, sizes, ["game_id"]).withColumn("__slice", own).drop("__slices")
    repeated = join_small(right, sizes, ["game_id"]).withColumn(
        "__slice", F.explode(F.sequence(F.lit(0), F.col("__slices") - 1))
    ).drop("__slices")
    return dealt.join(repeated.hint("merge"), ["game_id", "__slice"]).drop("__slice")


def _asked(q: np.ndarray, v: np.ndarray, q_marks: bytes, v_marks: bytes) -> np.ndarray:
    """Scores of the vectors in the cells that a query asks; -inf elsewhere."""
    cells = np.frombuffer(v_marks, "<i4")
    bits = np.frombuffer(q_marks, np.uint8).reshape(len(q), -1)[:, 4:]
    scores = np.full((len(q), len(v)), -np.inf)
    order = np.argsort(cells, kind="stable")
    for own in np.split(order, np.flatnonzero(np.diff(cells[order])) + 1):
        cell = cells[own[0]]
        lines = np.flatnonzero(bits[:, cell >> 3] >> (cell & 7) & 1)
        if len(lines):
            scores[lines[:, None], own] = q[lines] @ v[own].T
    return scores


def vector_search(
    vectors: DataFrame, queries: DataFrame, k: int = 5, key: str = "chunk_id"
) -> DataFrame:
    """query_id, key, ord, score, rank.

    `vectors` has key, ord, game_id, embedding; `queries` has query_id, game_id, embedding. Where both
    bring a MARK, a query meets the vectors of the cells it asks.
    """
    marked = MARK in vectors.columns
    query_type = queries.schema["query_id"].dataType.simpleString()
    key_type = vectors.schema[key].dataType.simpleString()
    v_kind, q_kind = _kind(vectors), _kind(queries)
    left = materialise(pack_blocks(vectors, key, "v_"))
    right = materialise(pack_blocks(queries.withColumn("ord", F.lit(0)), "query_id", "q_"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        leaders = Leaders(k, least=np.finfo(np.float64).min)
        for batch in batches:
            for row in range(batch.num_rows):
                cell = {n: batch.column(n)[row] for n in batch.schema.names if n != "game_id"}
                q_ids, v_ids = cell["q_ids"].values, cell["v_ids"].values
                v_ords = cell["v_ords"].values.to_numpy(zero_copy_only=False).astype(np.int64)
                q = _unit(cell["q_matrix"].as_buffer(), len(q_ids), q_kind)
                v = _unit(cell["v_matrix"].as_buffer(), len(v_ids), v_kind)
                scores = _asked(q, v, *(cell[n].as_buffer() for n in ("q_marks", "v_marks"))) if marked else q @ v.T
                if np.isnan(q).any() or np.isnan(v).any():
                    line, column, value = _best_of_each(np.round(scores, DIGITS), v_ords, k)
                    there = value != -np.inf
                    line, column, value = line[there], column[there], value[there]
                else:
                    line, column, value = leaders.enter(tuple(q_ids.to_pylist()), scores, v_ords)
                if len(line):
                    yield pa.RecordBatch.from_arrays(
                        [q_ids.take(pa.array(line)), v_ids.take(pa.array(column)),
                         pa.array(v_ords[column]), pa.array(value)],
                        names=["query_id", key, "ord", "score"],
                    )

    pairs = met(left, right)
    found = pairs.mapInArrow(
        score, f"query_id {query_type}, {key} {key_type}, ord bigint, score double"
    )
    best = top_k(found, ["query_id"], [F.desc("score"), F.asc("ord")], k)
    return materialise(best, batch_rows=PAIR_ROWS)
