"""Approximate cosine top-k by an inverted file of coarse cells.

Centres are fitted on a bounded sample; every row belongs to the cell of its nearest centre, inside
its tenant. A query asks the cells of its nearest centres only: it travels once, with a bit for each
cell it asks, and blocks of `vector.vector_search` score it exactly on the rows of these cells. How many
cells are asked is chosen on the sample, so that the wanted recall is reached there; `recall` measures it against the
exact search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.operators.vector import MARK, vector_search

SAMPLE_ROWS = 16_384  # rows that centres are fitted on, at most
SAMPLE_BYTES = 64 << 20  # and their bytes
MOST_CENTRES = 4_096
ROUNDS = 12
CALIBRATED_ON = 256  # sample rows whose neighbours decide the number of probes


@dataclass(frozen=True)
class Centres:
    matrix: np.ndarray  # one unit vector per line
    probes: int  # cells a query asks


def _unit(matrix: np.ndarray) -> np.ndarray:
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return matrix / np.where(norms == 0, 1.0, norms)


def _sample(vectors: DataFrame, key: str) -> tuple[np.ndarray, np.ndarray]:
    """Unit vectors and tenants of the rows with the smallest hashes: the same for any layout."""
    width = vectors.agg(F.max(F.size("embedding"))).first()[0] or 1
    rows = max(1, min(SAMPLE_ROWS, SAMPLE_BYTES // (8 * width)))
    taken = vectors.filter(F.col("embedding").isNotNull()).orderBy(F.xxhash64(key), key).limit(rows)
    table = taken.select("game_id", "embedding").toArrow()
    flat = table.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return (
        _unit(flat.astype(np.float64).reshape(table.num_rows, -1)),
        np.array(table.column("game_id").to_pylist(), dtype=object),
    )


def _fitted(sample: np.ndarray, count: int) -> np.ndarray:
    """Spherical k-means; the first centres are spread over the sample."""
    centres = sample[np.linspace(0, len(sample) - 1, count).astype(int)]
    for _ in range(ROUNDS):
        own = np.argmax(sample @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, sample)
        empty = np.bincount(own, minlength=count) == 0
        centres = np.where(empty[:, None], centres, _unit(sums))
    return centres


def _probes(sample: np.ndarray, tenants: np.ndarray, centres: np.ndarray, k: int, target: float) -> int:
    """The fewest cells that hold the wanted share of the k nearest sample rows of the same tenant.

    Tenants are thinner in the sample than in the table, so their neighbours there are farther and
    the number is on the safe side.
    """
    asked = np.arange(0, len(sample), max(1, len(sample) // CALIBRATED_ON))
    nearness = sample[asked] @ centres.T
    cell = np.argmax(sample @ centres.T, axis=1)
    depth = np.argsort(np.argsort(-nearness, axis=1, kind="stable"), axis=1)
    needed = []
    for line, row in enumerate(asked):
        others = np.flatnonzero((tenants == tenants[row]) & (np.arange(len(sample)) != row))
        scores = sample[others] @ sample[row]
        best = others[np.argsort(-scores, kind="stable")[:k]]
        needed.append(depth[line, cell[best]])
    if not sum(map(len, needed)):
        return len(centres)
    return int(np.quantile(np.concatenate(needed), target, method="higher")) + 1


def fit_centres(
    vectors: DataFrame, key: str = "chunk_id", k: int = 5, target: float = 0.97,
    centres: int | None = None,
) -> Centres | None:
    """Centres for `vectors` (key, game_id, embedding), fitted on SAMPLE_ROWS rows at most."""
    total = vectors.filter(F.col("embedding").isNotNull()).count()
    if not total:
        return None
    sample, tenants = _sample(vectors, key)
    count = centres or int(np.clip(np.sqrt(total), 1, MOST_CENTRES))
    matrix = _fitted(sample, min(count, len(sample)))
    return Centres(matrix, _probes(sample, tenants, matrix, k, target))


def cell_marks(embedding: Column, centres: Centres, asks: bool) -> Column:
    """The number of the nearest centre in four bytes and, where a row `asks`, a bit per centre that tells
    whether it is among the nearest `probes`; none for a null vector."""
    matrix, count = centres.matrix.T, centres.probes

    @F.pandas_udf("binary")
    def marks(vectors: pd.Series) -> pd.Series:
        out = pd.Series([None] * len(vectors), index=vectors.index, dtype=object)
        have = vectors.notna()
        if have.any():
            near = _unit(np.vstack(vectors[have].to_list()).astype(np.float64)) @ matrix
            order = np.argsort(-near, axis=1, kind="stable")
            found = np.ascontiguousarray(order[:, :1].astype("<i4")).view(np.uint8)
            if asks:
                asked = np.zeros(near.shape, bool)
                np.put_along_axis(asked, order[:, :count], True, axis=1)
                found = np.concatenate([found, np.packbits(asked, axis=1, bitorder="little")], axis=1)
            out[have] = pd.Series([row.tobytes() for row in found], index=vectors.index[have])
        return out

    return marks(embedding)


def _celled(rows: DataFrame, centres: Centres | None, asks: bool) -> DataFrame:
    if centres is None:  # nothing was there to fit
        return rows
    marked = rows.withColumn(MARK, cell_marks(F.col("embedding"), centres, asks))
    marked = marked.filter(F.col("game_id").isNotNull() & F.col(MARK).isNotNull())
    # Rows of a cell together, and queries of a cell: these ask much the same cells.
    return marked.hint("rebalance", "game_id").sortWithinPartitions("game_id", MARK)


def assign(vectors: DataFrame, centres: Centres | None) -> DataFrame:
    """The index: every row with its cell, rows of a cell together; a large cell is split."""
    return _celled(vectors, centres, False)


def ivf_search(
    index: DataFrame, queries: DataFrame, centres: Centres | None, k: int = 5, key: str = "chunk_id"
) -> DataFrame:
    """query_id, key, ord, score, rank from the cells that each query asks (`index` from `assign`)."""
    return vector_search(index, _celled(queries, centres, True), k, key)


def recall(found: DataFrame, exact: DataFrame, key: str = "chunk_id") -> DataFrame:
    """query_id and the share of its exact results that were found."""
    hits = found.select("query_id", key, F.lit(1).alias("hit"))
    return (
        exact.select("query_id", key).join(hits, ["query_id", key], "left")
        .groupBy("query_id").agg(F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
    )
