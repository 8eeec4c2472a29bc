"""Hard negatives for contrastive training by a vertical scan of quantised vectors.

Anchors are scored against all rows, in cells of bounded size: rows and anchors are dealt to slices
by a hash of their place, each slice of rows meets each slice of anchors in one cell. In a cell the
rows lie by dimension. An anchor reads the dimensions in descending order of its own magnitudes. After
every few of them the least and the most that the remaining ones can add (from the smallest and
largest component of each dimension in the cell) bound the score of every row, and a bitmap drops the
candidates that can no longer matter; what is left at the end has its exact score.

The scan runs twice: for the positives of each anchor, then for the windows of scores that the
positives open for negatives. Only the first few rows of each anchor or window leave a cell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from loreloom.llm.common import keyed
from loreloom.operators.topk import top_k
from loreloom.session import materialise

SCALE = 256
POSITIVES = 5
NEGATIVES = 5
LOWEST_PERCENT = 80
ROWS_PER_CELL = 1 << 15
ANCHORS_PER_CELL = 1 << 12
STRIDE = 8  # dimensions read between two looks at the bounds
EXACT = float(1 << 53)

PLACE = pa.struct([("f", pa.int64()), ("r", pa.int64())])
FOUND = {
    "positive": pa.schema([
        ("anchor_key", PLACE), ("anchor_id", pa.int64()), ("positive_key", PLACE),
        ("positive_id", pa.int64()), ("positive_score", pa.int64()),
    ]),
    "negative": pa.schema([
        ("anchor_key", PLACE), ("positive_score", pa.int64()), ("negative_key", PLACE),
        ("negative_id", pa.int64()), ("negative_score", pa.int64()),
    ]),
}


def usable(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """(row_key, vec_id, label, q) of the rows that take part; q holds floor(scale * x)."""
    sound = F.forall(
        "embedding",
        lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")),
    )
    parts = F.transform("embedding", lambda x: F.floor(x.cast("double") * float(scale)))
    return vectors.filter(
        F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & sound
    ).select("row_key", "vec_id", "label", parts.alias("q"))


def _slices(rows: int, most: int, wanted: int) -> int:
    return max(1, -(-rows // most), min(wanted, -(-rows // 1024)))


def cells(rows: DataFrame, anchors: DataFrame, wanted: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with (i, j, width): slice i of the rows meets slice j of the anchors.

    A cell has about ROWS_PER_CELL rows and ANCHORS_PER_CELL anchors at most, however they cluster by
    label or value; small tables are cut finer, so that all cores have work. Vectors meet those of the
    same number of dimensions only.
    """
    n_rows, n_anchors = rows.count(), anchors.count()
    up, across = _slices(n_rows, ROWS_PER_CELL, wanted), _slices(n_anchors, ANCHORS_PER_CELL, 1)
    slot = lambda n: F.pmod(F.xxhash64("row_key"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    width = F.size("q").alias("width")
    left = rows.select("*", slot(up).alias("i"), width).withColumn("j", every(across))
    right = anchors.select("*", slot(across).alias("j"), width).withColumn("i", every(up))
    return left, right


def _matrix(table: pa.Table, dtype) -> np.ndarray:
    """Components of the rows, one line per dimension."""
    flat = table.column("q").combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return np.ascontiguousarray(flat.reshape(table.num_rows, -1).T.astype(dtype))


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).combine_chunks().to_numpy(zero_copy_only=False)


def _places(table: pa.Table) -> np.ndarray:
    """The places of the rows as comparable pairs."""
    both = table.column("row_key").combine_chunks()
    out = np.empty(table.num_rows, dtype=[("f", "<i8"), ("r", "<i8")])
    out["f"], out["r"] = both.field("f").to_numpy(), both.field("r").to_numpy()
    return out


class Columns:
    """The rows of a cell by dimension, and what each dimension can add at least and at most."""

    def __init__(self, rows: pa.Table, anchors: pa.Table) -> None:
        whole = _matrix(rows, np.int64)
        asked = _matrix(anchors, np.int64)
        width = max(len(whole), 1)
        peak = float(np.abs(whole.astype(float)).max(initial=1)) * float(
            np.abs(asked.astype(float)).max(initial=1)
        )
        # Doubles hold the sums exactly below 2**53 and multiply faster.
        self.kind = np.float64 if 100 * peak * width < EXACT else np.int64
        self.matrix = whole.astype(self.kind)
        self.asked = asked.astype(self.kind)
        self.low, self.high = self.matrix.min(axis=1), self.matrix.max(axis=1)
        self.bounded = self.kind is np.float64

    def scan(self, anchor: int, alive: np.ndarray, keep) -> tuple[np.ndarray, np.ndarray]:
        """Rows left of the bitmap `alive`, and their exact scores.

        `keep` takes the lower and upper bounds of the rows in question and says which may matter.
        """
        weights = self.asked[:, anchor]
        order = np.argsort(-np.abs(weights), kind="stable")
        a, b = weights[order] * self.low[order], weights[order] * self.high[order]
        least = np.r_[np.cumsum(np.minimum(a, b)[::-1])[::-1], 0]
        most = np.r_[np.cumsum(np.maximum(a, b)[::-1])[::-1], 0]
        at = np.flatnonzero(alive)
        partial = np.zeros(len(at), dtype=self.kind)
        for start in range(0, len(order), STRIDE):
            dims = order[start : start + STRIDE]
            if not len(at):
                break
            if 2 * len(at) > len(alive):
                partial = partial + (weights[dims] @ self.matrix[dims])[at]
            else:
                partial = partial + weights[dims] @ self.matrix[np.ix_(dims, at)]
            end = start + len(dims)
            if self.bounded:
                stay = keep(partial + least[end], partial + most[end])
                at, partial = at[stay], partial[stay]
        if not self.bounded and len(at):
            stay = keep(partial, partial)
            at, partial = at[stay], partial[stay]
        return at, partial.astype(np.int64)


def _kth(values: np.ndarray, k: int):
    """The k-th largest value, None if there are fewer."""
    return None if len(values) < k else np.partition(values, len(values) - k)[len(values) - k]


def _first(ids: np.ndarray, places: np.ndarray, scores: np.ndarray, k: int) -> np.ndarray:
    """Positions of the first k by descending score, then id, then place."""
    low = _kth(scores, k)
    some = np.arange(len(scores)) if low is None else np.flatnonzero(scores >= low)
    return some[np.lexsort((places["r"][some], places["f"][some], ids[some], -scores[some]))][:k]


def _taken(table: pa.Table, name: str, at: list[int]) -> pa.ChunkedArray:
    return table.column(name).take(pa.array(at, pa.int64()))


def _positives(k: int):
    """Scan of a cell for the first k rows of each anchor's label."""

    def keep(low: np.ndarray, high: np.ndarray) -> np.ndarray:
        least = _kth(low, k)
        return np.ones(len(low), dtype=bool) if least is None else high >= least

    def scan(rows: pa.Table, anchors: pa.Table) -> list:
        ids, labels, places = _numbers(rows, "vec_id"), _numbers(rows, "label"), _places(rows)
        asked_labels, asked_places = _numbers(anchors, "label"), _places(anchors)
        store = Columns(rows, anchors)
        asked, found, totals = [], [], []
        for n in range(anchors.num_rows):
            alive = (labels == asked_labels[n]) & (places != asked_places[n])
            at, scores = store.scan(n, alive, keep)
            best = _first(ids[at], places[at], scores, k)
            asked += [n] * len(best)
            found += at[best].tolist()
            totals += scores[best].tolist()
        return [
            _taken(anchors, "row_key", asked), _taken(anchors, "vec_id", asked),
            _taken(rows, "row_key", found), _taken(rows, "vec_id", found), pa.array(totals, pa.int64()),
        ]

    return scan


def _negatives(k: int, percent: int):
    """Scan of a cell for the first k rows of other labels in each window below a positive score."""

    def scan(rows: pa.Table, anchors: pa.Table) -> list:
        ids, labels, places = _numbers(rows, "vec_id"), _numbers(rows, "label"), _places(rows)
        asked_labels, tops = _numbers(anchors, "label"), anchors.column("tops").to_pylist()
        store = Columns(rows, anchors)
        asked, windows, found, totals = [], [], [], []
        for n in range(anchors.num_rows):

            def keep(low: np.ndarray, high: np.ndarray, n=n) -> np.ndarray:
                stay = np.zeros(len(low), dtype=bool)
                for top in tops[n]:
                    sure = low[(100 * low >= percent * top) & (high <= top)]
                    least = _kth(sure, k)
                    near = (100 * high >= percent * top) & (low <= top)
                    stay |= near if least is None else near & (high >= least)
                return stay

            at, scores = store.scan(n, labels != asked_labels[n], keep)
            for top in tops[n]:
                inside = np.flatnonzero((100 * scores >= percent * top) & (scores <= top))
                best = inside[_first(ids[at[inside]], places[at[inside]], scores[inside], k)]
                asked += [n] * len(best)
                windows += [top] * len(best)
                found += at[best].tolist()
                totals += scores[best].tolist()
        return [
            _taken(anchors, "row_key", asked), pa.array(windows, pa.int64()),
            _taken(rows, "row_key", found), _taken(rows, "vec_id", found), pa.array(totals, pa.int64()),
        ]

    return scan


def _scanned(rows: DataFrame, anchors: DataFrame, kind: str, scan) -> DataFrame:
    """What `scan` finds in all cells: of the columns of FOUND[kind]."""
    left, right = cells(rows, anchors, 4 * rows.sparkSession.sparkContext.defaultParallelism)
    by, shape = ["width", "i", "j"], FOUND[kind]

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        if not a.num_rows or not b.num_rows:
            return shape.empty_table()
        return pa.Table.from_arrays(scan(a, b), schema=shape)

    return left.groupBy(*by).cogroup(right.groupBy(*by)).applyInArrow(run, from_arrow_schema(shape))


def mine_hard_negatives(
    vectors: DataFrame, is_anchor: Column, positives: int = POSITIVES, negatives: int = NEGATIVES,
    percent: int = LOWEST_PERCENT, scale: int = SCALE,
) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    `vectors` has vec_id, label and embedding (arrays of float or double). A row without id, label or
    vector, or with a null or non-finite component, takes no part. Components become
    floor(scale * x), scores are integer inner products modulo 2**64; vectors of another number of
    dimensions than the anchor's are not scored with it. The positives of an anchor are the first
    rows of its label by descending score, then smaller id; the negatives of a positive the first
    rows of other labels with percent * positive <= 100 * negative <= 100 * positive. Repeated rows
    are rows of their own: each is an anchor, a positive and a negative, ordered by place where id and
    score are equal. An empty table, or one without anchors, gives no rows.
    """
    rows = materialise(usable(keyed(vectors.select("vec_id", "label", "embedding")), scale))
    anchors = materialise(rows.filter(is_anchor))
    found = _scanned(rows, anchors, "positive", _positives(positives))
    order = lambda kind: [F.desc(f"{kind}_score"), F.asc(f"{kind}_id"), F.asc(f"{kind}_key")]
    chosen = materialise(top_k(found, ["anchor_key"], order("positive"), positives, "nth"))
    tops = chosen.groupBy(F.col("anchor_key").alias("row_key")).agg(
        F.collect_set("positive_score").alias("tops")
    )
    found = _scanned(
        rows, materialise(anchors.join(tops, "row_key")), "negative", _negatives(negatives, percent)
    )
    ranked = top_k(found, ["anchor_key", "positive_score"], order("negative"), negatives)
    return chosen.drop("nth").join(ranked, ["anchor_key", "positive_score"]).select(
        "anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"
    )
