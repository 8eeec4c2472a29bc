"""Top-k per key."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank"
) -> DataFrame:
    """The first k rows per key with their 1-based rank.

    The rank filter lets Spark keep k rows per key and task before the shuffle, so a key that
    owns a large share of the rows sends only k rows per task.
    """
    position = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(rank, position).filter(F.col(rank) <= k)


def first_by(df: DataFrame, keys: list[str], order: str) -> DataFrame:
    """The row with the smallest `order` per key: an aggregate with map-side combine."""
    rest = [c for c in df.columns if c not in keys]
    packed = F.min_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col(order))
    return df.groupBy(*keys).agg(packed.alias("__first")).select(*keys, "__first.*")


def last_by(df: DataFrame, keys: list[str], arrival: str = "arrival") -> DataFrame:
    """The last row per key, for deliveries that repeat a key.

    Rows that say in a column `arrival` when and where they were delivered go by that; the largest
    counts. Others go by their place in the input, as it is read.
    """
    known = arrival in df.columns
    rest = [c for c in df.columns if c not in keys]
    packed = F.max_by(F.struct(*[F.col(f"`{c}`") for c in rest]), F.col("__at"))
    placed = df.withColumn("__at", F.col(arrival) if known else F.monotonically_increasing_id())
    return placed.groupBy(*keys).agg(packed.alias("__last")).select(*keys, "__last.*").select(
        *[F.col(f"`{c}`") for c in df.columns]
    )
