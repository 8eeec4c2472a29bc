"""Row keys and bounded batches shared by the corpus operators."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loreloom.session import materialise

BATCH_BYTES = 1 << 18

# Words are runs of anything but these six bytes; their patterns for the JVM.
SPACES = "[\\x20\\x09-\\x0D]+"


def keyed(df: DataFrame, name: str = "row_key") -> DataFrame:
    """Add a key that tells rows apart even where ids repeat or are null.

    The key is the place of the row in the files it is read from: a hash of the file's path and the
    row's number in it. It is the same in every scan and after a lost executor. Rows that do not come
    straight from files are written to the shared folder first.
    """
    if name in df.columns:
        raise ValueError(f"the column {name} is taken")
    place = F.struct(
        F.xxhash64("_metadata.file_path").alias("f"), F.col("_metadata.row_index").alias("r")
    ).alias(name)
    columns = [F.col(f"`{c}`") for c in df.columns]
    try:
        return df.select(*columns, place)
    except AnalysisException:
        return materialise(df).select(*columns, place)


def numbered(df: DataFrame) -> tuple[DataFrame, list[str], dict[str, str]]:
    """The rows under column names that clash with nothing, the names, and where each went."""
    names = df.columns
    plain = [f"c{i}" for i in range(len(names))]
    return df.toDF(*plain), names, dict(zip(names, plain, strict=True))


def groups_of_rows(batches: Iterator, text: str, most: int = BATCH_BYTES) -> Iterator:
    """Cut Arrow batches into runs of rows with about `most` bytes of text, and one text more."""
    for batch in batches:
        column = batch.column(batch.schema.get_field_index(text))
        sizes = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
        bucket = np.cumsum(sizes, dtype=np.int64) // most
        edges = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else []
        for start, end in zip(edges, [*edges[1:], len(bucket)], strict=True):
            yield batch.slice(start, end - start), column.slice(start, end - start).to_pylist()
