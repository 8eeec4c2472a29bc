"""Session settings, the shared folder and size checks for broadcast sides."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_MAX_ROWS = 200_000
BROADCAST_MAX_BYTES = 32 << 20

# Remove the shuffle files of a finished query at once.
DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
# Rows that a Python worker is sent at once.
BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def build_session(master: str = "local[*]", app: str = "loreloom", **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; the cluster's own settings win elsewhere."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    paths = [p for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:  # for the Python workers of a local session
        os.environ["PYTHONPATH"] = os.pathsep.join([root, *paths])
    builder = (
        SparkSession.builder.master(master)
        .appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as the cluster names it.

    Only a local session, where driver and executors are one machine, may get a folder of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="loreloom-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def spread(df: DataFrame, key: str) -> DataFrame:
    """Share a small scan among all cores.

    A table of a few files (or one row group) would keep one task busy with all the text work. A
    scan that already has several partitions per core, as any large table has, is left alone.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 4 * cores:
        return df
    return df.repartition(cores, key)


def materialise(df: DataFrame, batch_rows: int | None = None) -> DataFrame:
    """Compute once and go on from a table written to the shared folder.

    The table is columnar, so later steps read only the columns they use; it has measured sizes
    and it outlives the executors that wrote it. The shuffle files behind it go when it is written.
    `batch_rows` bounds what a Python worker is sent at once, for steps whose rows are large.
    """
    spark = df.sparkSession
    path = scratch_path(spark, "step")
    wanted = {DROP_SHUFFLES: "true"} | ({BATCH_ROWS: str(batch_rows)} if batch_rows else {})
    before = {key: spark.conf.get(key, None) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, value)
    try:
        # Of blocks, whose rows are large, the writer would gather a hundred before it looks at their size.
        blocks = any(kind == "binary" for _, kind in df.dtypes)
        (df.write.option("parquet.page.size.row.check.min", 1) if blocks else df.write).parquet(path)
    finally:
        for key, value in before.items():
            if value is None:
                spark.conf.unset(key)
            else:
                spark.conf.set(key, value)
    table = spark.read.schema(df.schema).parquet(path)
    table.written_to = path  # a plain scan: counting it reads footers only
    return table


def is_written(df: DataFrame) -> bool:
    return hasattr(df, "written_to")


def fits_broadcast(
    df: DataFrame, max_rows: int = BROADCAST_MAX_ROWS, max_bytes: int = BROADCAST_MAX_BYTES
) -> bool:
    """Measure a side before broadcasting it.

    A written table is counted from its footers, and only a small count is followed by a look at the
    bytes. Anything else is run for no more than `max_rows + 1` rows.
    """
    if is_written(df) and df.count() > max_rows:
        return False
    size = F.octet_length(F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns])))
    rows, octets = (
        df.select(size.alias("octets"))
        .limit(max_rows + 1)
        .agg(F.count(F.lit(1)), F.coalesce(F.sum("octets"), F.lit(0)))
        .first()
    )
    return rows <= max_rows and octets <= max_bytes


def join_small(
    big: DataFrame, small: DataFrame, on: list[str], how: str = "inner", salts: int = 16
) -> DataFrame:
    """Equi-join with the side expected to be small.

    A side within the measured bound is broadcast, and the other keeps its place (`big` is measured
    only where it is a written table). Beyond it, `big` is spread over `salts` slices per key and the other side repeated per slice, so that no key,
    however frequent, lands in one task. `how` may be inner, left or left_semi.
    """
    if fits_broadcast(small):
        return big.join(F.broadcast(small), on, how)
    if how == "inner" and is_written(big) and fits_broadcast(big):
        return F.broadcast(big).join(small, on)
    slice_of = F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in big.columns]), F.lit(salts))
    left = big.withColumn("__slice", slice_of.cast("int"))
    right = small.withColumn(
        "__slice", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))
    )
    # Spark goes by the size of the files, which repeated texts make far smaller than the rows are.
    return left.join(right.hint("merge"), [*on, "__slice"], how).drop("__slice")
