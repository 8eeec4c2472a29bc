"""A table of rows by key in slices (game_id, source_id), kept as a log of commits.

A micro-batch is one commit: a folder with its rows and, written last, its part of the ledger, which
makes the commit count. Nothing is changed in place. What is alive follows from the log: the newest
row of a key, unless its slice was replaced by a later commit. A commit reads only the commits before
it, so a batch that is run again writes the same thing.

The ledger also says which slices a run has replaced. In mode `rebuild-source` the first batch of a
run that brings rows of a slice replaces it, and later batches of the run add to it, however many the
source spans. Commits go on counting from run to run; a run that is resumed finds its own numbers.

Every `FOLD` commits the living rows are written once as a new base, so reading never looks at more
than a base and `FOLD` commits.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.session import join_small, materialise

FOLD = 16
SLICE = ["game_id", "source_id"]
LEDGER = "run string, first bigint, game_id string, source_id string"

# What a commit changes: (rows that come, rows that go) to a table that is added up over commits.
Difference = Callable[[DataFrame, DataFrame], DataFrame]


class SliceLog:
    """Rows of `schema` with unique `key`; `sums` names tables (schema, keys, numbers, difference)."""

    def __init__(
        self, spark: SparkSession, root: str, key: str, schema: T.StructType,
        sums: dict[str, tuple[str, list[str], list[str], Difference]] | None = None,
    ) -> None:
        self.spark, self.root, self.key, self.schema, self.sums = spark, root, key, schema, sums or {}
        try:
            self._ledger().limit(1).collect()
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            shapes = {"rows": schema, "base": schema}
            for name, (shape, *_) in self.sums.items():
                shapes |= {name: shape, f"{name}-base": shape}
            for name, shape in {**shapes, "ledger": LEDGER}.items():
                self._write(spark.createDataFrame([], shape), name, -1)

    def _write(self, df: DataFrame, name: str, commit: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.root}/{name}/commit={commit}")

    def _table(self, name: str, schema) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.root}/{name}")

    def _ledger(self) -> DataFrame:
        return self._table("ledger", LEDGER)

    def _since_base(self, name: str, schema, base: int, before: int) -> DataFrame:
        """The base table and the commits after it, with their commit numbers."""
        folder = f"{self.root}/{'base' if name == 'rows' else name + '-base'}/commit={base}"
        folded = self.spark.read.schema(schema).parquet(folder)
        later = self._table(name, schema).filter((F.col("commit") > base) & (F.col("commit") < before))
        return folded.withColumn("commit", F.lit(base)).unionByName(later)

    def last(self) -> int:
        """The number of the last commit that counts, -1 for none."""
        return self._ledger().agg(F.coalesce(F.max("commit"), F.lit(-1))).first()[0]

    def open_run(self, run: str) -> int:
        """The number of the first commit of a run: its own if it is resumed, else the next one."""
        known = self._ledger().filter(F.col("run") == run).agg(F.min("first")).first()[0]
        last = self.last()
        if last >= 0 and (last + 1) % FOLD == 0:  # the run before may have ended before its base was written
            self.fold(last)
        return last + 1 if known is None else known

    def live(self, before: int | None = None, base: int | None = None) -> DataFrame:
        """The rows alive before a commit; after the last one by default."""
        before = self.last() + 1 if before is None else before
        base = before // FOLD * FOLD - 1 if base is None else base
        rows = self._since_base("rows", self.schema, base, before)
        return self._alive(rows, before, base).select(*[F.col(f"`{c}`") for c in self.schema.names])

    def _alive(self, rows: DataFrame, before: int, base: int) -> DataFrame:
        """Those of `rows` (key, commit and slice at least) that are alive before a commit."""
        newest = rows.groupBy(self.key).agg(F.max("commit").alias("commit"))
        replaced = (
            self._ledger()
            .filter(F.col("game_id").isNotNull() & (F.col("commit") > base) & (F.col("commit") < before))
            .groupBy(*SLICE).agg(F.max("commit").alias("__replaced"))
        )
        return (
            rows.join(newest, [self.key, "commit"]).join(replaced, SLICE, "left")
            .filter(F.col("__replaced").isNull() | (F.col("commit") >= F.col("__replaced")))
        )

    def _going(self, number: int, fresh: DataFrame, slices: DataFrame) -> DataFrame:
        """The living rows that a commit replaces, by key or with their slice.

        Which these are follows from keys and slices alone; only then are the rows fetched.
        """
        base = number // FOLD * FOLD - 1
        rows = self._since_base("rows", self.schema, base, number)
        gone = materialise(
            self._alive(rows.select(self.key, "commit", *SLICE), number, base)
            .join(fresh.select(self.key, F.lit(True).alias("__again")), self.key, "left")
            .join(slices.withColumn("__cleared", F.lit(True)), SLICE, "left")
            .filter("__again OR __cleared").select(self.key, "commit")
        )
        return join_small(rows, gone, [self.key, "commit"], "left_semi").select(*self.schema.names)

    def total(self, name: str, before: int | None = None, base: int | None = None) -> DataFrame:
        """A table of sums over all commits; rows that came to nothing are left out."""
        before = self.last() + 1 if before is None else before
        base = before // FOLD * FOLD - 1 if base is None else base
        schema, keys, numbers, _ = self.sums[name]
        rows = self._since_base(name, schema, base, before)
        added = rows.groupBy(*keys).agg(*[F.sum(n).alias(n) for n in numbers])
        some = F.greatest(*[F.abs(n) for n in numbers], F.lit(0)) != 0
        return added.filter(some) if keys else added

    def commit(self, number: int, rows: DataFrame, run: str, first: int, replace: bool) -> None:
        """Take in `rows`, which have unique keys; with `replace` new slices of the run start anew."""
        self._write(rows, "rows", number)
        fresh = self.spark.read.schema(self.schema).parquet(f"{self.root}/rows/commit={number}")
        slices = fresh.select(*SLICE).distinct()
        if replace:
            before = self._ledger().filter((F.col("run") == run) & (F.col("commit") < number))
            slices = slices.join(before, SLICE, "left_anti")
        else:
            slices = slices.limit(0)
        mark = self.spark.createDataFrame([(run, first, None, None)], LEDGER)
        entry = mark.unionByName(slices.select(F.lit(run).alias("run"), F.lit(first).cast("long").alias("first"), *SLICE))
        if self.sums:
            going = materialise(self._going(number, fresh, slices))  # read by each of the sums
            for name, (*_, difference) in self.sums.items():
                self._write(difference(fresh, going), name, number)
        self._write(entry, "ledger", number)
        if (number + 1) % FOLD == 0:
            self.fold(number)

    def fold(self, number: int) -> None:
        """Write what is alive after a commit as the base for reading from there on."""
        base = number // FOLD * FOLD - 1
        self._write(self.live(number + 1, base), "base", number)
        for name in self.sums:
            self._write(self.total(name, number + 1, base), f"{name}-base", number)


def newest_delivery(rows: DataFrame, key: str, arrival: str) -> DataFrame:
    """Of rows with equal key the one delivered last; any one of those with the same place.

    Keys and places are aggregated; the rows themselves stay where they are read, unless the keys that
    came more than once are too many to broadcast.
    """
    placed = rows.groupBy(key, arrival).agg(F.count(F.lit(1)).alias("__n"))
    newest = placed.groupBy(key).agg(
        F.max(arrival).alias("__newest"), F.sum("__n").alias("__n"), F.max_by("__n", arrival).alias("__same")
    )
    again = materialise(newest.filter("__n > 1").drop("__n"))
    met = join_small(rows.filter(F.col(key).isNotNull()), again.drop("__same"), [key], "left")
    last = met.filter(F.col("__newest").isNull() | (F.col("__newest") == F.col(arrival))).drop("__newest")
    return last if again.filter("__same > 1").isEmpty() else last.dropDuplicates([key])
