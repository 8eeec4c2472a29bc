"""Streaming jobs. Each is a micro-batch form of a batch operator and gives the same rows.

Every batch writes its own version below the shared folder and reads only the version before it,
so a batch that is run again after a failure writes the same thing.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.functions import fixed
from loreloom.functions.embedding import EmbeddingProvider
from loreloom.operators import crawl, indexing, lexical, requests
from loreloom.session import materialise, scratch_path
from loreloom.streaming import state
from loreloom.streaming.slicelog import SliceLog, newest_delivery

ARRIVAL = "arrival"


def file_stream(
    spark: SparkSession, folder: str, name: str, schema: T.StructType, files_per_batch: int = 1000,
    arrival: bool = False,
) -> DataFrame:
    """Parquet files of one table, as they arrive.

    With `arrival` a row carries its place in the delivery: files by the time they were written, then
    by path, and rows by their number in the file.
    """
    rows = (
        spark.readStream.schema(schema)
        .option("pathGlobFilter", name)
        .option("maxFilesPerTrigger", files_per_batch)
        .parquet(folder)
    )
    if not arrival:
        return rows
    place = ("file_modification_time", "file_path", "row_index")
    return rows.withColumn(ARRIVAL, F.struct(*[F.col(f"_metadata.{p}").alias(p) for p in place]))


def run_available(
    stream: DataFrame, process: Callable[[DataFrame, int], None], checkpoint: str,
    mode: str = "append",
) -> int:
    """Process what has arrived; returns the number of the last batch with an output, -1 for none."""
    done: list[int] = []

    def noted(batch: DataFrame, number: int) -> None:
        process(batch, number)
        done.append(number)

    query = (
        stream.writeStream.foreachBatch(noted)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return done[-1] if done else -1


def versioned(
    stream: DataFrame, step: Callable[[DataFrame | None, DataFrame], DataFrame], name: str,
) -> DataFrame:
    """Fold micro-batches into a table: version n = step(version n - 1, batch n)."""
    spark = stream.sparkSession
    root = scratch_path(spark, name)

    def process(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        old = session.read.parquet(f"{root}/table/v={number - 1}") if number else None
        step(old, batch).write.mode("overwrite").parquet(f"{root}/table/v={number}")

    last = run_available(stream, process, f"{root}/progress")
    if last < 0:
        return step(None, spark.createDataFrame([], stream.schema))
    return spark.read.parquet(f"{root}/table/v={last}")


def request_windows(hits: DataFrame, width: str = "1 minute") -> DataFrame:
    """Requests per client and window: window_start, client, n.

    Each batch is counted on its own and the counts are added up, so a hit counts however late it is.
    """
    spark = hits.sparkSession
    root = scratch_path(spark, "windows")
    keys = [F.window("ts", width)["start"].alias("window_start"), F.col("client")]

    def process(batch: DataFrame, number: int) -> None:
        counted = batch.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        counted.write.mode("overwrite").parquet(f"{root}/counts/batch={number}")

    if run_available(hits, process, f"{root}/progress") < 0:
        nothing = spark.createDataFrame([], hits.schema)
        return nothing.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    counts = spark.read.parquet(f"{root}/counts")
    return counts.groupBy("window_start", "client").agg(F.sum("n").alias("n"))


def limited_requests(
    hits: DataFrame, per_minute: int = fixed.REQUESTS_PER_MINUTE,
    per_day: int = fixed.REQUESTS_PER_DAY,
) -> DataFrame:
    """Limit decisions for hit_id, client, ts, from counters kept by client."""
    root = scratch_path(hits.sparkSession, "limits")
    return requests.judge(state.counted_hits(hits, root), per_minute, per_day).select(
        "hit_id", "client", "ts", "minute_count", "day_count", "limit_name", "retry_after"
    )


def session_tails(turns: DataFrame, keep: int = fixed.SESSION_TURNS) -> DataFrame:
    """The last turns per session (session_id, turn, role, content), from a ring kept by session."""
    root = scratch_path(turns.sparkSession, "sessions")
    return state.session_rings(requests.stored_turns(turns), keep, root)


def cached_answers(events: DataFrame, ttl: int = fixed.ANSWER_CACHE_TTL_SECONDS) -> DataFrame:
    """Answers to the questions in a stream of cache events (see `state.cache_answers`)."""
    return state.cache_answers(events, ttl, scratch_path(events.sparkSession, "cache"))


def crawl_states(
    landed: DataFrame, manifest: DataFrame, known_state: DataFrame, now, root: str = "raw",
    ttl_hours: int = fixed.CRAWL_TTL_HOURS, force_refresh: bool = False, stale_fallback: bool = False,
) -> DataFrame:
    """Crawl state after every landed fetch result; the options are those of `crawl.crawl_plan`."""

    def step(old: DataFrame | None, batch: DataFrame) -> DataFrame:
        known = known_state if old is None else old
        wanted = manifest.join(batch.select("doc_id").distinct(), "doc_id", "left_semi")
        outcomes = crawl.crawl_plan(
            wanted, known, batch, now, ttl_hours, force_refresh, stale_fallback
        ).withColumn(
            "raw_path",
            crawl.raw_path(root, F.col("game_id"), F.col("source_id"), F.col("doc_id")),
        )
        return crawl.crawl_merge(known, outcomes, now)

    return versioned(landed, step, "crawl")


def _log_run(
    chunks: DataFrame, mode: str, root: str, run: str | None,
    open_log: Callable[[SparkSession], SliceLog], rows_of: Callable[[DataFrame], DataFrame], key: str,
) -> None:
    """Feed a stream of chunks to a slice log as one run."""
    if mode not in ("append", "rebuild-source"):
        raise ValueError("a stream can append or rebuild sources")
    run = run or uuid.uuid4().hex
    first = open_log(chunks.sparkSession).open_run(run)

    def process(batch: DataFrame, number: int) -> None:
        if ARRIVAL not in batch.columns:
            batch = materialise(batch.withColumn(ARRIVAL, F.monotonically_increasing_id()))
        rows = rows_of(newest_delivery(batch, key, ARRIVAL))
        log = open_log(batch.sparkSession)
        log.commit(first + number, rows, run, first, mode == "rebuild-source")

    run_available(chunks, process, f"{root}/progress/{run}")


def index_points(
    chunks: DataFrame, mode: str = "append", embed: EmbeddingProvider | None = None,
    root: str | None = None, run: str | None = None,
) -> DataFrame:
    """An index table kept current from a stream of chunks; returns its points.

    `append` merges chunks by id. `rebuild-source` replaces each (game_id, source_id) slice the
    first time the run brings rows of it and merges what follows. A table in `root` is carried on; a
    `run` that is named again goes on where it stopped. Of a chunk delivered twice in a batch the
    newest counts: by the `arrival` column of the stream (see `file_stream`), else by row order.
    """
    spark = chunks.sparkSession
    root = root or scratch_path(spark, "index")
    shape = indexing.points(spark.createDataFrame([], chunks.schema), embed).schema

    def open_log(session: SparkSession) -> SliceLog:
        return SliceLog(session, f"{root}/points", "point_id", shape)

    _log_run(chunks, mode, root, run, open_log, lambda rows: indexing.points(rows, embed), "chunk_id")
    return open_log(spark).live()


def _frequency_changes(fresh: DataFrame, going: DataFrame) -> DataFrame:
    signed = [d.select(F.explode("terms.term").alias("term"), F.lit(n).cast("long").alias("df"))
              for d, n in ((fresh, 1), (going, -1))]
    changes = signed[0].unionByName(signed[1]).groupBy("term").agg(F.sum("df").alias("df"))
    return changes.filter("df != 0")


def _size_changes(fresh: DataFrame, going: DataFrame) -> DataFrame:
    signed = [d.select(F.lit(n).cast("long").alias("chunks"), (n * F.col("length")).alias("length"))
              for d, n in ((fresh, 1), (going, -1))]
    return signed[0].unionByName(signed[1]).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("chunks", "length")]
    )


def _postings_log(session: SparkSession, root: str) -> SliceLog:
    shape = T.StructType.fromDDL(
        "chunk_id string, ord bigint, game_id string, source_id string, length int, "
        "terms array<struct<term: string, tf: int>>"
    )
    return SliceLog(
        session, f"{root}/postings", "chunk_id", shape,
        {
            "frequencies": ("term string, df bigint", ["term"], ["df"], _frequency_changes),
            "sizes": ("chunks bigint, length bigint", [], ["chunks", "length"], _size_changes),
        },
    )


def read_postings(spark: SparkSession, root: str) -> lexical.LexicalIndex:
    """The inverted index below `root`, for `lexical.search`: nothing is tokenised or counted again."""
    log = _postings_log(spark, root)
    chunks, length = log.total("sizes").first()
    return lexical.LexicalIndex(
        log.live().drop("source_id"), chunks or 0, (length or 0) / chunks if chunks else 0.0,
        log.total("frequencies"),
    )


def index_postings(
    chunks: DataFrame, mode: str = "append", root: str | None = None, run: str | None = None
) -> lexical.LexicalIndex:
    """An inverted index kept current from a stream of chunks (modes as in `index_points`).

    Each batch tokenises its own chunks only. The terms of the rows it replaces are read back, and
    document frequencies, chunk count and total length change by signed differences.
    """
    spark = chunks.sparkSession
    root = root or scratch_path(spark, "postings")

    def rows_of(rows: DataFrame) -> DataFrame:
        made = lexical.term_rows(rows, "source_id")
        return made.withColumn("ord", F.col("ord").cast("long")).select(
            "chunk_id", "ord", "game_id", "source_id", "length", "terms"
        )

    _log_run(chunks, mode, root, run, lambda s: _postings_log(s, root), rows_of, "chunk_id")
    return read_postings(spark, root)
