"""Crawl bookkeeping: what to fetch, what a fetch meant, and the state afterwards."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import fixed
from loreloom.functions import text as tx
from loreloom.operators.topk import last_by

STATE_COLUMNS = [
    "doc_id", "game_id", "source_id", "source_url", "raw_path", "content_hash", "fetched_at",
    "checked_at", "status_code", "etag", "last_modified",
]


def is_fresh(checked_at: Column, now: Column, ttl_hours: int) -> Column:
    return F.timestamp_diff("MICROSECOND", checked_at, now) < ttl_hours * 3600 * 1_000_000


def raw_path(root: str, game_id: Column, source_id: Column, doc_id: Column) -> Column:
    safe = F.translate(doc_id, ":/", "__")
    return F.concat(
        F.lit(root.rstrip("/") + "/"), game_id, F.lit("/"), source_id, F.lit("/"), safe,
        F.lit(".json"),
    )


def crawl_plan(
    manifest: DataFrame, state: DataFrame, landed: DataFrame, now: Column,
    ttl_hours: int = fixed.CRAWL_TTL_HOURS, force_refresh: bool = False,
    stale_fallback: bool = False,
) -> DataFrame:
    """Manifest rows with a status.

    `landed` holds the fetch results at hand: doc_id, http_status, text, etag, last_modified.
    A reference that is not fresh and has no landed result stays `to_fetch`, with the headers for
    a conditional request. Of several results for a page the last counts. With `stale_fallback` a failed fetch of a known page keeps the old one.
    """
    known = state.select(
        "doc_id", F.col("content_hash").alias("old_hash"), F.col("checked_at").alias("checked"),
        F.col("etag").alias("if_none_match"), F.col("last_modified").alias("if_modified_since"),
        F.lit(True).alias("known"),
    )
    results = last_by(landed, ["doc_id"]).select(
        "doc_id", "http_status",
        F.when(F.col("http_status") < 300, tx.content_hash(F.col("text"))).alias("content_hash"),
        F.col("etag"), F.col("last_modified"),
    )
    joined = manifest.join(known, "doc_id", "left").join(results, "doc_id", "left")
    has_state = F.coalesce("known", F.lit(False))
    fresh = has_state & is_fresh(F.col("checked"), now, ttl_hours)
    code = F.col("http_status")
    status = (
        F.when(fresh & F.lit(not force_refresh), "cached")
        .when(code.isNull(), "to_fetch")
        .when((code == 304) & has_state, "not_modified")
        .when(
            (code >= 400) & has_state & F.lit(stale_fallback),
            F.concat(F.lit("cached_stale_http_"), code.cast("string")),
        )
        .when(code >= 300, F.concat(F.lit("failed_http_"), code.cast("string")))
        .when(has_state & (F.col("old_hash") == F.col("content_hash")), "unchanged")
        .otherwise("fetched")
    )
    conditional = F.lit(not force_refresh)
    return joined.withColumn("status", status).select(
        *manifest.columns, "status", "http_status", "content_hash", "etag", "last_modified",
        F.when(conditional, F.col("if_none_match")).alias("if_none_match"),
        F.when(conditional, F.col("if_modified_since")).alias("if_modified_since"),
    )


def crawl_merge(state: DataFrame, outcomes: DataFrame, now: Column) -> DataFrame:
    """The state after the outcomes (crawl_plan rows with game_id, source_id and raw_path).

    Fetched and unchanged pages replace their row; a 304 touches checked_at and the status only.
    """
    # A plan has one outcome per manifest row; of rows that repeat a page the largest counts, wherever it is.
    whole = F.struct(*[F.col(f"`{c}`") for c in outcomes.columns if c != "doc_id"])
    outcomes = last_by(outcomes.withColumn("arrival", whole), ["doc_id"])
    written = outcomes.filter(F.col("status").isin("fetched", "unchanged")).select(
        "doc_id", "game_id", "source_id", "source_url", "raw_path", "content_hash",
        now.alias("fetched_at"), now.alias("checked_at"),
        F.col("http_status").cast("int").alias("status_code"), "etag", "last_modified",
    )
    touched = outcomes.filter(F.col("status") == "not_modified").select(
        "doc_id", F.lit(True).alias("__touched")
    )
    new = written.select("doc_id", F.struct(*STATE_COLUMNS[1:]).alias("__new"))
    merged = (
        state.select("doc_id", F.struct(*STATE_COLUMNS[1:]).alias("__old"))
        .join(new, "doc_id", "full_outer")
        .join(touched, "doc_id", "left")
    )
    old = F.col("__old")
    kept = F.when(
        F.col("__touched"),
        old.withField("checked_at", now).withField("status_code", F.lit(304)),
    ).otherwise(old)
    return merged.withColumn(
        "__row", F.when(F.col("__new").isNotNull(), F.col("__new")).otherwise(kept)
    ).select("doc_id", "__row.*")
