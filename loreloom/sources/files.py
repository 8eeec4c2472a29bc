"""File sources and sinks: chunks, raw documents, entities, golden sets, reports."""

from __future__ import annotations

import logging
import re

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.functions import fixed
from loreloom.operators.chunking import CHUNK_COLUMNS

logger = logging.getLogger(__name__)

CHUNK_SCHEMA = ", ".join(f"{c} string" for c in CHUNK_COLUMNS)
RAW_SCHEMA = (
    "doc_id string, game_id string, source_id string, source_url string, title string, "
    "text_en string, content_type string, fetched_at timestamp, license string"
)
ENTITY_SCHEMA = (
    "game_id string, canonical_name string, normalized_name string, content_type string, "
    "source_url string, aliases array<string>"
)
RETRIEVAL_GOLDEN_SCHEMA = (
    "id string, query string, game_id string, category string, expected_titles array<string>, "
    "expected_terms array<string>, expected_source_ids array<string>"
)
ANSWER_GOLDEN_SCHEMA = (
    "id string, query string, game_id string, category string, "
    "expected_source_titles array<string>, expected_answer_terms array<string>, "
    "allow_insufficient_context boolean"
)
TOOL_GOLDEN_SCHEMA = (
    "id string, query string, game_id string, category string, expected_tool string"
)


def _required(name: str) -> Column:
    return (
        F.when(F.col(name).isNotNull(), F.col(name))
        .otherwise(F.raise_error(F.lit(f"missing required key {name}")))
        .alias(name)
    )


def read_chunks(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Chunk JSON lines; blank lines are skipped, a missing key is an error."""
    rows = spark.read.schema(CHUNK_SCHEMA).json(path, mode="FAILFAST")
    return rows.select(
        *[
            F.coalesce(c, F.lit("standard")).alias(c) if c == "spoiler_level" else _required(c)
            for c in CHUNK_COLUMNS
        ]
    )


def corpus_paths(primary: str, extra: str = "") -> list[str]:
    """The primary path and the extra ones, separated by ; or , in one setting."""
    paths = [primary] if primary else []
    return paths + [p for p in re.split(r"[;,]", extra) if p.strip()]


def read_corpus(spark: SparkSession, primary: str, extra: str = "") -> DataFrame:
    """Union of the chunk files that exist; duplicates stay."""
    corpus = spark.createDataFrame([], CHUNK_SCHEMA)
    for path in corpus_paths(primary, extra):
        try:
            corpus = corpus.unionByName(read_chunks(spark, path))
        except AnalysisException as error:
            if "PATH_NOT_FOUND" not in str(error):
                raise
            logger.warning("chunk file was not found: %s", path)
    return corpus


def write_chunks(chunks: DataFrame, path: str) -> None:
    """Chunk JSON lines; what was there is replaced."""
    chunks.select(*CHUNK_COLUMNS).write.mode("overwrite").json(path)


def read_raw_documents(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """One pretty-printed JSON object per file, or JSON lines."""
    rows = spark.read.schema(RAW_SCHEMA).option("multiLine", not lines).json(path, mode="FAILFAST")
    return rows.select(
        *[c if c == "license" else _required(c) for c in rows.columns]
    )


def write_raw_documents(documents: DataFrame, path: str) -> None:
    """Raw documents as a table, one folder per tenant and source."""
    (
        documents.write.mode("overwrite")
        .option("partitionOverwriteMode", "dynamic")
        .partitionBy("game_id", "source_id")
        .parquet(path)
    )


def read_entities(spark: SparkSession, path: str, lines: bool = False) -> DataFrame:
    """An entity export: files that hold one JSON array each, or JSON lines."""
    rows = spark.read.schema(ENTITY_SCHEMA).option("multiLine", not lines).json(path, mode="FAILFAST")
    names = [c for c in rows.columns if c != "aliases"]
    return rows.select(
        *[_required(c) for c in names],
        F.coalesce("aliases", F.array().cast("array<string>")).alias("aliases"),
    )


def write_entities(entities: DataFrame, path: str) -> None:
    entities.write.mode("overwrite").partitionBy("game_id").parquet(path)


def _or_empty(name: str) -> Column:
    return F.coalesce(name, F.array().cast("array<string>")).alias(name)


def _tenant() -> Column:
    return F.coalesce(F.nullif("game_id", F.lit("")), F.lit(fixed.DEFAULT_TENANT)).alias("game_id")


def read_retrieval_golden(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(RETRIEVAL_GOLDEN_SCHEMA).json(path, mode="FAILFAST")
    return rows.select(
        _required("id"), _required("query"), _tenant(), "category", _required("expected_titles"),
        _or_empty("expected_terms"), _or_empty("expected_source_ids"),
    )


def read_answer_golden(spark: SparkSession, path: str) -> DataFrame:
    """A term is a string or a list of alternatives; both become a list of alternatives.

    Lines are read as VARIANT, so what a value is decides, not what it looks like: the string "[a]"
    is a string.
    """
    lines = spark.read.text(path).filter(F.trim("value") != "")
    rows = lines.select(F.parse_json("value").alias("v"))
    get = lambda name, kind: F.variant_get("v", f"$.{name}", kind)
    fields = rows.select(
        *[get(n, "string").alias(n) for n in ("id", "query", "game_id", "category")],
        get("expected_source_titles", "array<string>").alias("expected_source_titles"),
        alternatives(get("expected_answer_terms", "array<variant>")).alias("expected_answer_terms"),
        get("allow_insufficient_context", "boolean").alias("allow_insufficient_context"),
    )
    return fields.select(
        _required("id"), _required("query"), _tenant(), "category",
        _or_empty("expected_source_titles"), "expected_answer_terms",
        F.coalesce("allow_insufficient_context", F.lit(False)).alias("allow_insufficient_context"),
    )


def alternatives(terms: Column) -> Column:
    """Lists of alternatives for an array of variants, each a string or an array of strings."""
    return F.transform(
        F.coalesce(terms, F.array().cast("array<variant>")),
        lambda t: F.when(
            F.startswith(F.schema_of_variant(t), F.lit("ARRAY")), F.variant_get(t, "$", "array<string>")
        ).otherwise(F.array(F.variant_get(t, "$", "string"))),
    )


def read_tool_golden(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema(TOOL_GOLDEN_SCHEMA).json(path, mode="FAILFAST")
    return rows.select(_required("id"), _required("query"), _tenant(), "expected_tool", "category")


def write_report(metrics: DataFrame, cases: DataFrame, path: str) -> None:
    """Metric rows and case rows below one folder."""
    metrics.write.mode("overwrite").json(f"{path}/metrics")
    cases.write.mode("overwrite").json(f"{path}/cases")
