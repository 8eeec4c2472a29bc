"""A part of the registered queries against their SQL twins on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry
from loreloom.plans.catalog import QUERIES

FAST = [
    "tokens", "entity_names", "content_type_rules", "html_text", "doc_sections", "thread_sections",
    "chunk_paragraphs", "bm25_topk", "vector_topk", "hybrid_merge", "entity_exact",
    "rewrite_queries", "nearest_rank_p95", "answer_metrics", "tenant_route", "memory_context",
    "answer_cache_lookup", "rate_limit", "crawl_plan", "manifest_listing", "budget_sample",
    "index_append", "stream_sessions",
]


def plain(value):
    return round(float(value), 6) if type(value).__name__ in ("float", "Decimal") else value


@pytest.mark.parametrize("name", FAST)
def test_query_equals_sql(spark, data, name):
    connection = duckdb.connect()
    for table in ("documents", "embeddings", "pages", "benchmark", "labels", "conversations", "events"):
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{data}/{table}.parquet'")
    frame = QUERIES[name](spark, data)
    result = connection.execute(entry.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(frame.columns)
    want = sorted(str([plain(v) for v in row]) for row in result.fetchall())
    got = sorted(str([plain(row[c]) for c in columns]) for row in frame.collect())
    assert got == want


def test_entry(spark):
    rows = entry.entry(spark)
    assert rows.columns == ["query_id", "chunk_id", "bm25_score", "score", "rank"]
    assert rows.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
