"""Headline queries on the tables at $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from loreloom.plans.catalog import QUERIES
from loreloom.session import build_session

HEADLINE = [
    "tokens", "doc_sections", "chunk_paragraphs", "html_text", "bm25_topk", "vector_topk",
    "hybrid_search", "entity_registry", "entity_mentions", "retrieval_metrics", "memory_context",
    "rate_limit", "crawl_merge", "index_append", "answer_cache_lookup", "tool_routing",
    "retrieval_cases",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        f"local[{cpus}]", "bench",
        spark__sql__shuffle__partitions=cpus, spark__driver__memory="16g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["bm25_topk"](spark, folder).write.format("noop").mode("overwrite").save()  # warm-up
    seconds: dict[str, float] = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    questions = spark.read.parquet(f"{folder}/benchmark.parquet").count()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3),
                "unit": "sec", "queries": seconds, "sf": folder.rstrip("/").split("sf")[-1],
                "hybrid_questions_per_sec": round(questions / seconds["hybrid_search"], 2),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
