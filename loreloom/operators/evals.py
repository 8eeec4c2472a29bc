"""Retrieval, answer and tool-routing quality, overall and per category."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import fixed
from loreloom.functions import text as tx
from loreloom.operators.numbering import nearest_rank
from loreloom.session import materialise

STRINGS = "array<string>"


def _folded(values: Column) -> Column:
    """Non-empty values, case-folded."""
    kept = F.filter(
        F.coalesce(values, F.array().cast(STRINGS)), lambda v: v.isNotNull() & (v != "")
    )
    return F.transform(kept, tx.fold)


def _top(values: Column, k: int) -> Column:
    return F.slice(values, 1, k)


def attach_results(cases: DataFrame, results: DataFrame) -> DataFrame:
    """Cases with their ranked results; cases without any keep an empty list."""
    item = F.struct("rank", "title", "section", "text", "game_id", "source_id")
    lists = results.groupBy(F.col("query_id").alias("case_id")).agg(
        F.sort_array(F.collect_list(item)).alias("results")
    )
    return cases.join(lists, "case_id", "left").withColumn(
        "results",
        F.coalesce(
            F.col("results"),
            F.array().cast(
                "array<struct<rank:int,title:string,section:string,text:string,"
                "game_id:string,source_id:string>>"
            ),
        ),
    )


def retrieval_cases(attached: DataFrame) -> DataFrame:
    """Per-case measures. Wants case_id, game_id, category, expected_titles, expected_terms,
    expected_source_ids, latency_ms and results.

    The first expected rank skips results without a title; hit@k cuts the list before it does.
    """
    results = F.col("results")
    staged = attached.select(
        "*",
        _folded(F.col("expected_titles")).alias("__expected"),
        _folded(F.transform(results, lambda r: r["title"])).alias("__titles"),
        F.transform(
            _folded(F.col("expected_source_ids")), lambda s: s
        ).alias("__sources"),
        _folded(F.col("expected_terms")).alias("__terms"),
        tx.fold(
            F.array_join(
                F.transform(
                    _top(results, 5),
                    lambda r: F.concat_ws(
                        " ", *[F.coalesce(r[n], F.lit("")) for n in ("title", "section", "text")]
                    ),
                ),
                "\n",
            )
        ).alias("__haystack"),
    )
    hits = F.transform("__titles", lambda t: F.array_contains(F.col("__expected"), t))
    rank = F.nullif(F.array_position(hits, True), F.lit(0))

    def hit_at(k: int) -> Column:
        titles = _folded(F.transform(_top(results, k), lambda r: r["title"]))
        return F.arrays_overlap(F.col("__expected"), titles)

    expected = F.array_distinct("__expected")
    coverage = F.when(
        F.size(expected) > 0,
        F.size(F.array_intersect(expected, _top(F.col("__titles"), 5))) / F.size(expected),
    ).otherwise(0.0)
    in_text = F.filter("__terms", lambda t: F.contains(F.col("__haystack"), t))
    term_coverage = F.when(
        F.size("__terms") > 0, F.size(in_text) / F.size("__terms")
    ).otherwise(0.0)
    foreign = F.exists(
        results, lambda r: F.coalesce(r["game_id"] != F.col("game_id"), F.lit(False))
    )
    found_sources = F.transform(
        _top(results, 5), lambda r: tx.fold(F.coalesce(r["source_id"], F.lit("")))
    )
    return staged.select(
        *attached.columns,
        rank.alias("first_rank"),
        hit_at(1).alias("hit_at_1"),
        hit_at(5).alias("hit_at_5"),
        coverage.alias("coverage_at_5"),
        term_coverage.alias("term_coverage_at_5"),
        (F.coalesce(F.col("game_id"), F.lit("")).eqNullSafe("") | ~foreign).alias(
            "tenant_isolated"
        ),
        (F.size("__sources") > 0).alias("states_source"),
        F.arrays_overlap(F.col("__sources"), found_sources).alias("source_hit_at_5"),
    )


def retrieval_metrics(cases: DataFrame) -> DataFrame:
    """One row overall (category null, is_overall) and one per category."""
    cases = materialise(cases.drop("results"))
    rank = F.col("first_rank")

    def share(condition: Column) -> Column:
        hit = F.coalesce(condition, F.lit(False)).cast("int")
        return F.coalesce(F.round(F.avg(hit), 6), F.lit(0.0))

    def mean(value: Column) -> Column:
        return F.coalesce(F.round(F.avg(value), 6), F.lit(0.0))

    stated = F.col("states_source")

    def metrics(overall: bool) -> dict[str, Column]:
        return {
            "total": F.count(F.lit(1)),
            "hit_at_1": share(rank == 1 if overall else F.col("hit_at_1")),
            "hit_at_3": share(rank <= 3),
            "hit_at_5": share(rank <= 5 if overall else F.col("hit_at_5")),
            "mrr": mean(F.when(rank <= 5, 1 / rank).otherwise(0.0)),
            "coverage_at_5": mean(F.col("coverage_at_5")),
            "term_coverage_at_5": mean(F.col("term_coverage_at_5")),
            "tenant_isolation": share(F.col("tenant_isolated")),
            "source_hit_at_5": mean(F.when(stated, F.col("source_hit_at_5").cast("int"))),
            "source_expectation_total": F.count_if(stated),
            "avg_latency_ms": mean(F.col("latency_ms").cast("double")),
        }

    grouped = _overall_and_categories(cases, metrics)
    p95 = nearest_rank(
        cases.select(F.col("latency_ms").cast("double").alias("v")), "v", 0.95, name="p95"
    ).select(F.lit(True).alias("is_overall"), F.col("p95"))
    return grouped.join(F.broadcast(p95), "is_overall", "left").select(
        "*", F.when(F.col("is_overall"), F.coalesce("p95", F.lit(0.0))).alias("p95_latency_ms")
    ).drop("p95")


def _overall_and_categories(
    rows: DataFrame, metrics: Callable[[bool], dict[str, Column]]
) -> DataFrame:
    """One row over everything, also when there is nothing, and one per named category."""

    def columns(overall: bool) -> list[Column]:
        return [value.alias(name) for name, value in metrics(overall).items()]

    everything = rows.agg(*columns(True)).select(
        F.lit(None).cast("string").alias("category"), F.lit(True).alias("is_overall"), "*"
    )
    named = rows.filter(F.col("category").isNotNull() & (F.col("category") != ""))
    each = named.groupBy("category").agg(F.lit(False).alias("is_overall"), *columns(False))
    return everything.unionByName(each)


# ---- answers ---------------------------------------------------------------


def citation_present(answer: Column) -> Column:
    return F.regexp_like(answer, F.lit(r"(?U)\[\d+\]"))


def insufficient_context(answer: Column) -> Column:
    return tx.contains_any(tx.fold(answer), fixed.INSUFFICIENT_CONTEXT_MARKERS)


def answer_term_coverage(terms: Column, answer: Column) -> Column:
    """`terms` is an array of alternatives; a term counts when one alternative is in the answer."""
    low = tx.fold(answer)
    met = F.filter(terms, lambda alts: F.exists(alts, lambda a: F.contains(low, tx.fold(a))))
    return F.when(
        F.coalesce(F.size(terms), F.lit(0)) <= 0, 1.0
    ).otherwise(F.size(met) / F.size(terms))


def source_hit(expected: Column, sources: Column) -> Column:
    """Without an expectation, any source is a hit."""
    return F.when(F.size(expected) <= 0, F.size(sources) > 0).otherwise(
        F.arrays_overlap(
            F.transform(expected, tx.fold),
            F.transform(sources, lambda s: tx.fold(F.coalesce(s, F.lit("")))),
        )
    )


def answer_rows(rows: DataFrame) -> DataFrame:
    """Measures per answer. Wants answer, source_titles, expected_source_titles,
    expected_answer_terms (array of arrays) and allow_insufficient_context."""
    staged = rows.withColumns(
        {
            "source_hit": source_hit(F.col("expected_source_titles"), F.col("source_titles")),
            "citation_present": citation_present(F.col("answer")),
            "answer_term_coverage": answer_term_coverage(
                F.col("expected_answer_terms"), F.col("answer")
            ),
            "insufficient_context": insufficient_context(F.col("answer")),
        }
    )
    grounded = (
        (F.size("source_titles") > 0) & F.col("citation_present") & F.col("source_hit")
        & (F.col("answer_term_coverage") >= 1.0)
        & ~(F.col("insufficient_context") & ~F.col("allow_insufficient_context"))
    )
    return staged.withColumn("grounded", grounded)


def answer_metrics(rows: DataFrame) -> DataFrame:
    """Overall and per category."""

    def share(condition: Column) -> Column:
        return F.coalesce(F.round(F.avg(condition.cast("int")), 6), F.lit(0.0))

    def mean(value: Column) -> Column:
        return F.coalesce(F.round(F.avg(value), 6), F.lit(0.0))

    return _overall_and_categories(
        rows,
        lambda _: {
            "total": F.count(F.lit(1)),
            "source_presence": share(F.size("source_titles") > 0),
            "source_hit": share(F.col("source_hit")),
            "citation_presence": share(F.col("citation_present")),
            "answer_term_coverage": mean(F.col("answer_term_coverage")),
            "grounded_answer_rate": share(F.col("grounded")),
            "no_unexpected_insufficient_context": share(
                F.col("allow_insufficient_context") | ~F.col("insufficient_context")
            ),
            "avg_latency_ms": mean(F.col("latency_ms").cast("double")),
            "avg_answer_latency_ms": mean(F.col("answer_latency_ms").cast("double")),
        },
    )


def answer_report(rows: DataFrame) -> DataFrame:
    """The rows of an answer report: the case, what was retrieved and answered, and the measures.

    Wants the columns of `answer_rows` and those of the run; `sources` is an array of structs.
    """
    source = ("id", "title", "section", "url")
    return rows.select(
        "id", "query", "game_id", "category", "expected_source_titles", "expected_answer_terms",
        F.col("source_titles").alias("retrieved_titles"), "retrieval_query", "rewrite_reasons", "answer",
        F.transform("sources", lambda s: F.struct(*[s[c].alias(c) for c in source])).alias("sources"),
        "cache_status", "source_hit", "citation_present", "answer_term_coverage",
        "insufficient_context", "latency_ms", "answer_latency_ms",
    )


# ---- tool routing ----------------------------------------------------------


def tool_passed() -> Column:
    return F.col("expected_tool").eqNullSafe(F.col("selected_tool"))


def tool_report(rows: DataFrame) -> DataFrame:
    """The rows of a tool routing report."""
    return rows.select(
        "id", "query", "game_id", "category", "expected_tool", "selected_tool",
        tool_passed().alias("passed"), "latency_ms",
    )


def tool_metrics(rows: DataFrame) -> DataFrame:
    """Wants category, expected_tool, selected_tool, latency_ms; null means no tool."""
    passed = tool_passed().cast("int")
    return _overall_and_categories(
        rows,
        lambda _: {
            "total": F.count(F.lit(1)),
            "accuracy": F.coalesce(F.round(F.avg(passed), 6), F.lit(0.0)),
            "avg_latency_ms": F.coalesce(
                F.round(F.avg(F.coalesce(F.col("latency_ms"), F.lit(0)).cast("double")), 6),
                F.lit(0.0),
            ),
        },
    )


def retrieval_report(cases: DataFrame) -> DataFrame:
    """The rows of a retrieval report: measures plus the projected results."""
    return cases.select(
        "case_id", "query", "game_id", "category", "expected_titles", "expected_source_ids",
        F.transform("results", lambda r: r["title"]).alias("top_titles"),
        "latency_ms", "hit_at_1", "hit_at_5", "source_hit_at_5", "term_coverage_at_5",
        "tenant_isolated",
        F.transform(
            "results",
            lambda r: F.struct(
                r["rank"].alias("rank"), r["title"].alias("title"),
                r["game_id"].alias("game_id"), r["source_id"].alias("source_id"),
                r["section"].alias("section"),
            ),
        ).alias("results"),
    )
