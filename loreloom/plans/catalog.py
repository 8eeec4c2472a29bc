"""Registered queries: the operators bound to the given tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.functions.embedding import hash_embedding
from loreloom.functions.html import article_text_of
from loreloom.operators import (
    chunking, crawl, entities, evals, hybrid, indexing, ivf, lexical, manifests, numbering, requests,
    rerank, rewrite, sections, vector,
)
from loreloom.plans import bindings as b
from loreloom.session import join_small, materialise, scratch_path
from loreloom.sources import adapter, files, landed
from loreloom.streaming import jobs

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
VECTOR_SIZE = 64
NOW = "2024-02-01 00:00:00"


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def joined(column) -> F.Column:
    return F.array_join(column, "|")


# ---- text ------------------------------------------------------------------


@query
def tokens(spark, folder):
    """Tokens, important tokens, cleaned forum text, content hash and title slug per document."""
    docs = b.raw_documents(spark, folder)
    text = F.col("text_en")
    return docs.select(
        "doc_id",
        F.size(tx.tokens(text)).alias("n_tokens"),
        F.md5(F.array_join(tx.tokens(text), " ")).alias("tokens_md5"),
        F.md5(F.array_join(F.sort_array(tx.important_tokens(text)), " ")).alias("important_md5"),
        F.md5(tx.forum_text(F.replace(text, F.lit("and"), F.lit("&amp;lt;")))).alias("forum_md5"),
        tx.content_hash(text).alias("content_hash"),
        tx.slug(F.col("title")).alias("slug"),
    )


@query
def entity_names(spark, folder):
    """Normalised names of titles spelled in Cyrillic."""
    return b.cyrillic_titles(spark, folder).select(
        "doc_id", "title", tx.entity_name(F.col("title")).alias("normalized_name")
    )


@query
def content_type_rules(spark, folder):
    docs = b.listed_titles(spark, folder)
    low = tx.fold(F.col("title"))
    from loreloom.functions import fixed

    return docs.select(
        "doc_id", "title",
        tx.starts_with_any(low, fixed.WIKI_A_SKIP_PREFIXES).alias("skip_a"),
        tx.starts_with_any(low, fixed.WIKI_B_SKIP_PREFIXES).alias("skip_b"),
        tx.content_type_of(F.col("title"), F.col("categories")).alias("content_type"),
    )


@query
def html_text(spark, folder):
    pages = b.table(spark, folder, "pages")
    return pages.select(
        "page_id",
        article_text_of(F.col("html"), root_id=None, root_tag="article", keep_tables=True).alias(
            "text"
        ),
    ).select("page_id", F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"))


# ---- sections and chunks ---------------------------------------------------


def _section_rows(documents):
    return sections.explode_sections(documents).select(
        "doc_id", F.col("ord").alias("section_no"), "section",
        F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"), "spoiler_level",
    )


@query
def doc_sections(spark, folder):
    docs = b.sectioned_documents(spark, folder).drop("ord")
    return _section_rows(sections.split_sections(docs, sections.WIKI_A))


@query
def doc_sections_plain(spark, folder):
    docs = b.sectioned_documents(spark, folder).drop("ord")
    return _section_rows(sections.split_sections(docs, sections.WIKI_B))


@query
def thread_sections(spark, folder):
    threads = landed.thread_rows(b.landed_threads(spark, folder))
    return _section_rows(sections.thread_sections(threads))


@query
def chunk_fixed(spark, folder):
    docs = b.raw_documents(spark, folder)
    windows = tx.explode_once(docs, chunking.fixed_windows(F.col("text_en")), "c", "pos")
    return windows.select(
        F.concat_ws(
            ":", "doc_id", tx.slug(F.col("title")), F.format_string("%04d", F.col("pos") + 1)
        ).alias("chunk_id"),
        F.length("c").alias("n_chars"), F.md5("c").alias("text_md5"),
    )


@query
def sentence_split(spark, folder):
    docs = b.raw_documents(spark, folder)
    return docs.select("doc_id", chunking.sentences(F.col("text_en")).alias("s")).select(
        "doc_id", F.size("s").alias("n_sentences"), F.md5(F.array_join("s", "|")).alias("text_md5")
    )


@query
def chunk_paragraphs(spark, folder):
    """Every line a paragraph; packed to 800 characters with one paragraph of overlap."""
    docs = b.raw_documents(spark, folder)
    text = F.replace("text_en", F.lit("\n"), F.lit("\n\n"))
    return tx.explode_once(docs, chunking.pack_paragraphs(text, 800, 1), "c", "pos").select(
        "doc_id", (F.col("pos") + 1).alias("chunk_no"),
        F.length("c").alias("n_chars"), F.md5("c").alias("text_md5"),
    )


def _chunks(spark, folder):
    docs = sections.split_sections(b.sectioned_documents(spark, folder), sections.WIKI_A)
    return chunking.chunk_documents(docs)


@query
def chunk_table(spark, folder):
    """Raw documents written and read back, cut into sections and chunks, written, read back."""
    raw = scratch_path(spark, "raw")
    out = scratch_path(spark, "chunks")
    files.write_raw_documents(b.sectioned_documents(spark, folder), raw)
    docs = sections.split_sections(spark.read.parquet(raw), sections.WIKI_A)
    files.write_chunks(chunking.chunk_documents(docs), out)
    return files.read_corpus(spark, out).select(
        "chunk_id", "game_id", "source_id", "section", "spoiler_level",
        F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"),
    )


@query
def landed_documents(spark, folder):
    """Raw documents landed as JSON, read by the data source; the filter leaves out files."""
    path = scratch_path(spark, "landed")
    adapter.land_documents(b.landable(spark, folder), path)
    return adapter.read_landed(spark, path).filter("game_id = 'en'").select(
        "doc_id", "game_id", "source_id", "title", "content_type", F.md5("text_en").alias("text_md5"),
        F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"),
    )


@query
def landed_stream(spark, folder):
    """The same files as a stream: rows and bytes of text per tenant and source."""
    path, root = scratch_path(spark, "landed"), scratch_path(spark, "arrivals")
    adapter.land_documents(b.landable(spark, folder), path)
    stream = adapter.landed_stream(spark, path)

    def process(batch, number):
        counted = batch.groupBy("game_id", "source_id").agg(
            F.count(F.lit(1)).alias("n"), F.sum(F.length("text_en")).alias("n_chars")
        )
        counted.write.mode("overwrite").parquet(f"{root}/counts/batch={number}")

    jobs.run_available(stream, process, f"{root}/progress")
    return spark.read.parquet(f"{root}/counts").groupBy("game_id", "source_id").agg(
        F.sum("n").alias("n"), F.sum("n_chars").alias("n_chars")
    )


@query
def raw_json_documents(spark, folder):
    """The landed JSON through Spark's own reader."""
    path = scratch_path(spark, "landed")
    b.landable(spark, folder).write.json(path)
    return files.read_raw_documents(spark, path, lines=True).select(
        "doc_id", "game_id", "source_id", "title", F.md5("text_en").alias("text_md5")
    )


@query
def entity_files(spark, folder):
    """The registry written as JSON lines and read back."""
    path = scratch_path(spark, "entities")
    entities.build_entities(b.corpus(spark, folder)).write.json(path)
    return files.read_entities(spark, path, lines=True).select(
        "game_id", "canonical_name", "normalized_name", "content_type", "source_url",
        joined("aliases").alias("aliases"),
    )


@query
def corpus_union(spark, folder):
    """The chunk table read from two folders, named in one setting beside one that does not exist."""
    chunks = materialise(_chunks(spark, folder))
    paths = [scratch_path(spark, name) for name in ("first", "second", "absent")]
    files.write_chunks(chunks.filter("game_id = 'en'"), paths[0])
    files.write_chunks(chunks.filter("game_id <> 'en'"), paths[1])
    return files.read_corpus(spark, paths[0], ";".join(paths[1:])).select(
        "chunk_id", "game_id", "source_id", "section", "spoiler_level",
        F.length("text").alias("n_chars"), F.md5("text").alias("text_md5"),
    )


@query
def golden_retrieval(spark, folder):
    """Retrieval cases written as golden lines and read back."""
    path = scratch_path(spark, "golden")
    b.retrieval_lines(spark, folder).write.json(path)
    return files.read_retrieval_golden(spark, path).select(
        "id", "query", "game_id", "category", joined("expected_titles").alias("titles"),
        F.size("expected_terms").alias("n_terms"), joined("expected_source_ids").alias("sources"),
    )


@query
def golden_tools(spark, folder):
    path = scratch_path(spark, "golden")
    b.tool_lines(spark, folder).write.json(path)
    return files.read_tool_golden(spark, path)


@query
def golden_answers(spark, folder):
    """Answer cases written as golden lines and read back; terms keep their kind."""
    path = scratch_path(spark, "golden")
    b.golden_lines(spark, folder).write.text(path)
    return files.read_answer_golden(spark, path).select(
        "id", "query", "game_id", F.size("expected_source_titles").alias("n_titles"),
        F.array_join(
            F.transform("expected_answer_terms", lambda t: F.array_join(t, "~")), "|"
        ).alias("terms"),
        "allow_insufficient_context",
    )


# ---- retrieval -------------------------------------------------------------


def _bm25(spark, folder, k):
    return lexical.bm25_search(b.corpus(spark, folder), b.queries(spark, folder), k)


@query
def bm25_topk(spark, folder):
    return _bm25(spark, folder, 5).select("query_id", "chunk_id", "bm25_score", "score", "rank")


@query
def corpus_stats(spark, folder):
    """Document frequency of every term, with the corpus size and the mean length."""
    index = lexical.build_index(b.corpus(spark, folder))
    return index.document_frequencies().select(
        "term", "df",
        F.lit(index.total).cast("bigint").alias("total_documents"),
        F.round(F.lit(index.average_length), 6).alias("average_length"),
    )


@query
def hash_embeddings(spark, folder):
    embed = hash_embedding(VECTOR_SIZE)
    docs = b.raw_documents(spark, folder)
    return tx.explode_once(docs, embed(F.col("text_en")), "v", "pos").select(
        "doc_id", "pos", F.round("v", 6).alias("value")
    )


@query
def vector_topk(spark, folder):
    """Every vector asks for its nearest ones with the same label."""
    vectors = b.table(spark, folder, "embeddings").select(
        "vec_id", F.col("vec_id").alias("ord"), F.col("label").cast("string").alias("game_id"),
        "embedding",
    )
    asked = vectors.select(F.col("vec_id").alias("query_id"), "game_id", "embedding")
    return vector.vector_search(vectors, asked, 5, key="vec_id").select(
        "query_id", "vec_id", "score", "rank"
    )


@query
def vector_ivf(spark, folder):
    """The same question through an inverted file, with the share of the exact results it finds."""
    vectors = b.table(spark, folder, "embeddings").select(
        "vec_id", F.col("vec_id").alias("ord"), F.col("label").cast("string").alias("game_id"),
        "embedding",
    )
    asked = vectors.select(F.col("vec_id").alias("query_id"), "game_id", "embedding")
    centres = ivf.fit_centres(vectors, "vec_id")
    found = materialise(ivf.ivf_search(ivf.assign(vectors, centres), asked, centres, 5, "vec_id"))
    recall = ivf.recall(found, vector.vector_search(vectors, asked, 5, key="vec_id"), "vec_id")
    return found.join(recall, "query_id").select("query_id", "vec_id", "score", "rank", "recall")


def _vectors(spark, folder, k):
    embed = hash_embedding(VECTOR_SIZE)
    asked = b.queries(spark, folder).select(
        "query_id", "game_id", embed(F.col("query")).alias("embedding")
    )
    return vector.vector_search(hybrid.embed_chunks(b.corpus(spark, folder), embed), asked, k)


@query
def hybrid_merge(spark, folder):
    merged = hybrid.merge_candidates(_vectors(spark, folder, 50), _bm25(spark, folder, 50))
    return merged.drop("retrieval_sources")


@query
def hybrid_merge_keys(spark, folder):
    """The merge where every third chunk has lost its id and is known by its source and text."""
    chunks = b.corpus(spark, folder).withColumn(
        "own_id", F.when(F.col("ord") % 3 != 0, F.col("chunk_id"))
    )
    renamed = chunks.withColumnsRenamed({"chunk_id": "place", "own_id": "chunk_id"})
    keys = materialise(renamed.select("place", hybrid.result_key().alias("result_key")))

    def known(rows):
        return join_small(keys, materialise(rows.withColumnRenamed("chunk_id", "place")), ["place"]).drop("place")

    merged = hybrid.merge_candidates(
        known(_vectors(spark, folder, 50)), known(_bm25(spark, folder, 50)), "result_key"
    )
    return merged.withColumn("result_key", F.md5("result_key")).drop("retrieval_sources")


def _candidates(spark, folder):
    """BM25 candidates with their payload and the query text."""
    found = _bm25(spark, folder, 50).select(
        "query_id", "chunk_id", "score", F.lit(0).alias("list_no"), F.col("rank").alias("list_rank")
    )
    rows = hybrid.with_payload(found, b.corpus(spark, folder))
    return join_small(rows, b.queries(spark, folder).select("query_id", "query"), ["query_id"])


@query
def source_policy(spark, folder):
    return rerank.apply_source_policy(_candidates(spark, folder)).select(
        "query_id", "chunk_id", "score", joined("source_policy_reasons").alias("reasons")
    )


@query
def rerank_order(spark, folder):
    """The ten best by the three rerank keys, before any diversification."""
    from loreloom.operators.topk import top_k

    scored = rerank.rerank_scores(rerank.apply_source_policy(_candidates(spark, folder)))
    return top_k(scored, ["query_id"], rerank.rerank_order(), 10).select(
        "query_id", "chunk_id", "rank", "rerank_score", "rerank_exact_title_match",
        "rerank_definition_lead_section", joined("rerank_reasons").alias("reasons"),
    )


def _ranked(spark, folder, limit=10):
    scored = rerank.rerank_scores(rerank.apply_source_policy(_candidates(spark, folder)))
    return rerank.rank_scored(scored.drop("text"), limit)


def _rank_columns(ranked):
    return ranked.select(
        "query_id", "chunk_id", "rank", "rerank_score", joined("rerank_reasons").alias("reasons")
    )


@query
def diversify_title(spark, folder):
    ranked = _ranked(spark, folder)
    return _rank_columns(ranked.filter(tx.is_comparative(F.col("query"))))


@query
def diversify_section(spark, folder):
    ranked = _ranked(spark, folder)
    return _rank_columns(
        ranked.filter(tx.is_definitional(F.col("query")) & ~tx.is_comparative(F.col("query")))
    )


@query
def hint_finalize(spark, folder):
    """Rerank order cut to ten, then forum rows first for the hint queries."""
    from loreloom.operators.topk import top_k

    scored = rerank.rerank_scores(rerank.apply_source_policy(_candidates(spark, folder)))
    ranked = top_k(scored, ["query_id"], rerank.rerank_order(), 10)
    return rerank.finalise(ranked).select("query_id", "chunk_id", "source_id", "rank")


def _base(spark, folder, **more):
    embed = hash_embedding(VECTOR_SIZE)
    chunks = b.corpus(spark, folder)
    return hybrid.KnowledgeBase(chunks, hybrid.embed_chunks(chunks, embed), embed, **more)


def _result_columns(results):
    return results.select(
        "query_id", "rank", "chunk_id", "retrieval_source", "bm25_score", "score", "rerank_score",
        joined("rerank_reasons").alias("rerank_reasons"),
        joined("source_policy_reasons").alias("source_policy_reasons"),
        "retrieval_query", joined("rewrite_reasons").alias("rewrite_reasons"),
    )


@query
def hybrid_search(spark, folder):
    return _result_columns(hybrid.search(_base(spark, folder), b.queries(spark, folder)))


@query
def vector_search(spark, folder):
    return _result_columns(
        hybrid.search(_base(spark, folder, hybrid=False), b.queries(spark, folder))
    )


# ---- entities and rewriting ------------------------------------------------


@query
def entity_registry(spark, folder):
    return entities.build_entities(b.corpus(spark, folder)).select(
        "game_id", "canonical_name", "normalized_name", "content_type", "source_url",
        joined("aliases").alias("aliases"),
    )


@query
def entity_list(spark, folder):
    registry = entities.build_entities(b.corpus(spark, folder))
    return entities.list_entities(registry).select("game_id", "canonical_name", "content_type")


@query
def entity_exact(spark, folder):
    registry = entities.build_entities(b.corpus(spark, folder))
    return entities.exact_lookup(registry, b.name_lookups(spark, folder)).select(
        "lookup_id", "game_id", "name", "canonical_name", "content_type"
    )


@query
def entity_mentions(spark, folder):
    registry = entities.build_entities(b.corpus(spark, folder))
    return entities.mentions(registry, b.tenant_texts(spark, folder)).select(
        "text_id", "game_id", "canonical_name", "content_type", "position"
    )


@query
def entity_fuzzy(spark, folder):
    """The words of the benchmark texts against the English titles."""
    registry = entities.build_entities(b.corpus(spark, folder))
    values = tx.explode_once(
        b.table(spark, folder, "benchmark"), tx.words(F.col("text")), "value"
    ).withColumn("game_id", F.lit("en"))
    return entities.fuzzy_lookup(registry, values)


@query
def rewrite_queries(spark, folder):
    return rewrite.rewrite_queries(b.mixed_queries(spark, folder)).select(
        "query_id", "retrieval_query", joined("rewrite_reasons").alias("rewrite_reasons")
    )


@query
def rewrite_names(spark, folder):
    registry = entities.build_entities(b.corpus(spark, folder))
    return rewrite.rewrite_queries(b.mixed_queries(spark, folder), registry).select(
        "query_id", "retrieval_query", joined("rewrite_reasons").alias("rewrite_reasons")
    )


# ---- evaluation ------------------------------------------------------------


def _evaluated(spark, folder):
    """The cases with what their own question finds."""
    cases = materialise(b.golden_cases(spark, folder))
    corpus = b.corpus(spark, folder)
    asked = cases.select(F.col("case_id").alias("query_id"), "game_id", "query")
    found = lexical.bm25_search(corpus, asked, 5).drop("ord")
    return evals.retrieval_cases(evals.attach_results(cases, hybrid.with_payload(found, corpus)))


@query
def retrieval_cases(spark, folder):
    return _evaluated(spark, folder).select(
        "case_id", "category", "first_rank", "hit_at_1", "hit_at_5",
        F.round("coverage_at_5", 6).alias("coverage_at_5"),
        F.round("term_coverage_at_5", 6).alias("term_coverage_at_5"),
        "tenant_isolated", "source_hit_at_5",
    )


@query
def retrieval_metrics(spark, folder):
    return evals.retrieval_metrics(_evaluated(spark, folder))


@query
def eval_report(spark, folder):
    """Report written to the shared folder and read back."""
    path = scratch_path(spark, "report")
    cases = materialise(_evaluated(spark, folder))
    files.write_report(evals.retrieval_metrics(cases), evals.retrieval_report(cases), path)
    return spark.read.json(f"{path}/cases").select(
        "case_id", "query", "game_id", F.array_join("top_titles", "|").alias("top_titles"),
        "hit_at_1", "hit_at_5", "source_hit_at_5", "tenant_isolated",
    )


@query
def nearest_rank_p95(spark, folder):
    events = b.table(spark, folder, "events")
    per_type = numbering.nearest_rank(events, "value", 0.95, ["event_type"], "p95")
    overall = numbering.nearest_rank(events, "value", 0.95, name="p95").select(
        F.lit("all").alias("event_type"), "p95"
    )
    return per_type.unionByName(overall)


@query
def answer_metrics(spark, folder):
    return evals.answer_metrics(evals.answer_rows(b.answers(spark, folder)))


@query
def answer_report(spark, folder):
    """The answer report written to the shared folder and read back."""
    path = scratch_path(spark, "report")
    rows = evals.answer_rows(b.answer_runs(spark, folder))
    cases = evals.answer_report(rows)
    files.write_report(evals.answer_metrics(rows), cases, path)
    return spark.read.schema(cases.schema).json(f"{path}/cases").select(
        "id", "category", "retrieval_query", F.size("sources").alias("n_sources"),
        F.get("sources", F.lit(0))["url"].alias("first_url"), "source_hit", "citation_present",
        F.round("answer_term_coverage", 6).alias("answer_term_coverage"), "insufficient_context",
        F.col("latency_ms").cast("bigint").alias("latency_ms"),
    )


# ---- requests --------------------------------------------------------------


@query
def request_guard(spark, folder):
    """Every request with its decision; blocked ones carry the fixed answer."""
    guarded = requests.guard(b.requests(spark, folder))
    blocked = requests.blocked_responses(guarded).select(
        "request_id", "allowed", "reason", "answer"
    )
    allowed = guarded.filter("allowed").select(
        "request_id", "allowed", "reason", F.lit(None).cast("string").alias("answer")
    )
    return allowed.unionByName(blocked)


@query
def tenant_route(spark, folder):
    routed = requests.route_tenant(b.requests(spark, folder), ["bg3", "blue_prince"])
    return routed.select("request_id", "game_id", "method", "confidence", "routing_reason")


@query
def session_tail(spark, folder):
    return requests.session_tail(b.turns(spark, folder)).select(
        "session_id", "turn", "role", "position"
    )


@query
def memory_context(spark, folder):
    return requests.memory_context(b.turns(spark, folder)).select(
        "session_id", "turn", F.md5("memory_context").alias("context_md5"),
        F.md5("search_query").alias("search_md5"),
    )


def _selected(spark, folder):
    """Tools by rules and mentions; names are not respelled here (see rewrite_names)."""
    routed = requests.route_tenant(b.requests(spark, folder), ["bg3", "blue_prince"])
    asked = routed.select(
        F.col("request_id").alias("query_id"), "game_id", F.col("message").alias("query")
    )
    return requests.select_tools(
        asked, entities=b.game_entities(spark, folder), fix_names=False
    )


def _argument_text(arguments):
    return F.array_join(
        F.transform(
            F.array_sort(F.map_keys(arguments)),
            lambda k: F.concat(k, F.lit("="), F.try_element_at(arguments, k)),
        ),
        "|",
    )


@query
def tool_routing(spark, folder):
    return _selected(spark, folder).select(
        F.col("query_id").alias("request_id"), "game_id", "tool",
        _argument_text(F.col("arguments")).alias("arguments"),
    )


def _tool_cases(spark, folder):
    chosen = _selected(spark, folder).select(
        F.col("query_id").alias("id"), "game_id", F.col("tool").alias("selected_tool")
    )
    expected = b.expected_tools(spark, folder).withColumnRenamed("request_id", "id")
    asked = b.requests(spark, folder).select(F.col("request_id").alias("id"), F.col("message").alias("query"))
    return chosen.join(expected, "id").join(asked, "id")


@query
def tool_metrics(spark, folder):
    return evals.tool_metrics(_tool_cases(spark, folder))


@query
def tool_report(spark, folder):
    """The tool routing report written to the shared folder and read back."""
    path = scratch_path(spark, "report")
    rows = materialise(_tool_cases(spark, folder))
    cases = evals.tool_report(rows)
    files.write_report(evals.tool_metrics(rows), cases, path)
    return spark.read.schema(cases.schema).json(f"{path}/cases").select(
        "id", "game_id", "category", "expected_tool", "selected_tool", "passed", "latency_ms",
        F.md5("query").alias("query_md5"),
    )


@query
def tool_evidence(spark, folder):
    """What the chosen tools bring back: entity lists and searches with templated queries."""
    selected = _selected(spark, folder)
    registry = b.game_entities(spark, folder)
    listed = requests.listing_evidence(selected, registry).select(
        F.col("query_id").alias("request_id"), "tool", "rank", "title", "section"
    )
    chunks = b.game_corpus(spark, folder)
    embed = hash_embedding(VECTOR_SIZE)
    base = hybrid.KnowledgeBase(chunks, hybrid.embed_chunks(chunks, embed), embed)
    found = hybrid.search(base, requests.tool_queries(selected)).join(
        selected.select("query_id", "tool"), "query_id"
    )
    return listed.unionByName(
        found.select(F.col("query_id").alias("request_id"), "tool", "rank", "title", "section")
    )


@query
def tool_entities(spark, folder):
    """The registry's rows of the spells that a comparison was asked for."""
    registry = materialise(b.game_entities(spark, folder))
    selected = requests.select_tools(b.spell_comparisons(spark, folder), entities=registry, fix_names=False)
    found = requests.compared_entities(selected, registry)
    return found.select(
        F.col("query_id").alias("request_id"), "tool", "argument", "name", "canonical_name",
        "content_type", "source_url",
    )


@query
def request_answers(spark, folder):
    """Requests through routing, guard, memory, retrieval, prompt and trace columns."""
    from loreloom.plans.request_flow import answer_requests

    chunks = b.game_corpus(spark, folder)
    embed = hash_embedding(VECTOR_SIZE)
    base = hybrid.KnowledgeBase(chunks, hybrid.embed_chunks(chunks, embed), embed)
    done = answer_requests(
        b.requests(spark, folder), b.turns(spark, folder), base,
        b.game_entities(spark, folder), ["bg3", "blue_prince"],
    )
    return done.select(
        "request_id", "game_id", "intent", "is_safe", "safety_reason", "selected_tool",
        "retrieval_query", F.size("context").alias("n_chunks"), F.md5("prompt").alias("prompt_md5"),
        "answer", joined("source_policy_reasons").alias("source_policy_reasons"),
        F.array_join(F.transform("trace", lambda t: t["title"]), "|").alias("top_titles"),
    )


def _contexts(spark, folder):
    results = hybrid.with_payload(_bm25(spark, folder, 5).drop("ord"), b.corpus(spark, folder))
    return join_small(requests.context_lists(results), b.queries(spark, folder), ["query_id"])


@query
def prompt_pack(spark, folder):
    packed = _contexts(spark, folder)
    return packed.select(
        "query_id",
        F.md5(requests.prompt(F.col("game_id"), F.col("query"), F.col("context"))).alias(
            "prompt_md5"
        ),
        joined(
            F.transform(
                requests.citations(F.col("context")),
                lambda s: F.concat_ws(
                    "~", s["id"].cast("string"), s["title"], s["section"], s["url"]
                ),
            )
        ).alias("sources"),
    )


@query
def source_mix(spark, folder):
    results = hybrid.with_payload(_bm25(spark, folder, 5).drop("ord"), b.corpus(spark, folder))
    mix = requests.source_mix(results)
    policy = rerank.apply_source_policy(
        join_small(results, b.queries(spark, folder).select("query_id", "query"), ["query_id"])
    )
    reasons = requests.context_lists(policy).select(
        "query_id", joined(requests.policy_reasons(F.col("context"))).alias("policy_reasons")
    )
    return mix.join(reasons, "query_id").select(
        "query_id",
        joined(
            F.transform(
                F.map_entries("source_mix"),
                lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")),
            )
        ).alias("source_mix"),
        "policy_reasons",
    )


@query
def answer_cache_lookup(spark, folder):
    """Prompts looked up in a cache that an earlier run filled for the documents with a label."""
    wanted, cache = b.cache_rows(spark, folder)
    now = F.lit(NOW).cast("timestamp")
    return requests.cache_lookup(wanted, cache, now).select(
        "question_id", "cache_key", "answer", "cache_status"
    )


@query
def cache_purge(spark, folder):
    _, cache = b.cache_rows(spark, folder)
    dry = requests.cache_purge(cache, "answers:v1", dry_run=True).counts
    purged = requests.cache_purge(cache, "answers:v1", dry_run=False)
    left = purged.kept.agg(F.count(F.lit(1))).scalar()
    return dry.unionByName(purged.counts).withColumn("remaining", left)


@query
def rate_limit(spark, folder):
    return requests.rate_limit(b.hits(spark, folder), 1, 5).select(
        "hit_id", "client", "minute_count", "day_count", "limit_name", "retry_after"
    )


# ---- crawl, manifests, index -----------------------------------------------


def _crawl(spark, folder):
    now = F.lit(NOW).cast("timestamp")
    state, fetched, manifest = b.crawl_tables(spark, folder)
    return now, state, crawl.crawl_plan(manifest, state, fetched, now, stale_fallback=True)


@query
def crawl_plan(spark, folder):
    return _crawl(spark, folder)[2].select(
        "doc_id", "status", "content_hash", "if_none_match"
    )


@query
def crawl_merge(spark, folder):
    now, state, plan = _crawl(spark, folder)
    outcomes = plan.withColumn(
        "raw_path", crawl.raw_path("raw", F.col("game_id"), F.col("source_id"), F.col("doc_id"))
    )
    return crawl.crawl_merge(state, outcomes, now).select(
        "doc_id", "game_id", "raw_path", "content_hash", "status_code", "etag",
        F.date_format("fetched_at", "yyyy-MM-dd HH:mm:ss").alias("fetched_at"),
        F.date_format("checked_at", "yyyy-MM-dd HH:mm:ss").alias("checked_at"),
    )


@query
def manifest_dedupe(spark, folder):
    return manifests.dedupe(b.title_refs(spark, folder)).select(
        "doc_id", "title", "content_type", "ord"
    )


@query
def manifest_check(spark, folder):
    """Sources of the documents that no labelled document has, per language."""
    docs = b.raw_documents(spark, folder).select(
        F.concat_ws("/", "game_id", "source_id").alias("category"), "ord"
    )
    labels = b.table(spark, folder, "labels").select(F.col("doc_id").alias("ord"))
    return manifests.unknown_values(docs, docs.join(labels, "ord", "left_semi"), "category")


@query
def manifest_listing(spark, folder):
    categories, pages = b.landed_listings(spark, folder)
    one = landed.category_refs(categories, "wiki_a", "https://a.example/wiki/")
    two = landed.page_refs(pages, "wiki_b", "https://b.example/wiki/")
    return one.unionByName(two).select("doc_id", "source_url", "title", "content_type")


@query
def manifest_seed(spark, folder):
    from loreloom.functions import fixed

    pages, urls = b.seed_tables(spark, folder)
    seeds = manifests.seed_refs(pages, "wiki_a", "https://a.example/wiki/", fixed.SEED_BUDGETS)
    plain = manifests.seed_refs(pages, "wiki_b", "https://b.example/wiki/", quote=True)
    threads = manifests.thread_refs(urls, "forum", "/r/")
    columns = ["doc_id", "source_url", "title", "content_type"]
    return (
        seeds.select(*columns).unionByName(plain.select(*columns))
        .unionByName(threads.select(*columns))
    )


@query
def even_sample(spark, folder):
    refs = b.title_refs(spark, folder)
    return manifests.take_evenly(manifests.dedupe(refs), 101).select(
        "doc_id", "content_type", "position"
    )


@query
def budget_sample(spark, folder):
    refs = manifests.dedupe(b.title_refs(spark, folder))
    return manifests.take_budgeted(refs, b.budgets(spark), 101).select(
        "doc_id", "content_type", "position"
    )


@query
def point_ids(spark, folder):
    return indexing.points(b.chunk_rows(spark, folder)).select(
        "point_id", "chunk_id", "game_id", "source_id", "title"
    )


def _point_columns(points):
    return points.select("point_id", "chunk_id", "game_id", "source_id", F.md5("text").alias("md5"))


def _old_and_new(spark, folder):
    chunks = b.chunk_rows(spark, folder)
    return indexing.points(chunks), indexing.points(b.changed_chunks(spark, folder))


@query
def index_append(spark, folder):
    old, new = _old_and_new(spark, folder)
    return _point_columns(indexing.rebuild(old, new, "en", "append"))


@query
def index_rebuild_source(spark, folder):
    old, new = _old_and_new(spark, folder)
    return _point_columns(indexing.rebuild(old, new, "en", "rebuild-source", "src1_wiki"))


@query
def index_rebuild_game(spark, folder):
    """All sources of the tenant are dropped, one comes back."""
    old, new = _old_and_new(spark, folder)
    return _point_columns(
        indexing.rebuild(old, new, "en", "rebuild-game", "src1_wiki", confirm="en")
    )


@query
def embed_batch(spark, folder):
    """Points with vectors; the vector of each chunk is joined back and must exist."""
    embed = hash_embedding(VECTOR_SIZE)
    chunks = b.chunk_rows(spark, folder)
    vectors = chunks.select("chunk_id", embed(F.col("text")).alias("embedding"))
    return indexing.with_vectors(chunks, vectors).select(
        "point_id", "chunk_id", F.size("embedding").alias("dimensions"),
        F.round(F.get("embedding", F.lit(0)), 6).alias("first_value"),
    )


# ---- streams ---------------------------------------------------------------


@query
def stream_rate_limit(spark, folder):
    return jobs.limited_requests(b.hit_stream(spark, folder), 1, 5).select(
        "hit_id", "client", "minute_count", "day_count", "limit_name", "retry_after"
    )


@query
def stream_windows(spark, folder):
    return jobs.request_windows(b.hit_stream(spark, folder), "1 day").select(
        F.date_format("window_start", "yyyy-MM-dd").alias("day"), "client", "n"
    )


@query
def stream_sessions(spark, folder):
    return jobs.session_tails(b.turn_stream(spark, folder)).select("session_id", "turn", "role")


@query
def stream_crawl(spark, folder):
    state, manifest, fetched = b.crawl_stream(spark, folder)
    merged = jobs.crawl_states(fetched, manifest, state, F.lit(NOW).cast("timestamp"))
    return merged.select("doc_id", "content_hash", "status_code", "etag")


@query
def stream_index(spark, folder):
    return _point_columns(jobs.index_points(b.chunk_stream(spark, folder)))


def _stored_index(spark, folder):
    """An inverted index built by three runs of deliveries."""
    root = scratch_path(spark, "postings")
    for run, mode, stream in b.chunk_deliveries(spark, folder):
        index = jobs.index_postings(stream, mode, root, run)
    return index


@query
def stream_postings(spark, folder):
    """Document frequencies and statistics as they stand after appends, changes and a rebuild."""
    index = _stored_index(spark, folder)
    return index.document_frequencies().select(
        "term", "df", F.lit(index.total).cast("bigint").alias("total_documents"),
        F.round(F.lit(index.average_length), 6).alias("average_length"),
    )


@query
def stream_bm25(spark, folder):
    """The questions against that index."""
    found = lexical.search(_stored_index(spark, folder), b.queries(spark, folder), 5)
    return found.select("query_id", "chunk_id", "bm25_score", "score", "rank")


@query
def stream_cache(spark, folder):
    """Hits, misses and expiries of a stream of answers and questions."""
    return jobs.cached_answers(b.cache_events(spark, folder)).select(
        "event_id", "cache_key", "answer", "cache_status"
    )
