"""Registered queries of the corpus operators and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.llm.bpe import encode_texts
from loreloom.llm.common import keyed
from loreloom.llm.decontaminate import contaminated
from loreloom.llm.exact import exact_groups, normalised
from loreloom.llm.filteraudit import audit_filters
from loreloom.llm.hardnegatives import mine_hard_negatives
from loreloom.llm.jaccard import near_duplicates
from loreloom.llm.mainblocks import extract_main_text
from loreloom.llm.simhash import simhash_groups
from loreloom.llm.substrings import drop_repeats
from loreloom.llm.suffixes import drop_repeated_bytes
from loreloom.llm.toxicity import held_out, score_texts
from loreloom.llm.warc import archive_pages
from loreloom.llm.wordpiece import count_pieces


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files are installed."""
    import public_tokenizers

    return public_tokenizers.path(name)


def digested(df: DataFrame) -> DataFrame:
    """Token counts and digests of `ids` and `decoded`."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return df.select(
        "doc_id", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op1_exact_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(table(spark, folder, "documents").select("doc_id", "text"))
    digests = docs.select("row_key", F.sha2(normalised(F.col("text")), 256).alias("text_sha256"))
    groups = exact_groups(docs)
    return groups.join(digests, "row_key").select(
        "doc_id", "keep_id", "group_size", "kept", "text_sha256"
    )


def op2_jaccard_join(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(table(spark, folder, "documents").select("doc_id", "text"))
    rows = near_duplicates(docs, width=3, percent=90)
    return rows.select("doc_id", "n_shingles", F.col("component").alias("component_id"))


def op3_bpe(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return digested(encode_texts(docs, vocabulary_path()))


def op4_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(table(spark, folder, "documents").select("doc_id", "text"))
    return drop_repeated_bytes(docs).select(
        "doc_id", "n_bytes", "n_removed", F.size("starts").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    scored = score_texts(docs, table(spark, folder, "labels").select("doc_id", "toxic"))
    return scored.select(
        "doc_id", held_out().alias("held_out"), "score", "predicted", "worst_sentence", "worst_score"
    )


def op6_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(table(spark, folder, "documents").select("doc_id", "text"))
    return contaminated(docs, table(spark, folder, "benchmark")).drop("row_key")


def op7_html_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages").select("page_id", "url", "html")
    return extract_main_text(pages).select(
        "page_id", "url", "text", F.length("text").cast("long").alias("n_chars")
    )


def op8_warc(spark: SparkSession, folder: str) -> DataFrame:
    return archive_pages(table(spark, folder, "pages")).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents").select("doc_id", "text")
    return count_pieces(docs, vocabulary_path())


def op10_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(table(spark, folder, "documents").select("doc_id", "text"))
    return drop_repeats(docs).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


def op11_hard_negatives(spark: SparkSession, folder: str) -> DataFrame:
    moved = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    vectors = table(spark, folder, "embeddings").withColumn("label", moved)
    return mine_hard_negatives(vectors, F.col("vec_id") % 100 == 0)


def op12_simhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    docs = keyed(table(spark, folder, "documents").select("doc_id", "text"))
    return simhash_groups(docs).select(
        "doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op13_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return audit_filters(table(spark, folder, "documents"), table(spark, folder, "labels"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_bpe": op3_bpe,
    "op4_suffix_dedup": op4_suffix_dedup,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_html_text": op7_html_text,
    "op8_warc": op8_warc,
    "op9_token_counts": op9_token_counts,
    "op10_substring_dedup": op10_substring_dedup,
    "op11_hard_negatives": op11_hard_negatives,
    "op12_simhash_dedup": op12_simhash_dedup,
    "op13_filter_audit": op13_filter_audit,
}

ORACLES: dict[str, str] = {
    "op1_exact_dedup": r"""
        WITH clean AS (
            SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body
            FROM documents
        )
        SELECT doc_id, min(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
            doc_id = min(doc_id) OVER same AS kept, sha256(body) AS text_sha256
        FROM clean WINDOW same AS (PARTITION BY body)
    """,
    # Every window that shares a shingle with the item is tried, wherever it begins.
    "op6_decontamination": r"""
        WITH bare AS (
            SELECT doc_id, text, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')),
                '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM documents
        ), items AS (
            SELECT item_id, list_filter(string_split_regex(regexp_replace(lower(coalesce(text, '')),
                '[^\p{L}\p{N}\x20\x09-\x0D]+', '', 'g'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words
            FROM benchmark
        ), item_runs AS (
            SELECT item_id, words, unnest(range(greatest(len(words) - 4, 1))) AS p,
                len(words) AS n FROM items WHERE len(words) > 0
        ), item_seeds AS (
            SELECT item_id, n, p, least(n, 5) AS k, array_to_string(words[p + 1 : p + 5], ' ') AS s
            FROM item_runs
        ), widths AS (SELECT DISTINCT k FROM item_seeds
        ), text_runs AS (
            SELECT doc_id, k, words, unnest(range(greatest(len(words) - k + 1, 0))) AS q
            FROM bare, widths
        ), met AS (
            SELECT DISTINCT doc_id, item_id, n, words, q
            FROM text_runs t JOIN (SELECT DISTINCT item_id, n, k, s FROM item_seeds) i
                ON t.k = i.k AND array_to_string(words[q + 1 : q + t.k], ' ') = i.s
        ), hits AS (
            SELECT DISTINCT doc_id, item_id, n, words,
                greatest(0, least(unnest(range(q - greatest(n - 4, 1) + 1, q + 1)), len(words) - n)) AS start
            FROM met
        ), windows AS (
            SELECT row_number() OVER () AS win, doc_id, item_id, start, words[start + 1 : start + n] AS w
            FROM hits
        ), window_counts AS (
            SELECT win, item_id, s, count(*) AS c FROM (
                SELECT win, item_id, array_to_string(w[g + 1 : g + 5], ' ') AS s
                FROM (SELECT win, item_id, w, unnest(range(greatest(len(w) - 4, 1))) AS g FROM windows)
            ) GROUP BY ALL
        ), item_counts AS (SELECT item_id, s, count(*) AS c FROM item_seeds GROUP BY ALL
        ), scored AS (
            SELECT a.win, sum(least(a.c, coalesce(b.c, 0))) AS common, sum(a.c) AS total,
                any_value(a.item_id) AS item_id
            FROM window_counts a LEFT JOIN item_counts b USING (item_id, s) GROUP BY a.win
        ), rated AS (
            SELECT doc_id, item_id, start, len(w) AS n_words,
                common::DOUBLE / (total + size - common)::DOUBLE AS similarity
            FROM scored JOIN windows USING (win, item_id)
            JOIN (SELECT item_id, sum(c) AS size FROM item_counts GROUP BY item_id) USING (item_id)
        )
        SELECT doc_id, item_id, similarity, start, n_words FROM rated WHERE similarity >= 0.8
        QUALIFY row_number() OVER (PARTITION BY doc_id, item_id ORDER BY similarity DESC, start) = 1
    """,
    "op11_hard_negatives": r"""
        WITH vectors AS (
            SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
                list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q
            FROM embeddings
            WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), scored AS (
            SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
                list_inner_product(a.q, b.q)::BIGINT AS score
            FROM vectors a JOIN vectors b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
        ), positives AS (
            SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scored WHERE same
            QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
        ), ranked AS (
            SELECT anchor_id, positive_id, other_id AS negative_id, positive_score,
                score AS negative_score, row_number() OVER (
                    PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) AS place
            FROM positives JOIN scored USING (anchor_id)
            WHERE NOT same AND 80 * positive_score <= 100 * score AND score <= positive_score
        )
        SELECT anchor_id, positive_id, place::INTEGER AS rank, negative_id, positive_score, negative_score
        FROM ranked WHERE place <= 5
    """,
    "op13_filter_audit": r"""
        WITH counted AS (
            SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
                regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
            FROM documents
        ), marked AS (
            SELECT doc_id, part,
                (len(words) < 50)::INT
                + 2 * (100 * len(list_distinct(words)) < 65 * len(words))::INT
                + 4 * (100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 5 * length(body))::INT
                + 8 * regexp_matches(body, '[#$%&*|]')::INT
                + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY body), FALSE)::INT AS mask
            FROM counted
        ), wanted AS (
            SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY 1
        ), cells AS (
            SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS good,
                count(*) FILTER (toxic) AS toxic
            FROM marked LEFT JOIN wanted USING (doc_id) GROUP BY part, mask
        ), letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x
        ), orders AS (
            SELECT a.x || b.x || c.x || d.x || e.x AS filter_order
            FROM letters a, letters b, letters c, letters d, letters e
            WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5
        ), steps AS (
            SELECT filter_order, unnest(range(1, 6))::INTEGER AS step FROM orders
        ), masks AS (
            SELECT filter_order, step, 1 << (ascii(filter_order[step]) - 65) AS own,
                list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65)))
                    AS before
            FROM steps
        ), made AS (
            SELECT part, filter_order, step,
                sum(CASE WHEN mask & (own | coalesce(before, 0)::BIGINT) = 0 THEN n ELSE 0 END) AS kept,
                sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN n ELSE 0 END)
                    AS removed,
                sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0)::BIGINT > 0 THEN n ELSE 0 END)
                    AS redundant,
                sum(CASE WHEN mask = own THEN n ELSE 0 END) AS unique_fails,
                sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN good ELSE 0 END)
                    AS good_lost,
                sum(CASE WHEN mask & own > 0 AND mask & coalesce(before, 0)::BIGINT = 0 THEN toxic ELSE 0 END)
                    AS toxic_lost
            FROM cells, masks GROUP BY ALL
        )
        SELECT part, filter_order, step, kept::BIGINT AS kept, removed::BIGINT AS removed,
            redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
            good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost,
            sum(removed) OVER (PARTITION BY part, filter_order[step])::BIGINT AS shapley
        FROM made
    """,
}
