"""Landed responses: page listings and forum threads as JSON text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loreloom.functions import fixed
from loreloom.functions import text as tx
from loreloom.operators.manifests import cap_per_category, first_title_refs, without_titles

CATEGORY_LISTING = "query struct<categorymembers: array<struct<title: string>>>"
PAGE_LISTING = (
    "query struct<pages: array<struct<title: string, "
    "categories: array<struct<title: string>>>>>"
)
THREAD = (
    "array<struct<data: struct<children: array<struct<kind: string, data: struct<"
    "title: string, author: string, selftext: string, body: string, permalink: string, "
    "score: bigint>>>>>>"
)


def category_refs(
    listings: DataFrame, source_id: str, base_url: str,
    per_category: int | None = None,
) -> DataFrame:
    """Category listings (ord, category, content_type, payload) to references.

    `ord` numbers the responses; a title's place is its response, then its place in it.
    """
    members = F.from_json("payload", CATEGORY_LISTING)["query"]["categorymembers"]
    rows = tx.explode_once(listings, members, "member", "pos").select(
        F.struct("ord", "pos").alias("ord"), "category", "content_type",
        F.col("member.title").alias("title"),
    )
    kept = without_titles(rows, fixed.WIKI_A_SKIP_PREFIXES)
    if per_category is not None:
        kept = cap_per_category(kept, per_category)
    return first_title_refs(kept, source_id, base_url)


def page_refs(listings: DataFrame, source_id: str, base_url: str) -> DataFrame:
    """All-pages listings (ord, payload) to references; the type comes from title and categories."""
    pages = F.from_json("payload", PAGE_LISTING)["query"]["pages"]
    rows = tx.explode_once(listings, pages, "p", "pos").select(
        F.struct("ord", "pos").alias("ord"),
        F.col("p.title").alias("title"),
        F.array_join(F.col("p.categories.title"), " ").alias("categories"),
    )
    typed = without_titles(rows, fixed.WIKI_B_SKIP_PREFIXES).withColumn(
        "content_type",
        tx.content_type_of(F.col("title"), F.nullif("categories", F.lit(""))),
    )
    return first_title_refs(typed, source_id, base_url, keep_colon=True)


def thread_rows(
    landed: DataFrame, payload: str = "payload", max_comments: int = fixed.THREAD_MAX_COMMENTS
) -> DataFrame:
    """Add title, author, score, selftext, permalink and comments of a thread listing.

    Comments are kept in order; the cap counts what is left after the empty and removed ones.
    """
    def person(author: Column) -> Column:
        return F.coalesce(F.nullif(author, F.lit("")), F.lit("unknown"))

    parsed = landed.withColumn("__t", F.from_json(payload, THREAD))
    post = F.get(F.get("__t", F.lit(0))["data"]["children"], F.lit(0))["data"]
    post = F.when(post.isNotNull(), post).otherwise(
        F.raise_error(F.lit("thread listing did not include a post"))
    )
    children = F.coalesce(
        F.get("__t", F.lit(1))["data"]["children"],
        F.array().cast(
            "array<struct<kind: string, data: struct<title: string, author: string, "
            "selftext: string, body: string, permalink: string, score: bigint>>>"
        ),
    )
    cleaned = F.transform(
        F.filter(children, lambda c: c["kind"] == "t1"),
        lambda c: F.struct(
            person(c["data"]["author"]).alias("author"),
            F.coalesce(c["data"]["score"], F.lit(0)).alias("score"),
            tx.forum_text(c["data"]["body"]).alias("body"),
            F.coalesce(c["data"]["permalink"], F.lit("")).alias("permalink"),
        ),
    )
    kept = F.filter(cleaned, lambda c: ~c["body"].isin("", "[deleted]", "[removed]"))
    return (
        parsed.withColumn("__p", post)
        .withColumns(
            {
                "title": F.coalesce(F.col("__p.title"), F.lit("")),
                "author": person(F.col("__p.author")),
                "score": F.coalesce(F.col("__p.score"), F.lit(0)),
                "selftext": tx.forum_text(F.col("__p.selftext")),
                "permalink": F.coalesce(F.col("__p.permalink"), F.lit("")),
                "comments": F.slice(kept, 1, max_comments),
            }
        )
        .drop("__t", "__p")
    )
