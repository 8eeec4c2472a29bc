"""Manifests of pages to fetch: dedupe, checks, even and budgeted samples."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.operators.topk import first_by, top_k


def dedupe(refs: DataFrame) -> DataFrame:
    """The first reference per doc_id by `ord`."""
    return first_by(refs, ["doc_id"], "ord")


def unknown_values(wanted: DataFrame, allowed: DataFrame, column: str) -> DataFrame:
    """Distinct wanted values that are not allowed; empty when the manifest is valid."""
    return wanted.select(column).distinct().join(
        allowed.select(column).distinct(), column, "left_anti"
    )


def require_known(wanted: DataFrame, allowed: DataFrame, column: str, source: str) -> None:
    found = unknown_values(wanted, allowed, column).orderBy(column).limit(20).collect()
    if found:
        raise ValueError(f"Unknown categories for {source}: {', '.join(r[0] for r in found)}")


def without_titles(refs: DataFrame, prefixes: list[str]) -> DataFrame:
    """Drop references whose title is empty or starts with one of the prefixes."""
    return refs.filter(
        F.col("title").isNotNull() & (F.col("title") != "")
        & ~tx.starts_with_any(tx.fold(F.col("title")), prefixes)
    )


def cap_per_category(refs: DataFrame, limit: int) -> DataFrame:
    return top_k(refs, ["category"], [F.asc("ord")], limit, "__rank").drop("__rank")


def _all_fit(refs: DataFrame, max_documents: int) -> bool:
    return refs.select("ord").limit(max_documents + 1).count() <= max_documents


def _in_order(refs: DataFrame) -> DataFrame:
    order = Window.partitionBy(F.lit(1)).orderBy("ord")
    return refs.withColumn("position", F.row_number().over(order))


def take_evenly(refs: DataFrame, max_documents: int) -> DataFrame:
    """Round robin over the content types in first-seen order, with the `position` taken.

    At most `max_documents` rows per type take part, so the ordered step is small. If all rows fit,
    they stay in `ord` order.
    """
    if _all_fit(refs, max_documents):
        return _in_order(refs)
    first = refs.groupBy("content_type").agg(F.min("ord").alias("__first"))
    ranked = top_k(refs, ["content_type"], [F.asc("ord")], max_documents, "__round")
    chosen = (
        ranked.join(first, "content_type")
        .orderBy("__round", "__first")
        .limit(max_documents)
    )
    order = Window.partitionBy(F.lit(1)).orderBy("__round", "__first")
    return chosen.withColumn("position", F.row_number().over(order)).drop("__round", "__first")


def allocate(refs: DataFrame, budgets: DataFrame, max_documents: int) -> DataFrame:
    """content_type, type_ord and how many references it may give.

    `budgets` has type_ord, content_type, budget. Shares are cut to whole numbers of at least one,
    capped by what there is; what is missing goes to the largest remainders with rows left.
    """
    every = Window.partitionBy(F.lit(1))
    available = refs.groupBy("content_type").agg(F.count(F.lit(1)).alias("available"))
    exact = F.lit(max_documents) * F.col("budget") / F.sum("budget").over(every)
    shares = (
        budgets.join(available, "content_type", "left")
        .withColumn("available", F.coalesce("available", F.lit(0)))
        .withColumn("exact", exact)
        .withColumn(
            "base", F.least(F.greatest(F.lit(1), F.floor("exact")), F.col("available"))
        )
        .withColumn("spare", F.col("base") < F.col("available"))
        .withColumn("missing", F.lit(max_documents) - F.sum("base").over(every))
    )
    remainder = Window.partitionBy("spare").orderBy(
        F.desc(F.col("exact") - F.floor("exact")), F.desc("content_type")
    )
    extra = F.col("spare") & (F.row_number().over(remainder) <= F.col("missing"))
    return shares.withColumn("allocation", F.col("base") + extra.cast("int")).select(
        "content_type", "type_ord", "allocation"
    )


def take_budgeted(refs: DataFrame, budgets: DataFrame, max_documents: int) -> DataFrame:
    """Budgeted sample in category order, filled up from the rest in `ord` order.

    If all rows fit, they stay in `ord` order.
    """
    if _all_fit(refs, max_documents):
        return _in_order(refs)
    shares = allocate(refs, budgets, max_documents)
    ranked = top_k(refs, ["content_type"], [F.asc("ord")], max_documents, "__rank")
    chosen = (
        ranked.join(F.broadcast(shares), "content_type")
        .filter(F.col("__rank") <= F.col("allocation"))
        .select(*refs.columns, F.lit(0).alias("__phase"), "type_ord", "__rank")
        .orderBy("type_ord", "__rank")
        .limit(max_documents)
    )
    rest = (
        refs.join(F.broadcast(chosen.select("doc_id")), "doc_id", "left_anti")
        .select(*refs.columns)
        .orderBy("ord")
        .limit(max_documents)
        .select(
            *refs.columns, F.lit(1).alias("__phase"), F.lit(0).alias("type_ord"),
            F.col("ord").cast("int").alias("__rank"),
        )
    )
    order = Window.partitionBy(F.lit(1)).orderBy("__phase", "type_ord", "__rank", "ord")
    return (
        chosen.unionByName(rest)
        .withColumn("position", F.row_number().over(order))
        .filter(F.col("position") <= max_documents)
        .drop("__phase", "type_ord", "__rank")
    )


def seed_refs(
    pages: DataFrame, source_id: str, base_url: str, budgets: dict[str, int] | None = None,
    quote: bool = False,
) -> DataFrame:
    """Seed pages (ord, category, content_type, page) to references.

    With budgets, each category gives its first pages only. Page names have underscores for
    spaces and %27 for an apostrophe.
    """
    if budgets is not None:
        allowed = F.create_map(*[F.lit(x) for pair in budgets.items() for x in pair])
        pages = top_k(
            pages.filter(F.col("category").isin(list(budgets))),
            ["category"], [F.asc("ord")], max(budgets.values()), "__rank",
        ).filter(F.col("__rank") <= allowed[F.col("category")])
    title = F.replace(F.replace("page", F.lit("_"), F.lit(" ")), F.lit("%27"), F.lit("'"))
    target = tx.url_quote(F.col("page"), keep_colon=True) if quote else F.col("page")
    return pages.select(
        "ord",
        F.concat(F.lit(source_id + ":"), F.col("page")).alias("doc_id"),
        F.concat(F.lit(base_url), target).alias("source_url"),
        title.alias("title"),
        "content_type",
    )


def title_refs(
    titles: DataFrame, source_id: str, base_url: str, keep_colon: bool = False
) -> DataFrame:
    """Discovered titles (ord, title, content_type) to references."""
    page = F.replace("title", F.lit(" "), F.lit("_"))
    return titles.select(
        "ord",
        F.concat(F.lit(source_id + ":"), page).alias("doc_id"),
        F.concat(F.lit(base_url), tx.url_quote(page, keep_colon)).alias("source_url"),
        "title",
        "content_type",
    )


def first_title_refs(
    titles: DataFrame, source_id: str, base_url: str, keep_colon: bool = False
) -> DataFrame:
    """`dedupe` of `title_refs`; only one string per row is shuffled, the others are derived after it."""
    own = F.when(F.contains("title", F.lit("_")), F.col("title"))  # else the page tells the title
    thin = titles.select(
        "ord", F.replace("title", F.lit(" "), F.lit("_")).alias("__page"), own.alias("__own"), "content_type"
    )
    spaced = F.replace("__page", F.lit("_"), F.lit(" "))
    first = first_by(thin, ["__page"], "ord").withColumn("title", F.coalesce("__own", spaced))
    return title_refs(first, source_id, base_url, keep_colon).select(
        "doc_id", "ord", "source_url", "title", "content_type"
    )


def thread_refs(urls: DataFrame, source_id: str, marker: str) -> DataFrame:
    """Thread URLs (ord, url) to references; a URL without the marker is an error."""
    checked = F.when(F.contains("url", F.lit(marker)), F.col("url")).otherwise(
        F.raise_error(F.concat(F.lit(f"URL is not from {marker}: "), F.col("url")))
    )
    slugged = urls.withColumn("url", checked).withColumn("__slug", tx.thread_slug(F.col("url")))
    return slugged.select(
        "ord",
        F.concat(F.lit(source_id + ":"), F.col("__slug")).alias("doc_id"),
        F.col("url").alias("source_url"),
        F.trim(F.replace("__slug", F.lit("_"), F.lit(" "))).alias("title"),
        F.when(F.contains("__slug", F.lit("patch")), "patch_note")
        .otherwise("community_tip")
        .alias("content_type"),
    )
