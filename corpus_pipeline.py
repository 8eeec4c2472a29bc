"""A training corpus from `documents`: filtered, without copies and benchmark texts, as token ids.

Each stage takes what the one before kept, as written and read again, and its decisions take effect.
A stage keeps the columns of `documents`; the last adds the tokens. The pipeline has no SQL twin, as
neither the trained model nor the merges can be put in SQL; tests hold it against plain Python.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loreloom.llm.bpe import encode_texts
from loreloom.llm.common import numbered
from loreloom.llm.decontaminate import drop_contaminated
from loreloom.llm.exact import drop_copies
from loreloom.llm.jaccard import drop_near_duplicates
from loreloom.llm.queries import table, vocabulary_path
from loreloom.llm.toxicity import drop_toxic
from loreloom.session import materialise


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with a score below 0.5."""
    return drop_toxic(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))


def exact_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, white space aside."""
    return drop_copies(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group linked by a similarity of 0.8 of five-word shingles."""
    return drop_near_duplicates(docs, width=5, percent=80)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts that hold no benchmark item."""
    return drop_contaminated(docs, table(spark, sf_dir, "benchmark").select("item_id", "text"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The columns of `docs` with token_ids, n_tokens, and the digest of what the ids decode to."""
    shell, names, at = numbered(docs)
    made = encode_texts(shell, vocabulary_path(), at["text"])
    columns = {n: F.col(c) for n, c in at.items()} | {
        "token_ids": F.col("ids"),
        "n_tokens": F.size("ids").cast("long"),
        "decoded_sha256": F.sha2("decoded", 256),
    }
    return made.select(*[c.alias(n) for n, c in columns.items()])


STAGES = [
    ("toxicity", toxicity),
    ("exact_dedup", exact_dedup),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("tokens", tokens),
]

ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of `documents` that stay, with their columns, token_ids, n_tokens and decoded_sha256.

    A null text counts as empty: it is not toxic, one of all empty texts stays as their exact copy, it
    has no near duplicate and no benchmark item, and its ids are an empty list. Of repeated rows one
    stays. Rows without an id are kept like others. Columns that `documents` has beside its own come
    along; those that are called like the new ones are replaced. An empty table gives an empty table.
    """
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
