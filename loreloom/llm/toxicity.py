"""Toxic texts by multiple-instance learning.

A text is a bag of sentences. A logistic model scores each sentence by its words, and the text is
toxic if any sentence is: its score is the noisy-or, 1 - product of (1 - sentence score). Only labels
of whole texts are known; the gradient of the noisy-or finds the sentences they are due to.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loreloom.llm.common import groups_of_rows, numbered
from loreloom.llm.hashing import LOWER, U, joined, mix, prefix_sums, run_hash
from loreloom.session import materialise

PER_CLASS = 4_000
WORDS = 2_000
LEAST_TEXTS = 4
ROUNDS = 400
STEP = 0.1
SHRINK = 2e-5
FOLDS = 5
STEMS = (5, 6, 7)

LETTER = np.zeros(256, dtype=bool)
LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
FULL_STOP = np.zeros(256, dtype=bool)
FULL_STOP[[ord(c) for c in ".!?\n"]] = True


def sentence_words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of words and word beginnings, the sentence each is in, and the text of each sentence.

    Words are runs of letters in lower case. Beginnings of STEMS bytes stand for inflected forms.
    """
    raw, starts = joined(texts)
    letter = LETTER[raw]
    edge = np.flatnonzero(np.diff(np.r_[False, letter, False].astype(np.int8)))
    first, last = edge[::2], edge[1::2]
    if not len(first):
        none = np.zeros(0, dtype=np.int64)
        return none.view(U), none, none
    stops = np.cumsum(FULL_STOP[raw])[first]
    doc = np.searchsorted(starts, first, side="right") - 1
    fresh = np.r_[True, (stops[1:] != stops[:-1]) | (doc[1:] != doc[:-1])]
    sums = prefix_sums(LOWER[raw].astype(U) + U(1))
    sentence = np.cumsum(fresh) - 1
    size = last - first
    hashes, where = [mix(run_hash(sums, first, last) + size.astype(U))], [sentence]
    for stem in STEMS:
        long = size > stem
        hashes.append(mix(run_hash(sums, first[long], first[long] + stem) + U(1 << 32)))
        where.append(sentence[long])
    where = np.concatenate(where)
    order = np.argsort(where, kind="stable")
    return np.concatenate(hashes)[order], where[order], doc[fresh]


@dataclass(frozen=True)
class Model:
    """Known words (sorted hashes), their weights, the weight of a sentence as such."""

    words: np.ndarray
    weights: np.ndarray
    bias: float

    def sentences(self, hashes: np.ndarray, sentence: np.ndarray, count: int) -> np.ndarray:
        """The score of each sentence. A word counts once for each time it stands there."""
        logit = np.full(count, self.bias)
        if len(self.words) and len(hashes):
            at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
            weight = np.where(self.words[at] == hashes, self.weights[at], 0.0)
            logit = logit + np.bincount(sentence, weight, minlength=count)
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def noisy_or(scores: np.ndarray, owner: np.ndarray, count: int) -> np.ndarray:
    """1 - product of (1 - score) over the sentences of each text; 0 without sentences."""
    return -np.expm1(np.bincount(owner, np.log1p(-np.minimum(scores, 1 - 1e-12)), minlength=count))


@dataclass(frozen=True)
class Bags:
    """Training texts: how many sentences each has; each known word, and in which sentence of all."""

    sentences: np.ndarray
    word: np.ndarray
    sentence: np.ndarray
    toxic: np.ndarray
    weight: np.ndarray


def fit(words: np.ndarray, bags: Bags) -> Model:
    """The weights of the known words and of a sentence as such, by descent on the log loss of texts."""
    count = len(bags.toxic)
    if not count or bags.toxic.min() == bags.toxic.max():
        only = bool(count) and bags.toxic[0] == 1
        return Model(np.zeros(0, U), np.zeros(0), 30.0 if only else -30.0)
    owner = np.repeat(np.arange(count), bags.sentences)
    weight = bags.weight / bags.weight.sum()
    weights, bias = np.zeros(len(words)), -4.0
    moments = np.zeros((2, len(words) + 1))
    for step in range(1, ROUNDS + 1):
        logit = bias + np.bincount(bags.sentence, weights[bags.word], minlength=len(owner))
        score = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        whole = np.clip(noisy_or(score, owner, count), 1e-9, 1 - 1e-9)
        # d loss / d logit of a sentence: its score if the text is clean, else less by its share.
        slope = np.where(bags.toxic == 1, -(1 - whole) / whole, 1.0) * weight
        slope = slope[owner] * score
        by_word = np.bincount(bags.word, slope[bags.sentence], minlength=len(words))
        grad = np.r_[by_word, slope.sum()]
        moments[0] = 0.9 * moments[0] + 0.1 * grad
        moments[1] = 0.99 * moments[1] + 0.01 * grad**2
        size = STEP / (np.sqrt(moments[1] / (1 - 0.99**step)) + 1e-8)
        move = size * moments[0] / (1 - 0.9**step)
        weights -= move[:-1]
        weights = np.sign(weights) * np.maximum(np.abs(weights) - size[:-1] * SHRINK, 0)
        bias -= move[-1]
    return Model(words, weights, float(bias))


def labelled_sample(docs: DataFrame, labels: DataFrame, per_class: int) -> tuple[DataFrame, dict]:
    """(doc_id, toxic, text) of a bounded sample of the labelled texts outside the held-out fold.

    At most `per_class` texts of each label are taken, those of the smallest hash of their id; also
    returned is how many there are of each. A doc_id labelled more than once counts as toxic if any
    label says so.
    """
    known = (
        labels.filter("doc_id IS NOT NULL AND toxic IN (0, 1)").groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
        .filter(f"crc32(cast(doc_id AS string)) % {FOLDS} != 0")
    )
    totals = {r["toxic"]: r["count"] for r in known.groupBy("toxic").count().collect()}
    part = lambda k: (
        known.filter(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class)
    )
    # The sample has at most 2 * per_class rows of two numbers: small enough to broadcast.
    sample = F.broadcast(part(0).unionByName(part(1)))
    return materialise(docs.join(sample, "doc_id").select("doc_id", "toxic", "text")), totals


def telling_words(sample: DataFrame, words: int = WORDS) -> np.ndarray:
    """The words whose share of toxic and of clean texts differs most, against chance; sorted."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups_of_rows(batches, "text"):
            toxic = batch.column(0).to_numpy()
            hashes, sentence, owner = sentence_words(texts)
            doc = owner[sentence] if len(hashes) else sentence
            order = np.lexsort((hashes, doc))
            hashes, doc = hashes[order], doc[order]
            once = np.r_[True, (hashes[1:] != hashes[:-1]) | (doc[1:] != doc[:-1])][: len(doc)]
            found, which = np.unique(hashes[once], return_inverse=True)
            seen = np.bincount(which, minlength=len(found))
            bad = np.bincount(which, toxic[doc[once]], minlength=len(found)).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [pa.array(found.view(np.int64)), pa.array(bad), pa.array(seen - bad)], ["h", "bad", "good"]
            )

    sizes = sample.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.count(F.lit(1))).first()
    bad, good = float(sizes[0]), float(sizes[1] - sizes[0])
    share = lambda c, n: (F.col(c) + 0.5) / (n + 1)
    both = share("bad", bad) + share("good", good)
    gap = F.abs(share("bad", bad) - share("good", good)) / F.sqrt(both)
    counted = (
        sample.select("toxic", "text").mapInArrow(run, "h long, bad long, good long")
        .groupBy("h").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter(F.col("bad") + F.col("good") >= LEAST_TEXTS)
    )
    top = counted.orderBy(gap.desc(), "h").limit(words).select("h").toArrow()
    return np.sort(top["h"].to_numpy().astype(np.int64).view(U))


def training_bags(sample: DataFrame, totals: dict, words: np.ndarray) -> Bags:
    """The sample in terms of the known words, with weights that make up for what is left out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups_of_rows(batches, "text"):
            hashes, sentence, owner = sentence_words(texts)
            at = np.minimum(np.searchsorted(words, hashes), max(len(words) - 1, 0))
            known = words[at] == hashes if len(words) else np.zeros(len(hashes), dtype=bool)
            at, sentence = at[known], sentence[known]
            doc = owner[sentence]
            heads = np.searchsorted(owner, np.arange(len(texts)))
            edge = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
            lists = lambda v: pa.ListArray.from_arrays(pa.array(edge), pa.array(v.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0), batch.column(1),
                    pa.array(np.bincount(owner, minlength=len(texts)).astype(np.int32)),
                    lists(at), lists(sentence - heads[doc]),
                ],
                ["doc_id", "toxic", "sentences", "word", "sentence"],
            )

    kind = sample.schema["doc_id"].dataType.simpleString()
    table = sample.mapInArrow(
        run, f"doc_id {kind}, toxic int, sentences int, word array<int>, sentence array<int>"
    ).toArrow().sort_by([("doc_id", "ascending"), ("sentences", "ascending")]).combine_chunks()
    toxic = table["toxic"].to_numpy().astype(float)
    sentences = table["sentences"].to_numpy().astype(np.int64)
    per_text = table["word"].combine_chunks().value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    flat = lambda c: table[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.int64)
    before = np.repeat(np.cumsum(sentences) - sentences, per_text)
    share = {k: totals.get(k, 0) / max((toxic == k).sum(), 1) for k in (0, 1)}
    weight = np.where(toxic == 1, share[1], share[0])
    return Bags(sentences, flat("word"), flat("sentence") + before, toxic, weight)


def train(docs: DataFrame, labels: DataFrame, per_class: int = PER_CLASS) -> Model:
    """A model of `labels` (doc_id, toxic) over `docs` (doc_id, text)."""
    sample, totals = labelled_sample(docs, labels, per_class)
    words = telling_words(sample)
    return fit(words, training_bags(sample, totals, words))


def score_texts(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id",
    worst: bool = True,
) -> DataFrame:
    """All columns of `docs` with score (0 to 1), predicted (1 from 0.5 on) and the worst sentence.

    `worst_sentence` is the number of the sentence of the highest score, from 0, the first of equals,
    and `worst_score` its score; both null without words. A null or empty text scores 0; every row
    gives one row, repeated ones too; an empty table gives an empty table. Without labels of both
    kinds every text gets the same score. New columns replace those of the same name.
    """
    added = ["score", "predicted", "worst_sentence", "worst_score"][: 4 if worst else 2]
    kinds = ["double", "integer", "integer", "double"]
    spark = docs.sparkSession
    sample = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    model = spark.sparkContext.broadcast(train(sample, labels))
    names = [c for c in docs.columns if c not in added]
    schema = T.StructType([docs.schema[c] for c in names])
    for name, kind in zip(added, kinds[: len(added)], strict=True):
        schema = schema.add(name, kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in groups_of_rows(batches, text):
            hashes, sentence, owner = sentence_words(texts)
            scores = model.value.sentences(hashes, sentence, len(owner))
            whole = noisy_or(scores, owner, len(texts))
            columns = [*batch.columns, pa.array(whole), pa.array((whole >= 0.5).astype(np.int32))]
            if worst:
                order = np.lexsort((np.arange(len(owner)), -scores, owner))
                heads = np.searchsorted(owner, np.arange(len(texts)))
                lead = np.r_[True, owner[order][1:] != owner[order][:-1]][: len(order)]
                top = order[lead]
                number, best = np.zeros(len(texts), np.int32), np.zeros(len(texts))
                number[owner[top]] = top - heads[owner[top]]
                best[owner[top]] = scores[top]
                empty = np.bincount(owner, minlength=len(texts)) == 0
                columns += [pa.array(number, mask=empty), pa.array(best, mask=empty)]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, *added])

    return docs.select(*[F.col(f"`{c}`") for c in names]).mapInArrow(run, schema)


def held_out(doc_id: str = "doc_id"):
    """Whether a row belongs to the fold whose labels are never learnt."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % FOLDS == 0, F.lit(False))


def drop_toxic(
    docs: DataFrame, labels: DataFrame, text: str = "text", doc_id: str = "doc_id"
) -> DataFrame:
    """The rows of `docs` whose score is below 0.5, with their columns."""
    shell, names, at = numbered(docs)
    scored = score_texts(shell, labels, at[text], at[doc_id], worst=False)
    return scored.filter("predicted = 0").drop("score", "predicted").toDF(*names)
