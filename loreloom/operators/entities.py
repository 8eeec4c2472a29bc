"""Entity registry: build, list, exact lookup, mentions in text, fuzzy lookup.

Nothing here compares every text with every name. Mentions of long names meet the texts on a run of
their words, those of short names are found by one pass of each text over a trie. Substrings of looked-up values are found by equality: the registry gives the lengths
that follow each leading fragment, the value yields the substrings of exactly those lengths, and these
meet the names on the whole string. Fuzzy candidates share a whole
segment of the name (a string within d edits keeps one of d + 1 segments), a word, or contain
one another.
"""

from __future__ import annotations

import math

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from loreloom.functions import fixed
from loreloom.functions import text as tx
from loreloom.functions.fuzzy import weighted_ratio_of
from loreloom.operators.topk import first_by, top_k
from loreloom.session import join_small, materialise

HEAD = 4
STRETCH = 256
SHARD_CHARS = 2 << 20  # of the names that one trie holds
SLICE_BYTES = 4 << 20  # of the texts that meet a trie at once
RUN = 6  # words inside a name that it meets a text on
FAR = 8  # from this length ratio on, a partial match scores too little for any lookup
ENTITY_COLUMNS = [
    "game_id", "canonical_name", "normalized_name", "content_type", "source_url", "aliases",
]


def build_entities(chunks: DataFrame) -> DataFrame:
    """One entity per tenant and title, from its first chunk by `ord`."""
    first = first_by(
        chunks.select("game_id", "title", "content_type", "source_url", "ord"),
        ["game_id", "title"], "ord",
    )
    name = tx.entity_name(F.col("title"))
    return first.select(
        "game_id",
        F.col("title").alias("canonical_name"),
        name.alias("normalized_name"),
        "content_type", "source_url",
        F.array(name).alias("aliases"),
    )


def registry_order() -> Column:
    """Registry position inside a tenant."""
    return F.struct(
        tx.fold(F.col("canonical_name")).alias("folded"), F.col("canonical_name").alias("name")
    )


def list_entities(
    entities: DataFrame, game_id: str | None = None, content_type: str | None = None,
    limit: int | None = None,
) -> DataFrame:
    """Entities by case-folded name, numbered per tenant."""
    if game_id is not None:
        entities = entities.filter(F.col("game_id") == game_id)
    if content_type is not None:
        entities = entities.filter(F.col("content_type") == content_type)
    if limit is None:
        return entities.orderBy("game_id", tx.fold(F.col("canonical_name")), "canonical_name")
    order = [tx.fold(F.col("canonical_name")).asc(), F.asc("canonical_name")]
    return top_k(entities, ["game_id"], order, limit, "position")


def names_of(entities: DataFrame) -> DataFrame:
    """Each entity once per distinct normalised name."""
    names = F.array_distinct(
        F.concat(
            F.array(F.col("normalized_name"), tx.entity_name(F.col("canonical_name"))),
            F.transform("aliases", tx.entity_name),
        )
    )
    return (
        entities.withColumn("order", registry_order())
        .withColumn("name", F.explode(names))
        .filter(F.col("name") != "")
    )


def exact_lookup(entities: DataFrame, lookups: DataFrame) -> DataFrame:
    """lookup columns + the first entity whose name or alias equals the normalised `name`."""
    named = names_of(entities).select(
        "game_id", F.col("name").alias("__key"), "order", "canonical_name", "content_type",
        "source_url",
    )
    first = first_by(named, ["game_id", "__key"], "order").drop("order")
    keyed = lookups.withColumn("__key", tx.entity_name(F.col("name")))
    return join_small(keyed, first, ["game_id", "__key"], "left").drop("__key")


def _fragments(needles: DataFrame, name: str) -> DataFrame:
    """Tenant, leading fragment and length of the needles."""
    return needles.select(
        "game_id", F.substring(name, 1, HEAD).alias("head"), F.length(name).alias("size")
    ).distinct()


def substrings_like(haystacks: DataFrame, text: str, needles: DataFrame, name: str) -> DataFrame:
    """Haystack rows with `found`, a substring as long as a needle with the same head, and `at`.

    The haystack column itself is replaced by these substrings.
    """
    fragments = materialise(_fragments(needles, name))
    longest, shapes = fragments.agg(
        F.max("size"), F.collect_set(F.length("head"))
    ).first()
    keep = [c for c in haystacks.columns if c != text]
    if not longest:
        return haystacks.limit(0).select(
            *keep, F.lit(0).alias("at"), F.col(text).alias("found")
        )
    # Reaching a position in a string means walking to it; stretches keep these walks short.
    stretches = F.transform(
        F.sequence(F.lit(0), F.length(F.col(text)) - 1, F.lit(STRETCH)),
        lambda s: F.struct(
            s.alias("skip"),
            F.substring(F.col(text), s + 1, F.lit(STRETCH + longest)).alias("part"),
        ),
    )
    rows = tx.explode_once(haystacks.filter(F.col(text) != ""), stretches, "__s").select(
        *keep, "__s.skip", "__s.part"
    )
    starts = F.transform(
        F.sequence(F.lit(1), F.least(F.lit(STRETCH), F.length("part"))),
        lambda p: F.struct(
            (F.col("skip") + p).alias("at"),
            F.substring(F.col("part"), p, F.lit(longest)).alias("rest"),
        ),
    )
    windows = tx.explode_once(rows, starts, "__w").select(*keep, "__w.at", "__w.rest")
    heads = F.array(*[F.substring("rest", 1, n) for n in sorted(shapes)])
    windows = tx.explode_once(windows, heads, "head")
    met = join_small(windows, fragments, ["game_id", "head"])
    whole = (F.length("rest") >= F.col("size")) & (
        F.length("head") == F.least(F.col("size"), F.lit(HEAD))
    )
    return met.filter(whole).select(
        *keep, "at", F.expr("substring(rest, 1, size)").alias("found")
    )


def _name_cells(normal: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Texts and names dealt to cells (game_id, shard, slice) of bounded size.

    The names of a tenant are cut into shards of about SHARD_CHARS characters, its texts into slices
    of about SLICE_BYTES bytes; every shard meets every slice of its tenant in one cell, so neither a
    tenant with most of the texts nor one with most of the names is one task.
    """
    shards = names.groupBy("game_id").agg(
        F.ceil(F.sum(F.length("found") + 1) / SHARD_CHARS).cast("int").alias("__shards")
    )
    slices = normal.groupBy("game_id").agg(
        F.ceil(F.sum(F.octet_length("text") + 64) / SLICE_BYTES).cast("int").alias("__slices")
    )
    grid = materialise(shards.join(slices, "game_id"))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    own = lambda c, n: F.pmod(F.xxhash64(c), F.col(n)).cast("int")
    texts = (
        join_small(normal, grid, ["game_id"])
        .withColumn("slice", own("text_id", "__slices")).withColumn("shard", every("__shards"))
        .select("game_id", "shard", "slice", "text_id", "text")
    )
    patterns = (
        join_small(names.select("game_id", "found").distinct(), grid, ["game_id"])
        .withColumn("shard", own("found", "__shards")).withColumn("slice", every("__slices"))
        .select("game_id", "shard", "slice", "found")
    )
    return texts, patterns


def first_places(texts: DataFrame, patterns: DataFrame) -> DataFrame:
    """text_id, game_id, found and the first position (from 1) of each name in each text.

    One pass over a text finds all names of the cell: a trie of the names with failure links, built
    once per cell. Only hits leave a cell, as positions.
    """
    kind = texts.schema["text_id"].dataType.simpleString()
    fields = texts.select("text_id").schema

    def search(table: pa.Table, words: pa.Table) -> pa.Table:
        ids, names, places = [], [], []
        if table.num_rows and words.num_rows:
            trie = ahocorasick.Automaton()
            for word in words.column("found").to_pylist():
                trie.add_word(word, word)
            trie.make_automaton()
            for text_id, text in zip(
                table.column("text_id").to_pylist(), table.column("text").to_pylist(), strict=True
            ):
                first: dict[str, int] = {}
                for end, word in trie.iter(text):
                    first.setdefault(word, end)
                ids += [text_id] * len(first)
                names += first
                places += [end - len(word) + 2 for word, end in first.items()]
        games = table if table.num_rows else words
        game = games.column("game_id")[0].as_py() if games.num_rows else None
        return pa.table({
            "text_id": pa.array(ids, to_arrow_schema(fields).field(0).type),
            "game_id": pa.array([game] * len(ids), pa.string()),
            "found": pa.array(names, pa.string()), "position": pa.array(places, pa.int32()),
        })

    by = ["game_id", "shard", "slice"]
    return texts.groupBy(*by).cogroup(patterns.groupBy(*by)).applyInArrow(
        search, f"text_id {kind}, game_id string, found string, position int"
    )


def places_of_long(normal: DataFrame, names: DataFrame) -> DataFrame:
    """text_id, game_id, found and the first position (from 1) of each name of RUN + 2 words or more.

    In a text that holds such a name, all of its words but the first and the last stand alone and in
    a row. Names and texts meet on the first RUN of these by equality, then the whole name is
    looked for. `normal` is written and has `place`, a number per text.
    """
    inner = F.slice(F.split("found", " "), 2, RUN)
    named = materialise(
        names.select("game_id", "found", F.xxhash64(inner).alias("key"), F.monotonically_increasing_id().alias("no"))
    )
    # Written out in one lambda, the words would be cut again for every run.
    runs = tx.let(
        F.split("text", " "),
        lambda w: F.array_distinct(
            F.transform(
                F.sequence(F.lit(2), F.greatest(F.lit(2), F.size(w) - RUN)),
                lambda i: F.xxhash64(F.slice(w, i, RUN)),
            )
        ),
    )
    asked = tx.explode_once(normal.select("game_id", "place", "text"), runs, "key").select("game_id", "place", "key")
    # Numbers meet, then the names that were met are joined, then the texts: no string is repeated per slice.
    met = materialise(join_small(asked, named.select("game_id", "key", "no"), ["game_id", "key"]).select("place", "no"))
    rows = normal.join(join_small(named.select("no", "found"), met, ["no"]), "place")
    at = F.instr("text", F.col("found"))
    return rows.select("text_id", "game_id", "found", at.alias("position")).filter("position > 0")


def mentions(
    entities: DataFrame, texts: DataFrame, content_type: str | None = None
) -> DataFrame:
    """text_id, game_id, canonical_name, content_type, source_url, position (1-based).

    A name counts wherever it is a substring of the normalised text.
    """
    if content_type is not None:
        entities = entities.filter(F.col("content_type") == content_type)
    names = materialise(names_of(entities).select(
        "game_id", F.col("name").alias("found"), "canonical_name", "content_type", "source_url"
    ))
    normal = materialise(
        texts.select("text_id", "game_id", tx.entity_name(F.col("text")).alias("text"))
        .filter(F.col("text") != "").withColumn("place", F.monotonically_increasing_id())
    )
    # Names of a few words are few; only they are searched in every text.
    long = F.size(F.split("found", " ")) >= RUN + 2
    distinct = names.select("game_id", "found").distinct()
    places = materialise(
        first_places(*_name_cells(normal, distinct.filter(~long))).unionByName(
            places_of_long(normal, distinct.filter(long))
        )
    )
    own = ["game_id", "found"]
    hit = materialise(names.join(places.select(*own).distinct(), own, "left_semi"))
    return (
        join_small(places, hit, own)
        .groupBy("text_id", "game_id", "canonical_name")
        .agg(
            F.min("position").alias("position"),
            F.min(F.struct("content_type", "source_url")).alias("__e"),
        )
        .select("text_id", "game_id", "canonical_name", "__e.*", "position")
    )


# ---- fuzzy -----------------------------------------------------------------


def _segments(length: Column, edits: Column) -> Column:
    """(number, start, size) of `edits + 1` nearly equal segments of a string."""
    count = edits + 1
    base = F.floor(length / count).cast("int")
    short = count - length % count  # the first `short` segments have the base size

    return F.transform(
        F.sequence(F.lit(0), edits),
        lambda i: F.struct(
            i.alias("no"),
            (i * base + F.greatest(F.lit(0), i - short)).alias("start"),
            (base + F.when(i >= short, 1).otherwise(0)).alias("size"),
        ),
    )


def _near_candidates(values: DataFrame, names: DataFrame, miss: float) -> DataFrame:
    """Pairs that can differ by at most `miss` of their joint length, in word order or sorted.

    For a name of length `size` and a value of length `other` that leaves `edits` insertions and
    deletions, one of `edits + 1` segments of the name occurs unchanged in the value, moved by no
    more than the deletions to the left or the insertions to the right.
    """
    reach = (1 + miss) / (1 - miss)  # largest length ratio

    def edits(size: Column, other: Column) -> Column:
        return F.floor((size + other) * miss + 1e-9).cast("int")

    def lengths(size: Column) -> Column:
        near = F.sequence(
            F.greatest(F.lit(1), F.floor(size / reach).cast("int")),
            F.ceil(size * reach).cast("int"),
        )
        return F.filter(near, lambda n: F.abs(n - size) <= edits(size, n))

    def forms(text: Column) -> Column:
        words = F.split(text, " ")
        return F.array_distinct(
            F.array(
                text,
                F.array_join(F.sort_array(words), " "),
                F.array_join(F.sort_array(F.array_distinct(words)), " "),
            )
        )

    def probes(text: Column, other: Column) -> Column:
        def of_size(size: Column) -> Column:
            return tx.let(
                edits(size, other),
                lambda d: F.flatten(
                    F.transform(_segments(size, d), lambda s: of_segment(size, d, s))
                ),
            )

        def of_segment(size: Column, d: Column, s: Column) -> Column:
            left = F.floor((d - (other - size)) / 2).cast("int")
            right = F.floor((d + (other - size)) / 2).cast("int")
            low = F.greatest(F.lit(0), s["start"] - left)
            high = F.least(other - s["size"], s["start"] + right)
            found = F.transform(
                F.sequence(low, F.greatest(low, high)),
                lambda p: F.struct(
                    size.alias("size"), s["no"].alias("no"),
                    F.substring(text, p + 1, s["size"]).alias("part"),
                ),
            )
            return F.when(low <= high, found).otherwise(
                F.array().cast("array<struct<size:int,no:int,part:string>>")
            )

        return F.array_distinct(F.flatten(F.transform(lengths(other), of_size)))

    indexed = names.select("game_id", "name", F.explode(forms(F.col("name"))).alias("text"))
    indexed = indexed.withColumn("size", F.length("text"))
    indexed = tx.explode_once(indexed, lengths(F.col("size")), "other")
    indexed = tx.explode_once(
        indexed, _segments(F.col("size"), edits(F.col("size"), F.col("other"))), "s"
    ).select(
        "game_id", "name", "size", "other", F.col("s.no").alias("no"),
        F.expr("substring(text, s.start + 1, s.size)").alias("part"),
    )
    asked = values.select("game_id", "value", F.explode(forms(F.col("value"))).alias("text"))
    asked = asked.withColumn("other", F.length("text"))
    asked = tx.explode_once(asked, probes(F.col("text"), F.col("other")), "p").select(
        "game_id", "value", "other", "p.size", "p.no", "p.part"
    )
    keys = ["game_id", "size", "other", "no", "part"]
    return join_small(asked, indexed, keys).select("game_id", "value", "name")


def _shared_word_candidates(values: DataFrame, names: DataFrame) -> DataFrame:
    """Pairs with a common word and a length ratio below 1.5."""
    left = names.select("game_id", "name", F.explode(F.split("name", " ")).alias("word"))
    right = values.select("game_id", "value", F.explode(F.split("value", " ")).alias("word"))
    longer = F.greatest(F.length("name"), F.length("value"))
    shorter = F.least(F.length("name"), F.length("value"))
    return (
        join_small(left, right, ["game_id", "word"])
        .filter(longer < shorter * 1.5)
        .select("game_id", "value", "name")
    )


def _inside(short: Column, long: Column) -> Column:
    ratio = F.length(long) / F.length(short)
    return (ratio >= 1.5) & (ratio <= 8.0)


def _long_needles(rows: DataFrame, column: str, miss: float) -> DataFrame:
    """Segments of strings long enough to score with edits inside; one must occur unchanged."""
    size = F.length(F.col(column))
    edits = F.floor(size * miss).cast("int")
    return (
        rows.select("game_id", column, size.alias("size"), edits.alias("edits"))
        .filter(F.col("edits") > 0)
        .withColumn("s", F.explode(_segments(F.col("size"), F.col("edits"))))
        .select(
            "game_id", column, F.expr(f"substring({column}, s.start + 1, s.size)").alias("found")
        )
    )


def fuzzy_lookup(
    entities: DataFrame, values: DataFrame, min_score: float = fixed.FUZZY_MIN_SCORE,
    cross_tenant: bool = False,
) -> DataFrame:
    """game_id, value, canonical_name, score for the distinct (game_id, value) that match.

    Exact names first; otherwise the best weighted ratio of at least `min_score`, ties by registry
    position. Stop terms and values under four characters match only exactly (stop terms never).
    With `cross_tenant` the tenant is ignored on both sides.
    """
    if min_score <= 100 * 0.855:
        raise ValueError("candidate search is complete for min_score above 85.5 only")
    tenant = F.lit("") if cross_tenant else F.col("game_id")
    wanted = (
        values.select("game_id", "value").distinct()
        .withColumn("tenant", tenant)
        .withColumn("key", tx.entity_name(F.col("value")))
        .filter((F.col("key") != "") & ~F.col("key").isin(fixed.NON_ENTITY_TERMS))
    )
    # Last writer owns a name; the position of a name is that of its first writer.
    order = F.struct(F.col("game_id"), F.col("order"))
    names = materialise(
        names_of(entities)
        .withColumn("o", order)
        .withColumn("tenant", tenant)
        .groupBy("tenant", "name")
        .agg(F.max_by("canonical_name", "o").alias("canonical_name"), F.min("o").alias("first"))
        .withColumnRenamed("tenant", "game_id")
    )
    keys = materialise(
        wanted.select(F.col("tenant").alias("game_id"), F.col("key").alias("value")).distinct()
    )
    exact = join_small(
        names.select("game_id", F.col("name").alias("value"), "canonical_name"), keys,
        ["game_id", "value"],
    ).withColumn("score", F.lit(100.0))
    open_keys = materialise(
        keys.join(exact.select("game_id", "value"), ["game_id", "value"], "left_anti")
        .filter(F.length("value") >= fixed.FUZZY_MIN_LENGTH)
    )

    # No match joins strings of such different lengths, so long names are out of reach of short values.
    longest = open_keys.agg(F.coalesce(F.max(F.length("value")), F.lit(0))).first()[0]
    names = materialise(names.filter(F.length("name") <= FAR * longest))

    part_miss = 1 - min_score / 100 / 0.9  # joint edit share a partial match may have
    part_miss = math.floor(part_miss * 2 * 1e6) / 1e6 + 1e-4
    near = _near_candidates(open_keys, names.filter(F.length("name") <= 2 * longest), 1 - min_score / 100)
    words = _shared_word_candidates(open_keys, names)
    value_in_name = substrings_like(
        names.select("game_id", "name", F.col("name").alias("hay")), "hay",
        *_needles(_long_needles(open_keys, "value", part_miss), "value", "found"),
    )
    long_values = join_small(
        value_in_name, _long_needles(open_keys, "value", part_miss), ["game_id", "found"]
    ).filter(_inside(F.col("value"), F.col("name")))
    inner_names = names.filter(F.length("name") <= longest)
    name_in_value = substrings_like(
        open_keys.select("game_id", "value", F.col("value").alias("hay")), "hay",
        *_needles(_long_needles(inner_names, "name", part_miss), "name", "found"),
    )
    long_names = join_small(
        _long_needles(inner_names, "name", part_miss), name_in_value, ["game_id", "found"]
    ).filter(_inside(F.col("name"), F.col("value")))
    pairs = (
        near.unionByName(words)
        .unionByName(long_values.select("game_id", "value", "name"))
        .unionByName(long_names.select("game_id", "value", "name"))
        .distinct()
        .withColumn("score", F.round(weighted_ratio_of(F.col("value"), F.col("name")), 6))
        .filter(F.col("score") >= min_score)
        .join(names, ["game_id", "name"])
        .select("game_id", "value", "score", "first", "canonical_name")
    )

    # Whole containment scores 90 for every pair, so only the first name per value is needed.
    inner = substrings_like(
        names.withColumn("hay", F.col("name")), "hay", open_keys, "value"
    ).filter(_inside(F.col("found"), F.col("name")))
    holder = first_by(
        inner.select("game_id", F.col("found").alias("value"), "first", "canonical_name"),
        ["game_id", "value"], "first",
    )
    held = join_small(
        substrings_like(
            open_keys.withColumn("hay", F.col("value")), "hay", names, "name"
        ).filter(_inside(F.col("found"), F.col("value"))),
        names.withColumnRenamed("name", "found"), ["game_id", "found"],
    ).select("game_id", "value", "first", "canonical_name")
    contained = (
        join_small(holder, open_keys, ["game_id", "value"], "left_semi")
        .unionByName(held)
        .withColumn("score", F.lit(90.0))
        .filter(F.col("score") >= min_score)
    )

    best = (
        pairs.unionByName(contained)
        .groupBy("game_id", "value")
        .agg(
            F.min_by(
                F.struct("canonical_name", "score"), F.struct(-F.col("score"), F.col("first"))
            ).alias("b")
        )
        .select("game_id", "value", "b.canonical_name", "b.score")
    )
    answers = exact.select("game_id", "value", "canonical_name", "score").unionByName(best)
    return wanted.join(
        answers.select(
            F.col("game_id").alias("tenant"), F.col("value").alias("key"), "canonical_name",
            "score",
        ),
        ["tenant", "key"],
    ).select("game_id", "value", "canonical_name", "score")


def _needles(rows: DataFrame, owner: str, column: str) -> tuple[DataFrame, str]:
    return rows.drop(owner), column
