import math
from collections import Counter

from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from loreloom.functions.embedding import hash_embedding
from loreloom.functions.fuzzy import partial_ratio, ratio, weighted_ratio
from loreloom.operators import entities, hybrid, lexical, rerank, rewrite, vector
from loreloom.plans import bindings

CHUNKS = (
    "chunk_id string, ord bigint, game_id string, source_id string, source_url string, "
    "title string, content_type string, section string, text string"
)
ENTITIES = (
    "game_id string, canonical_name string, normalized_name string, content_type string, "
    "source_url string, aliases array<string>"
)


def chunk(i, title, text, game="bg3", source="bg3_wiki", section="Lead"):
    return (f"c{i}", i, game, source, f"u{i}", title, "spell", section, text)


def chunks_of(spark, *rows):
    return spark.createDataFrame(list(rows), CHUNKS)


def queries_of(spark, *texts, game="bg3"):
    rows = [(i, game, t) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "query_id int, game_id string, query string")


def registry(spark, *names, game="bg3", kind="spell"):
    rows = [(game, n, n.lower(), kind, "u", [n.lower()]) for n in names]
    return spark.createDataFrame(rows, ENTITIES)


def test_title_match_ranks_first_inside_the_tenant(spark):
    chunks = chunks_of(
        spark,
        chunk(1, "Initiative", "Fireball can use a saving throw."),
        chunk(2, "Fireball", "Deals 8d6 fire damage."),
        chunk(3, "Fireball", "Other tenant damage", game="other"),
    )
    rows = lexical.bm25_search(chunks, queries_of(spark, "Fireball damage", "???"), 2).collect()
    assert [r["chunk_id"] for r in sorted(rows, key=lambda r: r["rank"])] == ["c2", "c1"]


def test_scores_follow_the_formula_on_both_join_paths(spark, data, monkeypatch):
    chunks = bindings.corpus(spark, data)
    asked = bindings.queries(spark, data)
    docs = chunks.collect()
    import re

    def fold(text):
        return text.lower().replace("ß", "ss")

    tokens = {
        d["chunk_id"]: re.findall(
            r"\w+",
            fold(" ".join([d["title"]] * 4 + [d["section"]] * 2 + [d["content_type"], d["text"]])),
        )
        for d in docs
    }
    counts = {k: Counter(v) for k, v in tokens.items()}
    df = Counter(t for c in counts.values() for t in c)
    mean = sum(map(len, tokens.values())) / len(tokens)
    wanted = {}
    for q in asked.collect():
        scored = []
        for d in docs:
            if d["game_id"] != q["game_id"]:
                continue
            score = 0.0
            for t in re.findall(r"\w+", fold(q["query"])):
                tf = counts[d["chunk_id"]][t]
                if tf:
                    idf = math.log(1 + (len(docs) - df[t] + 0.5) / (df[t] + 0.5))
                    size = len(tokens[d["chunk_id"]])
                    score += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * size / mean))
            if score > 0:
                scored.append((-round(score, 6), d["ord"], d["chunk_id"]))
        wanted[q["query_id"]] = [c for _, _, c in sorted(scored)[:5]]

    def ranked():
        got = {}
        for r in lexical.bm25_search(chunks, asked, 5).orderBy("query_id", "rank").collect():
            got.setdefault(r["query_id"], []).append(r["chunk_id"])
        return got

    wanted = {k: v for k, v in wanted.items() if v}
    assert ranked() == wanted
    import loreloom.session as session

    monkeypatch.setattr(session, "fits_broadcast", lambda *a, **k: False)
    assert ranked() == wanted


def test_vector_search_equals_brute_force(spark, no_broadcast):
    rng = np.random.default_rng(7)
    data = [(f"v{i}", i, "ab"[i % 2], rng.normal(size=8).tolist()) for i in range(60)]
    vectors = spark.createDataFrame(
        [*data, ("none", 99, "a", None)],
        "chunk_id string, ord bigint, game_id string, embedding array<double>",
    )
    asked = spark.createDataFrame(
        [(i, "ab"[i % 2], rng.normal(size=8).tolist()) for i in range(5)],
        "query_id int, game_id string, embedding array<double>",
    )
    got = {}
    for r in vector.vector_search(vectors, asked, 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["chunk_id"])
    unit = {k: (g, np.array(e) / np.linalg.norm(e)) for k, _, g, e in data}
    for q in asked.collect():
        e = np.array(q["embedding"]) / np.linalg.norm(q["embedding"])
        best = sorted((-round(float(u @ e), 6), k) for k, (g, u) in unit.items() if g == q["game_id"])
        assert got[q["query_id"]] == [k for _, k in best[:4]]


def test_hash_embedding(spark):
    texts = ["abc", "", "é 日本", None]
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r[0]: r[1] for r in rows.select("i", hash_embedding(40)(F.col("t"))).collect()}
    for i, text in enumerate(texts):
        data = b"".join(sha256(f"{n}:{text or ''}".encode()).digest() for n in range(2))[:40]
        values = np.frombuffer(data, np.uint8) / 127.5 - 1
        assert len(got[i]) == 40 and np.allclose(got[i], values / np.linalg.norm(values), atol=1e-12)


def test_merge_keeps_both_provenances(spark):
    left = spark.createDataFrame(
        [(1, "a", 0, 0.88, 1), (1, "b", 1, 0.80, 2)],
        "query_id int, chunk_id string, ord bigint, score double, rank int",
    )
    right = spark.createDataFrame(
        [(1, "b", 1, 9.0, 0.9, 1), (1, "c", 2, 1.0, 0.5, 2)],
        "query_id int, chunk_id string, ord bigint, bm25_score double, score double, rank int",
    )
    rows = {r["chunk_id"]: r for r in hybrid.merge_candidates(left, right).collect()}
    assert rows["b"]["retrieval_source"] == "vector+bm25" and rows["b"]["score"] == 0.9
    assert rows["b"]["bm25_score"] == 9.0 and rows["a"]["bm25_score"] is None
    assert (rows["c"]["list_no"], rows["c"]["list_rank"]) == (1, 2)


def ranked(spark, query, rows, limit):
    data = [
        (1, query, f"c{i}", title, section, text, float(score), 0, i)
        for i, (title, section, text, score) in enumerate(rows)
    ]
    frame = spark.createDataFrame(
        data,
        "query_id int, query string, chunk_id string, title string, section string, text string, "
        "score double, list_no int, list_rank int",
    )
    return rerank.rank_candidates(frame, limit).orderBy("rank").collect()


def test_exact_title_beats_score(spark):
    rows = ranked(
        spark, "Who is Astarion?",
        [("Aelis", "Involvement", "Near Astarion.", 0.99), ("Astarion", "Lead", "A companion.", 0.01)],
        2,
    )
    assert rows[0]["title"] == "Astarion"
    assert "title_exact:astarion" in rows[0]["rerank_reasons"]
    assert "section_lead_for_definition" in rows[0]["rerank_reasons"]


def test_title_token_bonus(spark):
    rows = ranked(
        spark, "Fireball damage",
        [("Eldritch Blast", "", "Force damage.", 0.61), ("Scroll of Fireball", "", "Cast Fireball.", 0.6)],
        2,
    )
    assert rows[0]["title"] == "Scroll of Fireball"
    assert rows[0]["rerank_reasons"] == ["title_token:fireball", "text_term:fireball"]


def test_title_diversity(spark):
    rows = ranked(
        spark, "Compare Fireball vs Lightning Bolt damage",
        [
            ("Fireball", "", "Deals 8d6 Fire damage.", 0.7), ("Fireball", "", "Visual notes.", 0.69),
            ("Lightning Bolt", "", "Deals 8d6 Lightning damage.", 0.68),
        ],
        2,
    )
    assert {r["title"] for r in rows} == {"Fireball", "Lightning Bolt"}
    assert "comparative_diversity" in rows[1]["rerank_reasons"]


def test_section_diversity(spark):
    rows = ranked(
        spark, "Who is Astarion?",
        [
            ("Astarion", "History", "One.", 0.95), ("Astarion", "History", "Two.", 0.94),
            ("Astarion", "History", "Three.", 0.93),
            ("Astarion", "Gameplay", "Astarion joins.", 0.72),
            ("Astarion", "Approval", "Astarion approves.", 0.71),
        ],
        3,
    )
    assert [r["section"] for r in rows] == ["History", "Gameplay", "Approval"]
    assert "section_diversity" in rows[1]["rerank_reasons"]


def test_policy_and_hint_order(spark):
    rows = [
        (1, "any hint", "a", "x_wiki", 0.9, 0.9, 1), (1, "any hint", "b", "x_reddit", 0.2, 0.2, 2),
        (2, "facts", "a", "x_wiki", 0.2, 0.2, 2), (2, "facts", "b", "x_reddit", 0.6, 0.6, 1),
    ]
    frame = spark.createDataFrame(
        rows,
        "query_id int, query string, chunk_id string, source_id string, score double, "
        "rerank_score double, rank int",
    )
    scores = {
        (r["query_id"], r["chunk_id"]): r["score"]
        for r in rerank.apply_source_policy(frame).collect()
    }
    assert scores == {(1, "a"): 0.9, (1, "b"): 0.65, (2, "a"): 0.55, (2, "b"): 0.45}
    order = [
        (r["query_id"], r["chunk_id"])
        for r in rerank.finalise(frame).orderBy("query_id", "rank").collect()
    ]
    assert order == [(1, "b"), (1, "a"), (2, "b"), (2, "a")]


def test_hybrid_and_vector_only_search(spark):
    chunks = chunks_of(
        spark,
        chunk(1, "Fireball", "Fire damage in a radius."),
        chunk(2, "Ice Storm", "Cold damage."),
        chunk(3, "Fireball", "wrong tenant", game="other"),
    )
    embed = hash_embedding(16)
    base = hybrid.KnowledgeBase(
        chunks, hybrid.embed_chunks(chunks, embed), embed, entities=registry(spark, "Fireball")
    )
    rows = hybrid.search(base, queries_of(spark, "fireballll damage"), 5).collect()
    top = min(rows, key=lambda r: r["rank"])
    assert top["title"] == "Fireball" and top["retrieval_query"] == "Fireball damage"
    assert top["rewrite_reasons"] == ["fireballll->Fireball:fuzzy"]
    assert {r["game_id"] for r in rows} == {"bg3"}
    plain = hybrid.KnowledgeBase(chunks, base.vectors, embed, hybrid=False)
    assert {r["retrieval_source"] for r in hybrid.search(plain, queries_of(spark, "x"), 5).collect()} == {
        "vector"
    }


# ---- entities --------------------------------------------------------------


def test_entities_come_from_first_chunks(spark):
    chunks = chunks_of(
        spark, chunk(2, "Lightning Bolt", "b"), chunk(1, "Fireball", "a"), chunk(3, "Fireball", "c")
    )
    rows = entities.build_entities(chunks).orderBy("canonical_name").collect()
    assert [(r["canonical_name"], r["source_url"]) for r in rows] == [
        ("Fireball", "u1"), ("Lightning Bolt", "u2"),
    ]


def fuzzy(spark, reg, *values, game="bg3", **more):
    asked = spark.createDataFrame([(game, v) for v in values], "game_id string, value string")
    return {
        r["value"]: r["canonical_name"]
        for r in entities.fuzzy_lookup(reg, asked, **more).collect()
    }


def test_fuzzy_examples(spark):
    reg = registry(spark, "Fireball", "Lightning Bolt", "Damage Types")
    assert fuzzy(spark, reg, "fireballll", "lightnign bolt", "damage", "is", "who") == {
        "fireballll": "Fireball", "lightnign bolt": "Lightning Bolt",
    }
    reg = registry(spark, "Astarion", "Aelis Siryasius")
    assert fuzzy(spark, reg, "is", "Who", "Astarion", "Астаріон", "Астаріона") == {
        "Astarion": "Astarion", "Астаріон": "Astarion", "Астаріона": "Astarion",
    }
    reg = registry(spark, "Ballroom", "Network", "Blue Prince", game="blue_prince")
    assert fuzzy(spark, reg, "room", "work", "Blue", "blueprints", game="blue_prince") == {}
    assert fuzzy(spark, registry(spark, "Fireball", game="x"), "fireball") == {}
    assert fuzzy(spark, registry(spark, "Fireball", game="x"), "fireball", cross_tenant=True) == {
        "fireball": "Fireball"
    }


def brute(names, value):
    """Best name by score, then by position."""
    if value in names:
        return value, 100.0
    best = max(names, key=lambda n: (round(weighted_ratio(value, n), 6), -names.index(n)))
    score = round(weighted_ratio(value, best), 6)
    return (best, score) if score >= 88 else None


def test_fuzzy_candidates_lose_nothing(spark, data):
    titles = [
        r[0] for r in bindings.raw_documents(spark, data).filter("game_id = 'en'")
        .select("title").distinct().collect()
    ]
    long = ["the complete guide to the old manor house", "the complete guide to the old manor"]
    names = sorted({t.lower() for t in titles if t}) + long
    words = {w for n in names for w in n.split() if len(w) > 3}
    words |= {w[1:] for w in words} | {w[:-1] + "xx" for w in words} | {w[::-1] for w in words}
    words |= {"complete guide to the old manor", "he complete guide to the old manoir"}
    words |= {n.split()[1] + " " + n.split()[0] for n in names if len(n.split()) == 2}
    words = sorted(w for w in words if len(w) > 3 and w == " ".join(w.split()))
    reg = registry(spark, *names)
    asked = spark.createDataFrame([("bg3", w) for w in words], "game_id string, value string")
    got = {
        r["value"]: (r["canonical_name"], r["score"])
        for r in entities.fuzzy_lookup(reg, asked).collect()
    }
    from loreloom.functions import fixed

    names = sorted(names)
    want = {w: brute(names, w) for w in words if w not in fixed.NON_ENTITY_TERMS}
    assert got == {w: b for w, b in want.items() if b}


def test_ratios():
    assert ratio("abcd", "abcd") == 100 and ratio("ab", "cd") == 0
    assert partial_ratio("bolt", "lightning bolt") == 100
    assert weighted_ratio("bolt", "lightning bolt") == 90


def test_mentions_in_order(spark, no_broadcast):
    reg = registry(spark, "Fireball", "Lightning Bolt", "Bolt")
    texts = spark.createDataFrame(
        [(1, "bg3", "Compare lightning  bolt with FIREBALL"), (2, "bg3", ""), (3, "x", "fireball")],
        "text_id int, game_id string, text string",
    )
    rows = entities.mentions(reg, texts).orderBy("position", "canonical_name").collect()
    assert [(r["text_id"], r["canonical_name"], r["position"]) for r in rows] == [
        (1, "Lightning Bolt", 9), (1, "Bolt", 19), (1, "Fireball", 29),
    ]


def test_exact_lookup_and_listing(spark):
    reg = registry(spark, "Fireball", "Ice Storm")
    asked = spark.createDataFrame(
        [(1, "bg3", "ICE_storm"), (2, "bg3", "nothing")], "lookup_id int, game_id string, name string"
    )
    rows = {r["lookup_id"]: r["canonical_name"] for r in entities.exact_lookup(reg, asked).collect()}
    assert rows == {1: "Ice Storm", 2: None}
    listed = entities.list_entities(reg, "bg3", "spell", limit=1).collect()
    assert [r["canonical_name"] for r in listed] == ["Fireball"]
    assert entities.list_entities(reg, content_type="item").count() == 0


def test_rewriting(spark):
    asked = queries_of(
        spark, "Порівняй мені fireball з молнією що завдає більше шкоди", "Fireball damage",
        "що сильніше блискавка чи фаєрбол урон", "fireballll damage", "Хто такий Астаріон?",
        "Who is Astarion?", "",
    )
    rows = rewrite.rewrite_queries(asked, registry(spark, "Fireball", "Astarion"))
    got = [
        (r["retrieval_query"], r["rewrite_reasons"]) for r in rows.orderBy("query_id").collect()
    ]
    assert [g[0] for g in got] == [
        "compare Fireball with Lightning Bolt damage", "Fireball damage",
        "what stronger Lightning Bolt or Fireball damage", "Fireball damage",
        "Хто такий Astarion", "Who is Astarion", "",
    ]
    assert "молнією->Lightning Bolt" in got[0][1]
    assert got[1][1] == []
    assert got[3][1] == ["fireballll->Fireball:fuzzy"]


def test_vector_blocks_keep_their_width_and_meet_by_slices(spark, monkeypatch, no_broadcast):
    """Single-precision vectors travel as such; blocks dealt to slices find what broadcast ones find."""
    import random

    from pyspark.sql import functions as F

    from loreloom.operators import vector

    chance = random.Random(5)
    rows = [(i, i, "ab"[i % 2], [chance.gauss(0, 1) for _ in range(8)]) for i in range(60)]
    made = spark.createDataFrame(rows, "vec_id bigint, ord bigint, game_id string, embedding array<float>")
    asked = made.select(F.col("vec_id").alias("query_id"), "game_id", "embedding")
    want = sorted(vector.vector_search(made, asked, 3, "vec_id").collect())
    width = vector.pack_blocks(made, "vec_id", "v_").agg(F.sum(F.octet_length("v_matrix"))).first()[0]
    assert width == 60 * 8 * 4
    monkeypatch.setattr(vector, "fits_broadcast", lambda *a, **k: False)
    monkeypatch.setattr(vector, "SLICE_BYTES", 256)
    assert sorted(vector.vector_search(made, asked, 3, "vec_id").collect()) == want


def test_small_blocks_dealt_to_slices_score_the_same(spark, data, monkeypatch):
    """Chunks and queries in many blocks, neither side broadcast."""
    from loreloom.operators import vector

    chunks, asked = bindings.corpus(spark, data), bindings.queries(spark, data)
    columns = ["query_id", "chunk_id", "ord", "bm25_score", "score", "rank"]
    index = lexical.build_index(chunks)
    want = sorted(lexical.search(index, asked, 7).select(*columns).collect())
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 500)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 60)
    monkeypatch.setattr(vector, "SLICE_BYTES", 1 << 12)
    for module in (vector, lexical):
        monkeypatch.setattr(module, "fits_broadcast", lambda *a, **k: False)
    assert want and sorted(lexical.search(index, asked, 7).select(*columns).collect()) == want


def test_texts_are_not_written_with_the_candidates(spark, monkeypatch):
    from loreloom.operators import hybrid, rerank
    from loreloom.session import materialise

    written = []
    for module in (hybrid, rerank):
        monkeypatch.setattr(module, "materialise", lambda d: written.append(d.columns) or materialise(d))
    embed = hash_embedding(16)
    chunks = chunks_of(spark, chunk(1, "Fireball", "Fire damage."), chunk(2, "Bolt", "Shock damage."))
    base = hybrid.KnowledgeBase(chunks, hybrid.embed_chunks(chunks, embed), embed)
    found = hybrid.search(base, queries_of(spark, "Fireball damage")).collect()
    assert {r["text"] for r in found} == {"Fire damage.", "Shock damage."}
    assert written and not [c for c in written if "text" in c]


def test_a_chunk_found_by_many_queries_is_repeated(spark, monkeypatch):
    from loreloom.operators import hybrid

    chunks = chunks_of(spark, chunk(1, "A", "one"), chunk(2, "B", "two"), chunk(3, "C", "three"))
    found = spark.createDataFrame(
        [(i, f"c{1 + (i % 7 == 0)}") for i in range(50)], "query_id int, chunk_id string"
    )
    want = sorted(hybrid.with_payload(found, chunks).select("query_id", "chunk_id", "text").collect())
    monkeypatch.setattr(hybrid, "fits_broadcast", lambda *a, **k: False)
    monkeypatch.setattr(hybrid, "HOT_ROWS", 10)
    got = hybrid.with_payload(found, chunks).select("query_id", "chunk_id", "text")
    assert len(want) == 50 and sorted(got.collect()) == want


def test_workers_are_sent_a_few_pairs_of_blocks_at_once(spark, monkeypatch):
    """a batch of pairs grew with the table; now it has PAIR_ROWS of them."""
    from loreloom.session import BATCH_ROWS, materialise

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": pa.array([batch.num_rows], pa.int64())})

    usual = spark.conf.get(BATCH_ROWS)
    wide = spark.range(0, 50, 1, 1).mapInArrow(sizes, "n bigint")
    assert {r["n"] for r in materialise(wide, batch_rows=vector.PAIR_ROWS).collect()} <= {vector.PAIR_ROWS, 2}
    assert spark.conf.get(BATCH_ROWS) == usual and [r["n"] for r in wide.collect()] == [50]

    bounds = []
    monkeypatch.setattr(vector, "materialise", lambda df, **more: bounds.append(more) or materialise(df, **more))
    rows = [(i, i, "g", [float(i % 5), float(i % 3) + 1]) for i in range(40)]
    frame = spark.createDataFrame(rows, "chunk_id int, ord int, game_id string, embedding array<float>")
    found = vector.vector_search(frame, frame.select(F.col("chunk_id").alias("query_id"), "game_id", "embedding"), 3)
    assert found.count() == 120 and bounds[-1] == {"batch_rows": vector.PAIR_ROWS}
