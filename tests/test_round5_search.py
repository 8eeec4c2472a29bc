"""Search over large tables of questions: what leaves a task, and what is found once instead of per candidate."""

import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loreloom.functions.contained import inside, words_inside
from loreloom.functions.embedding import hash_embedding
from loreloom.operators import hybrid, lexical, rerank, vector
from loreloom.session import materialise


@pytest.mark.parametrize("remembered", [1 << 20, 0])
def test_later_blocks_give_only_what_may_enter(monkeypatch, remembered):
    """every block gave k rows per query, however low."""
    monkeypatch.setattr(vector, "LEADERS_BYTES", remembered)
    chance = np.random.default_rng(3)
    scores = np.round(chance.random((5, 400)), 2)  # many ties
    scores[4, 3:] = 0.0
    ords = chance.permutation(400)
    leaders, given = vector.Leaders(7, least=np.nextafter(0.0, 1.0)), [[] for _ in scores]
    for start in range(0, 400, 20):
        own = slice(start, start + 20)
        for line, column, value in zip(*leaders.enter(("a",), scores[:, own], ords[own]), strict=True):
            given[line].append((-value, ords[start + column]))
    for line, rows in enumerate(given):
        every = sorted((-s, o) for s, o in zip(scores[line], ords, strict=True) if s > 0)
        assert sorted(rows)[:7] == every[:7]
    assert (sum(map(len, given[:4])) < 4 * 7 * 20 / 2) == bool(remembered)


def test_scores_of_blocks_equal_a_plain_sum(spark, monkeypatch):
    """common terms as a matrix product, the others together per query."""
    chance = random.Random(4)
    words = [f"w{i}" for i in range(40)]
    texts = [" ".join(chance.choices(words, range(1, 41), k=chance.randint(1, 30))) for _ in range(90)]
    chunks = spark.createDataFrame(
        [(f"c{i}", i, "ab"[i % 2], None, None, None, t) for i, t in enumerate(texts)],
        "chunk_id string, ord bigint, game_id string, title string, section string, content_type string, text string",
    )
    asked = [(i, "ab"[i % 2], " ".join(chance.choices(words, k=6)) + (" w39 w39" if i % 3 else " none")) for i in range(30)]
    monkeypatch.setattr(lexical, "BLOCK_POSTINGS", 120)
    monkeypatch.setattr(lexical, "BLOCK_TERMS", 40)
    monkeypatch.setattr(lexical, "SCORED", 3)
    found = lexical.search(lexical.build_index(chunks), spark.createDataFrame(asked, "query_id int, game_id string, query string"), 4)
    got = {}
    for r in found.collect():
        got.setdefault(r["query_id"], {})[r["rank"]] = (r["chunk_id"], r["bm25_score"])
    split = [t.split() for t in texts]
    mean = sum(map(len, split)) / len(split)
    for query, game, text in asked:
        rows = []
        for i, t in enumerate(split):
            total = 0.0
            for word in text.split():
                tf, df = t.count(word), sum(word in x for x in split)
                idf = np.log(1 + (len(split) - df + 0.5) / (df + 0.5))
                total += idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len(t) / mean)) if tf else 0.0
            if total and "ab"[i % 2] == game:
                rows.append((-round(total, 6), i))
        want = {n + 1: (f"c{i}", -s) for n, (s, i) in enumerate(sorted(rows)[:4])}
        assert got[query].keys() == want.keys()
        for rank, (chunk, score) in want.items():
            assert got[query][rank][0] == chunk and got[query][rank][1] == pytest.approx(score, abs=2e-6)


def test_rows_of_small_batches_fill_blocks(spark):
    """a batch left a block of its own for the rest of every tenant."""
    rows = spark.range(0, 300, 1, 1).select(
        F.col("id"), F.concat(F.lit("g"), (F.col("id") % 3).cast("string")).alias("game_id"),
        F.array(F.col("id"), F.lit(-1)).alias("keys"), F.array(F.lit(1.0), F.lit(2.0)).alias("values"),
    )
    blocks = materialise(lexical._packed(rows, "q_", [], 150), batch_rows=10).collect()
    assert sorted(x for b in blocks for x in b["q_ids"]) == list(range(300))
    assert len(blocks) <= 9  # thirty before
    for block in blocks:
        assert {f"g{x % 3}" for x in block["q_ids"]} == {block["game_id"]}
        keys = np.frombuffer(block["q_keys"], np.int64)
        assert len(keys) <= 160 and keys[::2].tolist() == block["q_ids"]
        assert np.frombuffer(block["q_ends"], np.int64).tolist() == list(range(2, len(keys) + 2, 2))


def test_words_inside_texts(spark):
    text = "the fireballs of sankt ßtrasse"
    assert words_inside([["fire", "ball", "of", "no", "off"], [], ["sankt", "alls", "trass"]], text) == [
        ["fire", "ball", "of"], [], ["sankt", "alls", "trass"],
    ]
    rows = spark.createDataFrame(
        [(1, "a fire x", text), (2, "", text), (3, None, text), (4, "fire", ""), (5, "fire", None), (6, "balls", text)],
        "n int, w string, t string",
    )
    got = rows.coalesce(1).select("n", inside(F.col("w"), F.col("t")).alias("f")).orderBy("n").collect()
    assert [r["f"] for r in got] == ["a fire", "", "", "", "", "balls"]


@pytest.mark.parametrize("held", [True, False])
def test_what_is_found_once_ranks_as_what_is_found_per_candidate(spark, monkeypatch, held):
    """queries and texts were cut into words again for every candidate."""
    chunks = spark.createDataFrame(
        [("c1", 1, "g", "Fireball", "Lead", "x_wiki", "Fire damage, not firestorms"),
         ("c2", 2, "g", "Fireball two", "History", "x_reddit", "hints on fire"), ("c3", 3, "g", None, None, None, None)],
        "chunk_id string, ord int, game_id string, title string, section string, source_id string, text string",
    )
    asked = spark.createDataFrame(
        [(1, "What is Fireball storm"), (2, "hint fire"), (3, ""), (4, "compare damage and hints")], "query_id int, query string"
    )
    found = asked.crossJoin(chunks.select("chunk_id")).select(
        "query_id", "chunk_id", F.lit(0.5).alias("score"), F.lit(0).alias("list_no"), F.lit(1).alias("list_rank")
    )
    plain = found.join(asked, "query_id").join(chunks.drop("ord"), "chunk_id")
    want = rerank.finalise(rerank.rank_scored(rerank.rerank_scores(rerank.apply_source_policy(plain)), 2))
    if not held:
        monkeypatch.setattr(hybrid, "fits_broadcast", lambda *a, **k: False)
    features = materialise(rerank.query_features(asked).drop("query"))
    rows = hybrid.with_payload(found, rerank.chunk_features(chunks), features)
    assert "text" not in rows.columns and "query" not in rows.columns
    ranked = rerank.finalise(rerank.rank_scored(rerank.rerank_scores(rerank.apply_source_policy(rows)), 2))
    columns = ["query_id", "rank", "chunk_id", "score", "rerank_score", "rerank_reasons", "source_policy_reasons",
               "rerank_exact_title_match", "rerank_definition_lead_section"]
    got = sorted(ranked.select(*columns).collect())
    assert got == sorted(want.select(*columns).collect()) and len(got) == 8
    assert any("text_term:storm" in r["rerank_reasons"] for r in got)


def test_search_leaves_out_helping_columns(spark):
    chunks = spark.createDataFrame(
        [("c1", 1, "g", "s_wiki", "u", "Fireball", "spell", "Lead", "Fire damage.")],
        "chunk_id string, ord bigint, game_id string, source_id string, source_url string, title string, "
        "content_type string, section string, text string",
    )
    embed = hash_embedding(16)
    asked = spark.createDataFrame([(1, "g", "Fireball damage")], "query_id int, game_id string, query string")
    for more in (True, False):
        base = hybrid.KnowledgeBase(chunks, hybrid.embed_chunks(chunks, embed), embed, hybrid=more)
        found = hybrid.search(base, asked)
        assert not [c for c in found.columns if c.startswith("__")] and found.count() == 1


def test_inverted_file_sends_a_query_once(spark, monkeypatch):
    """a query was written once for every cell that it asks."""
    from loreloom.operators import ivf

    chance = np.random.default_rng(8)
    rows = [(i, i, "ab"[i % 2], chance.normal(size=8).tolist()) for i in range(300)]
    rows += [(900, 900, "a", None), (901, 901, None, rows[0][3])]
    vectors = spark.createDataFrame(rows, "vec_id long, ord long, game_id string, embedding array<float>")
    asked = vectors.select(F.col("vec_id").alias("query_id"), "game_id", "embedding")
    sample = np.array([r[3] for r in rows[:300]])
    centres = ivf.Centres(ivf._unit(sample[:12]), 4)
    monkeypatch.setattr(vector, "BLOCK_BYTES", 8 * 8 * 20)  # some blocks
    written = []
    monkeypatch.setattr(vector, "materialise", lambda df, **more: written.append(materialise(df, **more)) or written[-1])
    found = ivf.ivf_search(ivf.assign(vectors, centres), asked, centres, 3, "vec_id").collect()
    blocks = [w for w in written if "q_ids" in w.columns]
    assert sum(len(r["q_ids"]) for r in blocks[0].collect()) == 300  # 1,200 before
    # The same rows as a search of the asked cells one by one.
    unit = ivf._unit(sample.astype(np.float32).astype(np.float64))
    near = np.argsort(-(unit @ centres.matrix.T), axis=1, kind="stable")
    want = set()
    for i in range(300):
        rows_of = [j for j in range(i % 2, 300, 2) if near[j, 0] in near[i, :4]]
        best = sorted((-round(float(unit[i] @ unit[j]), 6), j) for j in rows_of)[:3]
        want |= {(i, j, n + 1) for n, (_, j) in enumerate(best)}
    assert {(r["query_id"], r["vec_id"], r["rank"]) for r in found} == want


def test_tables_of_large_rows_are_written_in_parts(spark):
    """the writer held a hundred blocks of a task, however large."""
    import pyarrow.parquet as pq

    def blocks(batches):
        for batch in batches:
            for number in batch.column("id").to_pylist():
                yield pa.RecordBatch.from_pydict({"b": pa.array([np.random.default_rng(number).bytes(32 << 20)], pa.binary())})

    table = materialise(spark.range(0, 12, 1, 1).mapInArrow(blocks, "b binary"), batch_rows=1)
    files = [f.removeprefix("file:") for f in table.inputFiles()]
    assert sum(pq.ParquetFile(f).num_row_groups for f in files) >= 3  # one before
    assert table.agg(F.count("b"), F.min(F.octet_length("b"))).first() == (12, 32 << 20)
