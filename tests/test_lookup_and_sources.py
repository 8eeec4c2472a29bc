"""Mentions by tries, selection by ranges, the inverted file, and the landed source."""

import datetime as dt
import json
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from loreloom.operators import entities, hybrid, ivf, manifests, numbering, vector
from loreloom.sources import adapter, files, landed

REGISTRY = (
    "game_id string, canonical_name string, normalized_name string, content_type string, "
    "source_url string, aliases array<string>"
)


def registry_of(spark, names):
    rows = [(g, n, n.lower(), "item", f"u/{i}", []) for i, (g, n) in enumerate(names)]
    return spark.createDataFrame(rows, REGISTRY)


@pytest.mark.parametrize("shard_chars", [1 << 20, 40])
def test_mentions_equal_brute_force(spark, monkeypatch, shard_chars):
    """Names inside names, a name of 2,000 letters, letters beyond ASCII; one cell or many."""
    monkeypatch.setattr(entities, "SHARD_CHARS", shard_chars)
    monkeypatch.setattr(entities, "SLICE_BYTES", shard_chars * 4)
    chance = random.Random(2)
    long = "".join(chance.choice("xyz ") for _ in range(2000)).replace("  ", " x").strip()
    names = [("g", n) for n in ("he", "she", "hers", "her", "é日", "a b", long, long[:700].strip())]
    names += [("h", "she"), ("h", "zz")]
    texts = [("g", "ushers"), ("g", f"so {long} it is"), ("g", "é日本 a  b"), ("h", "she zzz"), ("g", None), ("g", ""),
             ("none", "she")]
    texts += [("g", " ".join(chance.choice(["he", "rs", "ushe", "a", "b"]) for _ in range(30))) for _ in range(30)]
    frame = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "text_id int, game_id string, text string")
    found = entities.mentions(registry_of(spark, names), frame).collect()
    want = set()
    for i, (game, text) in enumerate(texts):
        normal = " ".join((text or "").lower().split())
        want |= {(i, g, n, normal.index(n) + 1) for g, n in names if g == game and n in normal}
    assert {(r["text_id"], r["game_id"], r["canonical_name"], r["position"]) for r in found} == want
    assert len(found) == len(want)
    empty = registry_of(spark, [])
    assert entities.mentions(empty, frame).count() == 0
    assert entities.mentions(registry_of(spark, names), frame.limit(0)).count() == 0


def test_long_names_do_not_slow_short_lookups(spark):
    long = " ".join(f"word{i}" for i in range(400))
    values = spark.createDataFrame([("g", "firebal"), ("g", "word17")], "game_id string, value string")
    got = entities.fuzzy_lookup(registry_of(spark, [("g", "Fireball"), ("g", long), ("g", "Word17")]), values).collect()
    assert {(r["value"], r["canonical_name"]) for r in got} == {("firebal", "Fireball"), ("word17", "Word17")}


def nearest(values, p):
    return sorted(values)[round((len(values) - 1) * p)]


@pytest.mark.parametrize("ranges", [1, 7])
def test_nearest_rank_with_outliers_and_a_giant_key(spark, ranges):
    chance = random.Random(6)
    rows = [("hot", chance.gauss(0, 1)) for _ in range(3000)] + [("hot", 1e300), ("hot", -1e300)]
    rows += [("few", float(i)) for i in range(4)] + [("one", 5.0), ("none", None), (None, 1.0), (None, 3.0)]
    rows += [("same", 2.0)] * 500
    frame = spark.createDataFrame(rows, "k string, v double")
    by_key = {}
    for k, v in rows:
        if v is not None:
            by_key.setdefault(k, []).append(v)
    for p in (0.0, 0.5, 0.95, 1.0):
        got = {r["k"]: r["p"] for r in numbering.nearest_rank(frame, "v", p, ["k"], "p", ranges).collect()}
        assert got == {k: nearest(v, p) for k, v in by_key.items()}
        whole = numbering.nearest_rank(frame, "v", p, name="p", ranges=ranges).collect()
        assert [r["p"] for r in whole] == [nearest([v for _, v in rows if v is not None], p)]
    assert numbering.nearest_rank(frame.limit(0), "v", 0.5, ["k"]).count() == 0


def test_inverted_file_finds_most_of_the_exact_results(spark, data):
    table = spark.read.parquet(f"{data}/embeddings.parquet")
    vectors = table.select("vec_id", F.col("vec_id").alias("ord"), F.col("label").cast("string").alias("game_id"), "embedding")
    asked = vectors.select(F.col("vec_id").alias("query_id"), "game_id", "embedding")
    centres = ivf.fit_centres(vectors, "vec_id")
    found = ivf.ivf_search(ivf.assign(vectors, centres), asked, centres, 5, "vec_id").cache()
    exact = vector.vector_search(vectors, asked, 5, key="vec_id").cache()
    recall = ivf.recall(found, exact, "vec_id").agg(F.avg("recall"), F.count("query_id")).first()
    assert recall[0] >= 0.9 and recall[1] == table.count()
    assert ivf.assign(vectors, centres).count() == vectors.count()
    # What is found has its exact score.
    same = found.join(exact.select("query_id", "vec_id", F.col("score").alias("s")), ["query_id", "vec_id"])
    assert same.filter("score != s").count() == 0


def test_inverted_file_prunes_where_vectors_cluster(spark):
    chance = np.random.default_rng(4)
    middles = chance.normal(size=(40, 16))
    rows = [(i, i, "g", (middles[i % 40] + chance.normal(0, 0.05, 16)).tolist()) for i in range(1600)]
    rows += [(9000 + i, i, "g", rows[0][3]) for i in range(60)] + [(9999, 0, "g", None)]
    vectors = spark.createDataFrame(rows, "vec_id long, ord long, game_id string, embedding array<double>")
    centres = ivf.fit_centres(vectors, "vec_id")
    assert centres.probes < len(centres.matrix) // 4
    asked = vectors.filter("vec_id < 100").select(F.col("vec_id").alias("query_id"), "game_id", "embedding")
    found = ivf.ivf_search(ivf.assign(vectors, centres), asked, centres, 5, "vec_id")
    exact = vector.vector_search(vectors, asked, 5, key="vec_id")
    assert ivf.recall(found, exact, "vec_id").agg(F.avg("recall")).first()[0] >= 0.9
    nothing = vectors.limit(0)
    assert ivf.fit_centres(nothing, "vec_id") is None
    assert ivf.ivf_search(ivf.assign(nothing, None), asked, None, 5, "vec_id").count() == 0


def raw_rows(spark, ids, game="g"):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    rows = [(f"d:{i}", game, f"s {i % 3}", "u", f"Títle {i}", f'line\n"{i}" é', "c", at, None) for i in ids]
    return spark.createDataFrame(rows, files.RAW_SCHEMA)


def test_landed_documents_read_back(spark, tmp_path):
    path = str(tmp_path / "landed")
    docs = raw_rows(spark, range(9)).unionByName(raw_rows(spark, range(20, 24), "other/one"))
    adapter.land_documents(docs.repartition(3), path)
    order = lambda df: sorted(df.select(*docs.columns).collect(), key=lambda r: r["doc_id"])
    assert order(adapter.read_landed(spark, path)) == order(docs)
    some = adapter.read_landed(spark, path).filter("game_id = 'g' AND source_id IN ('s 1', 's 2') AND title <> 'Títle 4'")
    assert order(some) == order(docs.filter("game_id = 'g' AND source_id != 's 0' AND title <> 'Títle 4'"))
    schema = spark.createDataFrame([], files.RAW_SCHEMA).schema
    reader = adapter.LandedReader(path, schema)
    left = list(reader.pushFilters([adapter.EqualTo(("source_id",), "s 1"), adapter.EqualTo(("title",), "x")]))
    kept = [f for group in reader.partitions() for f in group.value]
    assert len(left) == 1 and {dict(f.folders)["source_id"] for f in kept} == {"s 1"}


def test_landed_documents_as_a_stream(spark, tmp_path):
    path, seen = str(tmp_path / "landed"), []
    for number in range(2):
        adapter.land_documents(raw_rows(spark, range(number * 5, number * 5 + 5)).coalesce(1), path)
        query = (
            adapter.landed_stream(spark, path).writeStream.trigger(availableNow=True)
            .option("checkpointLocation", str(tmp_path / "progress"))
            .foreachBatch(lambda batch, n: seen.append(sorted(r["doc_id"] for r in batch.collect()))).start()
        )
        query.awaitTermination(90)
        query.stop()
    assert [rows for rows in seen if rows] == [[f"d:{i}" for i in range(5)], [f"d:{i}" for i in range(5, 10)]]


def test_terms_that_look_like_lists_stay_strings(spark, tmp_path):
    lines = [
        {"id": 7, "query": "q", "expected_answer_terms": ['["a"]', ["b", "c"], "[d", "e"]},
        {"id": "8", "query": "q", "game_id": "", "allow_insufficient_context": True},
    ]
    (tmp_path / "golden.jsonl").write_text("\n\n".join(json.dumps(x) for x in lines))
    rows = files.read_answer_golden(spark, str(tmp_path / "golden.jsonl")).orderBy("id").collect()
    assert rows[0]["expected_answer_terms"] == [['["a"]'], ["b", "c"], ["[d"], ["e"]]
    assert (rows[1]["game_id"], rows[1]["expected_answer_terms"], rows[1]["allow_insufficient_context"]) == ("bg3", [], True)
    (tmp_path / "bad.jsonl").write_text('{"id": "1"}\n')
    with pytest.raises(Exception, match="missing required key query"):
        files.read_answer_golden(spark, str(tmp_path / "bad.jsonl")).collect()


def test_results_without_an_id_are_known_by_their_text(spark):
    rows = [("c1", "u", "t", "s", "x"), (None, "u", "t", None, "x"), ("", None, "t", "s", "y")]
    frame = spark.createDataFrame(rows, "chunk_id string, source_url string, title string, section string, text string")
    assert [r[0] for r in frame.select(hybrid.result_key()).collect()] == ["c1", "u|t||x", "|t|s|y"]


@pytest.mark.parametrize("broadcast", [True, False])
def test_long_names_meet_texts_on_their_words(spark, monkeypatch, broadcast):
    """only names of a few words are searched in every text; the others are found as before."""
    if not broadcast:
        monkeypatch.setattr("loreloom.session.fits_broadcast", lambda *a, **k: False)
    searched, cells = [], entities._name_cells
    monkeypatch.setattr(
        entities, "_name_cells", lambda t, n: searched.extend(r["found"] for r in n.collect()) or cells(t, n)
    )
    chance = random.Random(5)
    pool = ["ab", "b", "ba", "éa", "日a"]
    words = lambda n: " ".join(chance.choice(pool) for _ in range(n))
    same = words(6)
    names = {words(chance.randrange(1, 14)) for _ in range(60)} | {f"{a} {same} {b}" for a in pool for b in ("ab", "c")}
    names = [("g", n) for n in sorted(names)] + [("h", f"b {same} ab")]
    texts = [(g, f"x{n}y {words(3)} {n}  {n}z") for g, n in names] + [("g", words(60)) for _ in range(30)]
    texts += [("g", f"b {same}"), ("h", f"b {same} ab"), ("g", None), (None, f"b {same} ab")]
    # Repeated and null ids are rows of their own.
    frame = spark.createDataFrame(
        [(None if i == 3 else i // 2, *t) for i, t in enumerate(texts)], "text_id int, game_id string, text string"
    )
    got = entities.mentions(registry_of(spark, names), frame).collect()
    want = {}
    for i, (game, text) in enumerate(texts):
        normal = " ".join((text or "").lower().split())
        for g, n in names:
            if g == game and n in normal:
                key = (None if i == 3 else i // 2, g, n)
                want[key] = min(want.get(key, 10**9), normal.index(n) + 1)
    assert {(r["text_id"], r["game_id"], r["canonical_name"]): r["position"] for r in got} == want
    assert len(got) == len(want)
    assert searched and max(len(n.split(" ")) for n in searched) < entities.RUN + 2


def test_first_title_refs_shuffle_one_string(spark):
    """the same rows as title_refs and dedupe; titles with underscores of their own stay as they are."""
    titles = ["a b", "a_b", "c_d e", "c d e", "f", "a b", " g_", "_g ", "h/é?"]
    frame = spark.createDataFrame([(i, t, f"k{i}") for i, t in enumerate(titles)], "ord int, title string, content_type string")
    for order in (frame, frame.withColumn("ord", -F.col("ord"))):
        want = manifests.dedupe(manifests.title_refs(order, "w", "https://w/", True))
        got = manifests.first_title_refs(order, "w", "https://w/", True)
        assert got.columns == want.columns and sorted(got.collect()) == sorted(want.collect())
    listing = spark.createDataFrame([(1, "c", "k", "{}")], "ord int, category string, content_type string, payload string")
    plan = landed.category_refs(listing, "w", "https://w/")._jdf.queryExecution().optimizedPlan().toString()
    aggregate = plan[plan.index("Aggregate"):].split("\n")[0]
    assert "source_url" not in aggregate and "doc_id" not in aggregate
