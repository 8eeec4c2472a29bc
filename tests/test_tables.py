import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from loreloom.functions.embedding import hash_embedding
from loreloom.operators import crawl, indexing, manifests, requests, sections
from loreloom.sources import files, landed
from loreloom.streaming import jobs

from test_search import chunk, chunks_of

NOW = dt.datetime(2024, 2, 1)


def chunk_rows(spark, *rows):
    return chunks_of(spark, *rows).withColumns(
        {"language": F.lit("en"), "spoiler_level": F.lit("standard")}
    )


def test_chunk_files(spark, tmp_path):
    path = tmp_path / "a.jsonl"
    row = {
        "chunk_id": "c", "game_id": "g", "source_id": "s", "source_url": "u", "title": "t",
        "content_type": "x", "language": "en", "section": "Lead", "text": "é",
    }
    path.write_text(json.dumps(row, ensure_ascii=False) + "\n\n" + json.dumps(row) + "\n")
    rows = files.read_corpus(spark, str(path), f"{path};{tmp_path}/missing.jsonl").collect()
    assert len(rows) == 4 and rows[0]["spoiler_level"] == "standard"
    del row["title"]
    path.write_text(json.dumps(row) + "\n")
    with pytest.raises(Exception, match="missing required key title"):
        files.read_chunks(spark, str(path)).collect()


def test_raw_documents_and_entities(spark, tmp_path):
    doc = {
        "doc_id": "w:A", "game_id": "g", "source_id": "w", "source_url": "u", "title": "t",
        "text_en": "x", "content_type": "c", "fetched_at": "2026-05-29T09:00:00+00:00",
    }
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(doc, indent=2) + "\n")
    raw = files.read_raw_documents(spark, str(tmp_path / "in"))
    files.write_raw_documents(raw, str(tmp_path / "raw"))
    back = spark.read.parquet(str(tmp_path / "raw")).first()
    assert back["fetched_at"] == dt.datetime(2026, 5, 29, 9) and back["license"] is None
    entity = {
        "game_id": "g", "canonical_name": "A", "normalized_name": "a", "content_type": "c",
        "source_url": "u", "aliases": ["a", "b"],
    }
    (tmp_path / "e.json").write_text(json.dumps([entity, entity], indent=2))
    entities = files.read_entities(spark, str(tmp_path / "e.json"))
    files.write_entities(entities, str(tmp_path / "entities"))
    assert spark.read.parquet(str(tmp_path / "entities")).count() == 2


def test_golden_files(spark, tmp_path):
    def lines(name, *rows):
        (tmp_path / name).write_text("\n".join(json.dumps(r) for r in rows) + "\n")
        return str(tmp_path / name)

    path = lines("r", {"id": "1", "query": "q", "expected_titles": ["T"]})
    row = files.read_retrieval_golden(spark, path).first()
    assert row["game_id"] == "bg3" and row["expected_terms"] == [] and row["category"] is None
    path = lines("a", {"id": "1", "query": "q", "expected_answer_terms": ["x", ["y", "z"], "[w"]})
    row = files.read_answer_golden(spark, path).first()
    assert row["expected_answer_terms"] == [["x"], ["y", "z"], ["[w"]]
    assert row["allow_insufficient_context"] is False
    path = lines("t", {"id": "1", "query": "q", "game_id": "g", "expected_tool": None})
    assert files.read_tool_golden(spark, path).first()["expected_tool"] is None


def test_threads(spark):
    def comment(kind="t1", **data):
        return {"kind": kind, "data": data}

    comments = [comment(author="keeper", score=18, body="Try the cellar &amp; wait.", permalink="/a1/")]
    comments += [comment("more"), comment(body="[deleted]"), comment(body="  ")]
    comments += [comment(body=f"b{i}") for i in range(25)]
    payload = [
        {"data": {"children": [comment("t3", title="Where is the lantern", author="wanderer", score=7,
                                       selftext="Asking without spoilers.", permalink="/q/")]}},
        {"data": {"children": comments}},
    ]
    frame = spark.createDataFrame(
        [("d", "community_tip", json.dumps(payload))], "doc_id string, content_type string, payload string"
    )
    rows = landed.thread_rows(frame)
    row = rows.first()
    assert len(row["comments"]) == 20 and row["comments"][0]["body"] == "Try the cellar & wait."
    assert row["comments"][1]["author"] == "unknown" and row["comments"][1]["score"] == 0
    parts = sections.explode_sections(sections.thread_sections(rows)).collect()
    assert [p["section"] for p in parts] == ["Post", "Top comments"]
    assert parts[0]["text"] == (
        "Reddit post: Where is the lantern Author: u/wanderer Score: 7 Asking without spoilers. "
        "Permalink: https://www.reddit.com/q/"
    )
    assert parts[1]["text"].split("\n\n")[1].startswith("Comment 2 by u/unknown Score: 0 b0")
    assert parts[0]["spoiler_level"] == "spoiler_heavy"


def test_listings_and_checks(spark):
    payload = json.dumps({"query": {"categorymembers": [
        {"title": "Fireball"}, {"title": "List of all spells"}, {"title": ""}, {"title": "Lightning Bolt"},
    ]}})
    listing = spark.createDataFrame(
        [(1, "spells", "spell", payload)], "ord bigint, category string, content_type string, payload string"
    )
    rows = landed.category_refs(listing, "w", "https://x/", 10).orderBy("ord").collect()
    assert [(r["title"], r["source_url"]) for r in rows] == [
        ("Fireball", "https://x/Fireball"), ("Lightning Bolt", "https://x/Lightning_Bolt"),
    ]
    wanted = spark.createDataFrame([("a",), ("b",)], "category string")
    allowed = spark.createDataFrame([("a",)], "category string")
    with pytest.raises(ValueError, match="Unknown categories for w: b"):
        manifests.require_known(wanted, allowed, "category", "w")
    manifests.require_known(allowed, allowed, "category", "w")
    urls = spark.createDataFrame([(1, "https://x/y")], "ord bigint, url string")
    with pytest.raises(Exception, match="URL is not from"):
        manifests.thread_refs(urls, "f", "/r/").collect()


def refs_of(spark, counts):
    rows, n = [], 0
    for kind, count in counts.items():
        for _ in range(count):
            rows.append((f"d{n}", "u", f"t{n}", kind, n))
            n += 1
    return spark.createDataFrame(
        rows, "doc_id string, source_url string, title string, content_type string, ord bigint"
    )


def test_samples(spark):
    even = manifests.take_evenly(refs_of(spark, {"spell": 5, "character": 2}), 5)
    assert [r["doc_id"] for r in even.orderBy("position").collect()] == ["d0", "d5", "d1", "d6", "d2"]
    budgets = spark.createDataFrame(
        [(0, "spell", 30), (1, "class", 14)], "type_ord int, content_type string, budget int"
    )
    refs = refs_of(spark, {"spell": 30, "class": 14})
    picked = manifests.take_budgeted(refs, budgets, 10).orderBy("position").collect()
    assert [r["content_type"] for r in picked] == ["spell"] * 7 + ["class"] * 3
    refs = refs_of(spark, {"spell": 2, "class": 14, "other": 5})
    picked = manifests.take_budgeted(refs, budgets, 10).orderBy("position").collect()
    assert [r["content_type"] for r in picked] == ["spell"] * 2 + ["class"] * 8


def test_crawl_state(spark):
    now = F.lit(NOW)
    manifest = spark.createDataFrame(
        [(d, "g", "s", "u") for d in "abcdefg"],
        "doc_id string, game_id string, source_id string, source_url string",
    )
    old = NOW - dt.timedelta(hours=168)
    state = spark.createDataFrame(
        [(d, "g", "s", "u", "p", f"h{d}", old, seen, 200, "e", None)
         for d, seen in (("a", NOW), ("b", old), ("c", old), ("d", old))],
        "doc_id string, game_id string, source_id string, source_url string, raw_path string, "
        "content_hash string, fetched_at timestamp, checked_at timestamp, status_code int, "
        "etag string, last_modified string",
    ).withColumn(
        "content_hash",
        F.when(F.col("doc_id") == "c", F.concat(F.lit("sha256:"), F.sha2(F.lit("same"), 256)))
        .otherwise(F.col("content_hash")),
    )
    got = spark.createDataFrame(
        [("a", 200, "x", "n", None), ("b", 304, None, None, None), ("c", 200, "same", "n", None),
         ("d", 500, None, None, None), ("e", 200, "new", "n", None), ("f", 404, None, None, None)],
        "doc_id string, http_status int, text string, etag string, last_modified string",
    )
    plan = crawl.crawl_plan(manifest, state, got, now, stale_fallback=True)
    assert {r["doc_id"]: r["status"] for r in plan.collect()} == {
        "a": "cached", "b": "not_modified", "c": "unchanged", "d": "cached_stale_http_500",
        "e": "fetched", "f": "failed_http_404", "g": "to_fetch",
    }
    forced = crawl.crawl_plan(manifest, state, got, now, force_refresh=True)
    assert {r["doc_id"]: r["status"] for r in forced.collect()}["a"] == "fetched"
    merged = crawl.crawl_merge(state, plan.withColumn("raw_path", F.lit("new")), now)
    rows = {r["doc_id"]: r for r in merged.collect()}
    assert set(rows) == set("abcde")
    assert rows["b"]["status_code"] == 304 and rows["b"]["fetched_at"] == old
    assert rows["b"]["checked_at"] == NOW and rows["c"]["fetched_at"] == NOW
    assert rows["d"]["checked_at"] == old and rows["e"]["raw_path"] == "new"


def test_index_modes(spark):
    old = indexing.points(chunk_rows(
        spark, chunk(1, "A", "1", source="s1"), chunk(2, "A", "2", source="s2"),
        chunk(3, "A", "3", game="other", source="s1"),
    ))
    new = indexing.points(chunk_rows(
        spark, chunk(1, "A", "new", source="s1"), chunk(4, "A", "4", source="s1"),
    ))

    def after(**how):
        rows = indexing.rebuild(old, new, "bg3", **how).collect()
        return sorted((r["chunk_id"], r["text"]) for r in rows)

    rest = [("c2", "2"), ("c3", "3"), ("c4", "4")]
    assert after(mode="append") == [("c1", "new"), *rest]
    assert after(mode="rebuild-source") == [("c1", "new"), *rest]
    assert after(mode="rebuild-game", confirm="bg3") == [("c1", "new"), ("c3", "3"), ("c4", "4")]
    with pytest.raises(ValueError, match="confirmation"):
        after(mode="rebuild-game")
    with pytest.raises(ValueError, match="several"):
        indexing.resolve_source(old)
    with pytest.raises(ValueError, match="nothing to take in"):
        indexing.rebuild(old, new, "none")
    assert indexing.rebuild(old, new, "none", allow_empty=True).count() == 3
    vectors = spark.createDataFrame([("c1", [1.0])], "chunk_id string, embedding array<double>")
    with pytest.raises(Exception, match="no vector for the chunk c9"):
        indexing.with_vectors(chunk_rows(spark, chunk(9, "x", "y")), vectors).collect()


# ---- streams over several files --------------------------------------------


def test_limits_stream_equals_batch(spark, tmp_path):
    start = dt.datetime(2024, 1, 1, 23, 58)
    rows = [(i, i % 3, start + dt.timedelta(seconds=7 * i)) for i in range(120)]
    schema = "hit_id int, client int, ts timestamp"
    for part in range(4):
        spark.createDataFrame(rows[part * 30 : part * 30 + 30], schema).coalesce(1).write.parquet(
            str(tmp_path / "in" / f"p{part}")
        )
    whole = spark.createDataFrame(rows, schema)
    stream = (
        spark.readStream.schema(whole.schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    got = {r["hit_id"]: (r["minute_count"], r["day_count"], r["limit_name"])
           for r in jobs.limited_requests(stream, 2, 10).collect()}
    want = {r["hit_id"]: (r["minute_count"], r["day_count"], r["limit_name"])
            for r in requests.rate_limit(whole, 2, 10).collect()}
    assert got == want


def test_sessions_stream_equals_batch(spark, tmp_path):
    schema = "session_id string, turn bigint, role string, content string"
    rows = [(f"s{i % 2}", i, "user" if i % 3 else "system", f"t{i}") for i in range(90)]
    for part in range(3):
        spark.createDataFrame(rows[part::3], schema).coalesce(1).write.parquet(
            str(tmp_path / "in" / f"p{part}")
        )
    whole = spark.createDataFrame(rows, schema)
    stream = (
        spark.readStream.schema(whole.schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    got = sorted((r["session_id"], r["turn"]) for r in jobs.session_tails(stream).collect())
    want = sorted((r["session_id"], r["turn"]) for r in requests.session_tail(whole).collect())
    assert got == want


def test_index_stream_merges_and_replaces(spark, tmp_path):
    first = chunk_rows(spark, chunk(1, "A", "1"), chunk(2, "B", "2"), chunk(3, "C", "3", game="o"))
    second = chunk_rows(spark, chunk(1, "A", "new"), chunk(4, "D", "4"))
    for number, rows in enumerate((first, second)):
        rows.coalesce(1).write.parquet(str(tmp_path / "in" / f"p{number}"))

    def table(mode):
        stream = (
            spark.readStream.schema(first.schema).option("recursiveFileLookup", "true")
            .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        )
        done = jobs.index_points(stream, mode, hash_embedding(8))
        return sorted((r["chunk_id"], r["text"]) for r in done.collect())

    assert table("append") == [("c1", "new"), ("c2", "2"), ("c3", "3"), ("c4", "4")]
    assert table("rebuild-source") == [("c1", "new"), ("c2", "2"), ("c3", "3"), ("c4", "4")]


def test_the_last_of_repeated_rows_wins(spark):
    old = indexing.points(chunk_rows(spark, chunk(1, "A", "old")))
    new = indexing.points(chunk_rows(spark, chunk(1, "A", "one"), chunk(1, "A", "two")).coalesce(1))
    assert [r["text"] for r in indexing.upsert(old, new).collect()] == ["two"]


def test_samples_that_fit_keep_their_order(spark):
    refs = refs_of(spark, {"b": 2, "a": 1})
    budgets = spark.createDataFrame([(0, "a", 1)], "type_ord int, content_type string, budget int")
    for sample in (manifests.take_evenly(refs, 3), manifests.take_budgeted(refs, budgets, 3)):
        assert [r["doc_id"] for r in sample.orderBy("position").collect()] == ["d0", "d1", "d2"]


def test_late_requests_count(spark, tmp_path):
    schema = "client string, ts timestamp"
    for part, minute in enumerate((50, 0, 30)):
        rows = [("c", dt.datetime(2024, 2, 1, 10, minute))]
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = (
        spark.readStream.schema(schema).option("recursiveFileLookup", "true")
        .option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    )
    assert [r["n"] for r in jobs.request_windows(stream, "1 day").collect()] == [3]


def test_short_golden_items_meet_longer_texts(spark):
    from loreloom.plans.bindings import golden_pairs

    docs = spark.createDataFrame([(1, "x a b c d e y z".split()), (2, ["q"])], "ord int, w array<string>")
    items = spark.createDataFrame(
        [(1, "a b c d e"), (2, "b c"), (3, "z"), (4, "nope")], "item_id int, item string"
    )
    got = sorted((r["ord"], r["item_id"]) for r in golden_pairs(docs, items).collect())
    assert got == [(1, 1), (1, 2), (1, 3)]


def test_a_side_beyond_the_bound_is_not_broadcast_by_its_file_size(spark, no_broadcast):
    """Repeated texts make small files of large rows; Spark would broadcast them by the size of the files."""
    from loreloom import session

    rows = session.materialise(spark.range(200).selectExpr("id AS k", "repeat('the same text ', 100) AS t"))
    joined = session.join_small(spark.range(300).withColumnRenamed("id", "k"), rows, ["k"])
    assert joined.count() == 200
    assert "Broadcast" not in joined._jdf.queryExecution().executedPlan().toString()
