"""Streams over several files, in any order, cut short and run again, against their batch forms."""

import datetime as dt
import itertools
import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from loreloom.functions.embedding import hash_embedding
from loreloom.operators import crawl, lexical, requests
from loreloom.plans.catalog import QUERIES
from loreloom.streaming import jobs, slicelog, state

from test_search import chunk
from test_tables import chunk_rows


def stream_of(spark, path, schema, files=1, arrival=False):
    return jobs.file_stream(spark, f"{path}/*", "*.parquet", schema, files, arrival)


def deliver(path, *frames):
    """One file per frame, in the order they are to arrive."""
    for number, rows in enumerate(frames):
        rows.coalesce(1).write.parquet(f"{path}/p{number:02}")


def index_rows(index):
    terms = {(r["chunk_id"], r["length"], t["term"], t["tf"]) for r in index.terms.collect() for t in r["terms"]}
    df = {(r["term"], r["df"]) for r in index.document_frequencies().collect()}
    return terms, df, index.total, round(index.average_length, 9)


VERSIONS = [
    [(1, "the owl sleeps"), (2, "an owl owl flies"), (3, "a red door")],
    [(2, "the fox runs"), (4, "owl and fox")],
    [(1, "nothing left")],
    [(5, "door door"), (1, "the owl wakes")],
]


def delivered(spark, sources=("s1", "s2")):
    return [
        chunk_rows(spark, *[chunk(i, f"T{i}", text, source=sources[i % 2]) for i, text in rows])
        for rows in VERSIONS
    ]


def test_postings_equal_a_new_index(spark, tmp_path, monkeypatch):
    """Appends, changes and more commits than a base holds; the index equals that of the last versions."""
    monkeypatch.setattr(slicelog, "FOLD", 2)
    frames = delivered(spark)
    deliver(tmp_path / "in", *frames)
    stream = stream_of(spark, tmp_path / "in", frames[0].schema)
    index = jobs.index_postings(stream, root=str(tmp_path / "index"), run="r")
    final = dict(itertools.chain(*VERSIONS))
    chunks = chunk_rows(spark, *[chunk(i, f"T{i}", t, source=("s1", "s2")[i % 2]) for i, t in final.items()])
    want = lexical.build_index(chunks)
    assert index_rows(index) == index_rows(want)
    asked = spark.createDataFrame([(1, "bg3", "owl door"), (2, "bg3", "fox")], "query_id int, game_id string, query string")
    columns = ["query_id", "chunk_id", "bm25_score", "rank"]
    assert sorted(lexical.search(index, asked).select(*columns).collect()) == sorted(
        lexical.search(want, asked).select(*columns).collect()
    )
    # A run that is named again has nothing new to do.
    again = jobs.index_postings(stream_of(spark, tmp_path / "in", frames[0].schema), root=str(tmp_path / "index"), run="r")
    assert index_rows(again) == index_rows(want)


def test_a_source_is_rebuilt_once_per_run(spark, tmp_path):
    """The first batch of a run replaces a slice, later ones add to it; the next run replaces it again."""
    first = [chunk_rows(spark, chunk(1, "A", "old", source="s1"), chunk(9, "Z", "other", source="s2"))]
    second = [
        chunk_rows(spark, chunk(2, "B", "two", source="s1")),
        chunk_rows(spark, chunk(3, "C", "three", source="s1")),
        chunk_rows(spark, chunk(2, "B", "two again", source="s1")),
    ]
    third = [chunk_rows(spark, chunk(4, "D", "four", source="s1"))]
    root, seen = str(tmp_path / "index"), []
    for number, frames in enumerate((first, second, third)):
        deliver(tmp_path / f"in{number}", *frames)
        stream = stream_of(spark, tmp_path / f"in{number}", frames[0].schema)
        jobs.index_postings(stream, "rebuild-source", str(tmp_path / "postings"), f"run{number}")
        points = jobs.index_points(stream_of(spark, tmp_path / f"in{number}", frames[0].schema),
                                   "rebuild-source", hash_embedding(8), root, f"run{number}")
        seen.append(sorted((r["chunk_id"], r["text"]) for r in points.collect()))
    assert seen == [
        [("c1", "old"), ("c9", "other")],
        [("c2", "two again"), ("c3", "three"), ("c9", "other")],
        [("c4", "four"), ("c9", "other")],
    ]
    want = lexical.build_index(chunk_rows(spark, chunk(4, "D", "four", source="s1"), chunk(9, "Z", "other", source="s2")))
    assert index_rows(jobs.read_postings(spark, str(tmp_path / "postings"))) == index_rows(want)
    with pytest.raises(ValueError, match="append or rebuild"):
        jobs.index_points(stream, "rebuild-game")


def test_a_commit_that_is_repeated_changes_nothing(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(slicelog, "FOLD", 3)
    shape = "key string, game_id string, source_id string, v int"
    frame = lambda *rows: spark.createDataFrame(list(rows), shape)
    commits = [
        (frame(("a", "g", "s", 1), ("b", "g", "s", 1), ("c", "g", "t", 1)), "one", 0, False),
        (frame(("a", "g", "s", 2)), "two", 1, True),
        (frame(("d", "g", "s", 2)), "two", 1, True),
        (frame(("c", "g", "u", 3), ("d", "g", "s", 3)), "three", 3, False),
    ]
    want = [{"a1", "b1", "c1"}, {"a2", "c1"}, {"a2", "c1", "d2"}, {"a2", "c3", "d3"}]
    count = ("v int, n bigint", ["v"], ["n"], lambda new, old: new.select("v", F.lit(1).cast("long").alias("n"))
             .unionByName(old.select("v", F.lit(-1).cast("long").alias("n"))).groupBy("v").agg(F.sum("n").alias("n")))
    log = lambda: slicelog.SliceLog(spark, str(tmp_path / "log"), "key", frame().schema, {"count": count})
    for number, (rows, run, first, replace) in enumerate(commits):
        for _ in range(2):
            log().commit(number, rows, run, first, replace)
            living = log().live().collect()
            assert {f"{r['key']}{r['v']}" for r in living} == want[number]
            assert {r["v"]: r["n"] for r in log().total("count").collect()} == Counter(r["v"] for r in living)
    assert (log().open_run("two"), log().open_run("four")) == (1, 4)


def test_the_newest_delivery_counts(spark, tmp_path):
    frames = [chunk_rows(spark, chunk(1, "A", "first")), chunk_rows(spark, chunk(1, "A", "second"), chunk(2, "B", "x"))]
    deliver(tmp_path / "in", *frames)
    stream = stream_of(spark, tmp_path / "in", frames[0].schema, files=10, arrival=True)
    points = jobs.index_points(stream)
    assert "arrival" not in points.columns
    assert sorted((r["chunk_id"], r["text"]) for r in points.collect()) == [("c1", "second"), ("c2", "x")]


def test_empty_sources(spark, tmp_path):
    folder = tmp_path / "in" / "p0"
    folder.mkdir(parents=True)
    shape = lambda ddl: spark.createDataFrame([], ddl).schema
    hits = stream_of(spark, tmp_path / "in", shape("hit_id int, client int, ts timestamp"))
    assert jobs.limited_requests(hits).collect() == []
    turns = stream_of(spark, tmp_path / "in", shape("session_id string, turn bigint, role string, content string"))
    assert jobs.session_tails(turns).collect() == []
    assert jobs.cached_answers(stream_of(spark, tmp_path / "in", shape(state.CACHE_EVENT))).collect() == []
    chunks = chunk_rows(spark, chunk(1, "A", "x")).schema
    assert jobs.index_points(stream_of(spark, tmp_path / "in", chunks)).collect() == []
    assert jobs.index_postings(stream_of(spark, tmp_path / "in", chunks)).total == 0


def test_limits_go_on_from_batch_to_batch(spark, tmp_path):
    """In order of time the numbers are those of the batch form; in any order each number comes once."""
    start = dt.datetime(2024, 1, 1, 23, 58)
    rows = [(i, i % 3 if i % 4 else 0, start + dt.timedelta(seconds=7 * (i // 2))) for i in range(160)]
    schema = "hit_id int, client int, ts timestamp"
    parts = [rows[k : k + 40] for k in range(0, 160, 40)]
    want = {r["hit_id"]: (r["minute_count"], r["day_count"], r["limit_name"], r["retry_after"])
            for r in requests.rate_limit(spark.createDataFrame(rows, schema), 2, 10).collect()}
    for name, order in (("sorted", [0, 1, 2, 3]), ("mixed", [2, 0, 3, 1])):
        deliver(tmp_path / name, *[spark.createDataFrame(parts[k], schema) for k in order])
        got = jobs.limited_requests(stream_of(spark, tmp_path / name, spark.createDataFrame([], schema).schema), 2, 10)
        numbers = {r["hit_id"]: (r["minute_count"], r["day_count"], r["limit_name"], r["retry_after"]) for r in got.collect()}
        if name == "sorted":
            assert numbers == want
        else:
            minute = lambda made: Counter((rows[i][1], rows[i][2].replace(second=0), n[0]) for i, n in made.items())
            assert minute(numbers) == minute(want)


def test_closed_days_are_forgotten(spark, tmp_path):
    schema = "hit_id int, client int, ts timestamp"
    days = [dt.datetime(2024, 1, 1), dt.datetime(2024, 1, 5), dt.datetime(2024, 1, 1, 1), dt.datetime(2024, 1, 4)]
    deliver(tmp_path / "in", *[spark.createDataFrame([(i, 1, ts)], schema) for i, ts in enumerate(days)])
    got = jobs.limited_requests(stream_of(spark, tmp_path / "in", spark.createDataFrame([], schema).schema))
    # The count of 1 January is gone once a hit of the 5th has come; the 4th is still open.
    assert {r["hit_id"]: r["day_count"] for r in got.collect()} == {0: 1, 1: 1, 2: 1, 3: 1}


def test_session_rings_equal_the_batch_form(spark, tmp_path):
    """Turns out of order over several files, unknown roles, empty turns and a session of most rows."""
    chance = random.Random(4)
    schema = "session_id string, turn bigint, role string, content string"
    rows = [(f"s{i % 4 if i % 5 == 0 else 0}", i, chance.choice(["user", "assistant", "system"]),
             chance.choice(["", None, f"t{i}", f"u{i}"])) for i in range(400)]
    rows.append((None, 1, "user", "x"))
    whole = spark.createDataFrame(rows, schema)
    chance.shuffle(rows)
    deliver(tmp_path / "in", *[spark.createDataFrame(rows[k::4], schema) for k in range(4)])
    got = jobs.session_tails(stream_of(spark, tmp_path / "in", whole.schema), 6)
    order = lambda df: sorted((r["session_id"], r["turn"], r["role"], r["content"]) for r in df.collect())
    assert order(got) == order(requests.session_tail(whole, 6))


def brute_cache(events, ttl):
    held, out = {}, {}
    rank = {"put": 0, "purge": 1, "ask": 2}
    for batch in events:
        for event, kind, key, answer, at in sorted(batch, key=lambda e: (e[4], rank[e[1]], e[0])):
            if kind == "put":
                if key not in held or held[key][1] <= at:
                    held[key] = (answer, at)
            elif kind == "purge":
                held = {k: v for k, v in held.items() if not k.startswith(key)}
            else:
                live = key in held and (at - held[key][1]).total_seconds() < ttl
                out[event] = held[key][0] if live else None
    return out


def test_cache_expires_and_is_purged(spark, tmp_path):
    chance = random.Random(8)
    start, batches = dt.datetime(2024, 1, 1), []
    for batch in range(4):
        events = []
        for i in range(60):
            at = start + dt.timedelta(seconds=batch * 100 + chance.randrange(100))
            kind = chance.choice(["put", "ask", "ask", "ask"]) if i else "purge"
            key = f"answers:{chance.choice('ab')}:{chance.randrange(4)}" if i else f"answers:{chance.choice('ab')}"
            events.append((f"e{batch}-{i}", kind, key, f"v{batch}-{i}" if kind == "put" else None, at))
        batches.append(events)
    deliver(tmp_path / "in", *[spark.createDataFrame(b, state.CACHE_EVENT) for b in batches])
    schema = spark.createDataFrame([], state.CACHE_EVENT).schema
    got = jobs.cached_answers(stream_of(spark, tmp_path / "in", schema), 70).collect()
    want = brute_cache(batches, 70)
    assert {r["event_id"]: r["answer"] for r in got} == want
    status = defaultdict(set)
    for r in got:
        status[r["cache_status"]].add(r["answer"] is None)
    assert status == {"hit": {False}, "miss": {True}}


@pytest.mark.parametrize("how", [{}, {"force_refresh": True}, {"ttl_hours": 1}, {"stale_fallback": True}])
def test_crawl_stream_takes_the_options_of_a_crawl(spark, tmp_path, how):
    """Batches of fetch results one after another are the batch plan and merge, applied in turn."""
    old, now = dt.datetime(2024, 1, 31, 12), dt.datetime(2024, 2, 1)
    manifest = spark.createDataFrame([(d, "g", "s", f"u/{d}", d) for d in "abcd"],
                                     "doc_id string, game_id string, source_id string, source_url string, title string")
    known = spark.createDataFrame(
        [(d, "g", "s", f"u/{d}", f"old/{d}", "sha256:x", old, old, 200, "e", None) for d in "abc"],
        "doc_id string, game_id string, source_id string, source_url string, raw_path string, content_hash string, "
        "fetched_at timestamp, checked_at timestamp, status_code int, etag string, last_modified string",
    )
    shape = "doc_id string, http_status int, text string, etag string, last_modified string"
    fetched = [
        spark.createDataFrame([("a", 200, "new", "n", None), ("b", 500, None, None, None)], shape),
        spark.createDataFrame([("c", 304, None, None, None), ("d", 200, "first", "m", None), ("a", 200, "newer", "o", None)], shape),
    ]
    deliver(tmp_path / "in", *fetched)
    stream = stream_of(spark, tmp_path / "in", fetched[0].schema)
    got = jobs.crawl_states(stream, manifest, known, F.lit(now), "raw", **how)
    want = known
    for landed in fetched:
        plan = crawl.crawl_plan(manifest.join(landed.select("doc_id"), "doc_id", "left_semi"), want, landed, F.lit(now), **how)
        path = crawl.raw_path("raw", F.col("game_id"), F.col("source_id"), F.col("doc_id"))
        want = crawl.crawl_merge(want, plan.withColumn("raw_path", path), F.lit(now))
    assert sorted(got.select(*known.columns).collect()) == sorted(want.select(*known.columns).collect())


def test_streams_of_a_table_in_several_files(spark, data, tmp_path):
    """A table may be a folder of files: the streams read all of them, as the batch queries do."""
    for name in ("documents", "labels", "conversations", "events"):
        spark.read.parquet(f"{data}/{name}.parquet").repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
    for name in ("stream_sessions", "stream_crawl", "stream_index", "stream_windows"):
        got, want = (sorted(map(str, QUERIES[name](spark, f).collect())) for f in (str(tmp_path), data))
        assert got == want and want, name


def test_a_stream_without_files_leaves_the_state_as_it_is(spark, tmp_path):
    (tmp_path / "in").mkdir()
    stream = jobs.file_stream(spark, str(tmp_path / "in"), "*.parquet", spark.createDataFrame([], "id bigint").schema)
    got = jobs.versioned(stream, lambda old, batch: batch if old is None else old.unionByName(batch), "none")
    assert got.count() == 0


def test_counters_of_a_shard_take_one_write_per_client(spark, tmp_path):
    """All clients in one shard, over batches, with a client that is null: the numbers of the batch form."""
    import pandas as pd

    from loreloom.streaming import state

    writes = []

    class Held(dict):
        def exists(self):
            return bool(self)

        containsKey, getValue = dict.__contains__, dict.get

        def updateValue(self, key, value):
            writes.append(key)
            self[key] = value

    handle = type("Handle", (), {"getMapState": lambda self, *a: Held()})()
    counters = state.ClientCounters(["hit_id", "client", "ts"])
    counters.init(handle)
    start = dt.datetime(2024, 1, 1, 23, 58)
    rows = pd.DataFrame({"hit_id": range(400), "client": [i % 4 for i in range(400)]})
    rows["ts"] = start + pd.to_timedelta(rows["hit_id"] * 2, unit="s")
    rows["client_key"] = rows["client"].astype(str)
    parts = [rows.iloc[:150].sample(frac=1, random_state=1), rows.iloc[150:].sample(frac=1, random_state=2)]
    got = pd.concat([d for p in parts for d in counters.handleInputRows((0,), iter([p]), None)]).sort_values("hit_id")
    for name, unit in (("minute_count", "min"), ("day_count", "D")):
        want = rows.groupby(["client", rows["ts"].dt.floor(unit)]).cumcount() + 1
        assert got[name].tolist() == want.tolist()
    assert len(writes) == 2 * 4
    schema = "hit_id int, client int, ts timestamp"
    deliver(tmp_path / "in", *[spark.createDataFrame([(i, None, start), (i + 9, 1, start)], schema) for i in range(2)])
    stream = stream_of(spark, tmp_path / "in", spark.createDataFrame([], schema).schema)
    one = state.counted_hits(stream, str(tmp_path / "root"), shards=1).collect()
    assert sorted((str(r["client"]), r["day_count"]) for r in one) == [("1", 1), ("1", 2), ("None", 1), ("None", 2)]


def test_rows_that_came_once_are_not_shuffled(spark):
    """Only keys and places are aggregated; the join brings the few repeated keys to the rows."""
    from loreloom.streaming.slicelog import newest_delivery

    rows = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y"), ("a", 3, "z")], "k string, arrival int, text string")
    made = newest_delivery(rows, "k", "arrival")
    assert sorted(map(tuple, made.collect())) == [("a", 3, "z"), ("b", 2, "y")]
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "hashpartitioning" not in plan
    twice = rows.unionByName(spark.createDataFrame([("b", 2, "y"), (None, 9, "n")], rows.schema))
    assert sorted(map(tuple, newest_delivery(twice, "k", "arrival").collect())) == [("a", 3, "z"), ("b", 2, "y")]
