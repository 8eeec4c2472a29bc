"""Streams with state by key: session tails, request counters, an answer cache that expires.

State lives in Spark's state store (RocksDB, checkpointed with the stream) and changes by key; a batch
touches the keys it has rows for and nothing else. What arrives is cut or dealt before it is shuffled:
session turns to the last few per task, cache entries to shards with copies, so that one busy key is
several tasks. Limits by time go by the times in the rows, never by the clock, so a stream that is read
again gives the same answers. (The store's own expiry and timers go by the clock or by a watermark; the
former would keep a run over available data from ever ending, the latter would drop late rows.)
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession) -> Iterator[None]:
    """Queries started inside keep their state in RocksDB."""
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKSDB)
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(PROVIDER)
        else:
            spark.conf.set(PROVIDER, before)


def run_keyed(made: DataFrame, root: str, name: str, mode: str = "append") -> None:
    """Write what a keyed operator emits, one folder per batch, until the input is used up."""

    def process(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{root}/{name}/batch={number}")

    with rocksdb_state(made.sparkSession):
        query = (
            made.writeStream.foreachBatch(process).outputMode(mode)
            .option("checkpointLocation", f"{root}/progress/{name}")
            .trigger(availableNow=True).start()
        )
        query.awaitTermination()


def emitted(spark: SparkSession, root: str, name: str, like: DataFrame) -> DataFrame:
    """All rows written by `run_keyed`, with their batch; none if nothing has arrived yet."""
    nothing = spark.createDataFrame([], like.schema)
    nothing.write.mode("overwrite").parquet(f"{root}/{name}/batch=-1")
    return spark.read.schema(like.schema).parquet(f"{root}/{name}")


# ---- sessions --------------------------------------------------------------

TURN = "turn bigint, role string, content string"


def last_turns(turns: DataFrame, keep: int) -> DataFrame:
    """The last turns of each session within an Arrow batch: all that can matter of them."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows <= keep:
                yield batch
                continue
            order = pc.sort_indices(batch, [("session_id", "ascending"), ("turn", "descending")])
            ordered = batch.take(order)
            ids = ordered.column("session_id")
            fresh = pc.fill_null(pc.not_equal(ids.slice(1), ids.slice(0, len(ids) - 1)), True)
            start = pd.Series([True, *fresh.to_pylist()])
            place = start.groupby(start.cumsum()).cumcount()
            yield ordered.filter(pa.array((place < keep).to_numpy()))

    return turns.mapInArrow(cut, turns.schema)


class SessionRing(StatefulProcessor):
    """The last `keep` turns of a session, as a list state that never grows beyond them."""

    def __init__(self, keep: int) -> None:
        self.keep = keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.ring = handle.getListState("ring", TURN)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        held = [tuple(r) for r in self.ring.get()] if self.ring.exists() else []
        for part in rows:
            held += zip(part["turn"].tolist(), part["role"].tolist(), part["content"].tolist(), strict=True)
            held = sorted(held, key=lambda t: t[0])[-self.keep :]
        self.ring.put(held)
        turn, role, content = zip(*held, strict=True)
        yield pd.DataFrame(
            {"session_id": [key[0]] * len(held), "turn": turn, "role": role, "content": content}
        )

    def close(self) -> None:
        pass


def session_rings(turns: DataFrame, keep: int, root: str) -> DataFrame:
    """The last turns per session of a stream of session_id, turn, role, content (stored turns only).

    A batch emits the tails of its own sessions; the newest tail of a session counts.
    """
    schema = f"session_id {turns.schema['session_id'].dataType.simpleString()}, {TURN}"
    cut = last_turns(turns.select("session_id", F.col("turn").cast("bigint"), "role", "content"), keep)
    made = cut.groupBy("session_id").transformWithStateInPandas(SessionRing(keep), schema, "Update", "None")
    run_keyed(made, root, "tails", "update")
    tails = emitted(turns.sparkSession, root, "tails", made)
    newest = tails.groupBy("session_id").agg(F.max("batch").alias("batch"))
    return tails.join(newest, ["session_id", "batch"]).drop("batch")


# ---- request counters ------------------------------------------------------


class ClientCounters(StatefulProcessor):
    """Hits per minute of the clients of a shard, a packed array per client; days that are over are
    dropped. The clients of a batch are numbered together, and each costs one read and one write."""

    def __init__(self, names: list[str], grace_days: int = 1) -> None:
        self.names, self.grace = names, grace_days

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getMapState("counts", "client string", "minutes binary")

    def _known(self, clients: list[str]) -> pd.DataFrame:
        """What the state holds of some clients: place of the client, minute and hits."""
        parts = [np.empty((0, 3), dtype=np.int64)]
        if self.counts.exists():
            for at, client in enumerate(clients):
                if self.counts.containsKey((client,)):
                    held = np.frombuffer(bytes(self.counts.getValue((client,))[0]), dtype=np.int64).reshape(-1, 2)
                    parts.append(np.insert(held, 0, at, axis=1))
        return pd.DataFrame(np.concatenate(parts), columns=["client", "minute", "n"])

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        hits = pd.concat(list(rows), ignore_index=True)
        hits = hits.sort_values(["client_key", "ts", "hit_id"], kind="stable")
        codes, clients = pd.factorize(hits["client_key"])
        known = self._known(clients.tolist())
        minute = hits["ts"].to_numpy().astype("datetime64[us]").astype("int64") // 60_000_000
        place, made = np.arange(len(hits)), hits[self.names].copy()
        for name, size in (("minute_count", 1), ("day_count", 1440)):
            unit = minute // size
            fresh = np.append(True, (codes[1:] != codes[:-1]) | (unit[1:] != unit[:-1]))
            starts = np.flatnonzero(fresh)
            before = known["n"].groupby([known["client"], known["minute"] // size]).sum()
            wanted = pd.MultiIndex.from_arrays([codes[starts], unit[starts]])
            before = before.reindex(wanted, fill_value=0).to_numpy(dtype=np.int64)
            run = np.cumsum(fresh) - 1
            made[name] = place - starts[run] + 1 + before[run]
        new = pd.DataFrame({"client": codes, "minute": minute, "n": 1})
        total = pd.concat([known, new]).groupby(["client", "minute"], as_index=False)["n"].sum()
        newest = new.groupby("client")["minute"].max() // 1440
        total = total[total["minute"] // 1440 >= total["client"].map(newest) - self.grace]
        counted = np.ascontiguousarray(total[["minute", "n"]].to_numpy(dtype=np.int64))
        ends = np.searchsorted(total["client"].to_numpy(), np.arange(len(clients)), side="right")
        for client, part in zip(clients, np.split(counted, ends[:-1]), strict=True):
            self.counts.updateValue((client,), (part.tobytes(),))
        yield made

    def close(self) -> None:
        pass


def counted_hits(hits: DataFrame, root: str, grace_days: int = 1, shards: int = 1024) -> DataFrame:
    """hit_id, client, ts, minute_count, day_count for a stream of hits.

    Hits are numbered in the order (ts, hit_id) within a batch and go on from the counts of the
    batches before. Of a client, the hits of one batch are ordered in one task; the size of a batch
    (files per trigger) is the bound for that. Counts of days more than `grace_days` before the newest
    hit of a client are forgotten, so a client's state is a few days at most. Clients are dealt to
    `shards`, each of which is taken in one go.
    """
    names = ["hit_id", "client", "ts"]
    rows = hits.select(*names)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    dealt = rows.withColumn("client_key", F.to_json(F.struct("client"))).withColumn(
        "shard", F.pmod(F.xxhash64("client"), F.lit(shards)).cast("int")
    )
    made = dealt.groupBy("shard").transformWithStateInPandas(
        ClientCounters(names, grace_days), f"{schema}, minute_count bigint, day_count bigint",
        "Append", "None",
    )
    run_keyed(made, root, "counts")
    return emitted(hits.sparkSession, root, "counts", made).drop("batch")


# ---- answer cache ----------------------------------------------------------

PUT, ASK, PURGE = "put", "ask", "purge"
CACHE_EVENT = "event_id string, kind string, cache_key string, answer string, at timestamp"


class CacheShard(StatefulProcessor):
    """Entries of a shard by key: answer and time. An entry counts for `ttl` seconds."""

    def __init__(self, ttl: int) -> None:
        self.ttl = ttl

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.entries = handle.getMapState("entries", "cache_key string", "answer string, at double")

    def _expired(self, at: float, now: float) -> bool:
        return int(now) - int(at) >= self.ttl

    def _ask(self, key: str, now: float) -> str | None:
        if not self.entries.containsKey((key,)):
            return None
        answer, at = self.entries.getValue((key,))
        if self._expired(at, now):
            self.entries.removeKey((key,))
            return None
        return answer

    def _put(self, key: str, answer: str, at: float) -> None:
        if self.entries.containsKey((key,)) and self.entries.getValue((key,))[1] > at:
            return
        self.entries.updateValue((key,), (answer, at))

    def _purge(self, prefix: str, now: float) -> None:
        """Drop the keys with the prefix, and what has expired."""
        gone = [
            key for key, (_, at) in self.entries.iterator()
            if key[0].startswith(prefix) or self._expired(at, now)
        ]
        for key in gone:
            self.entries.removeKey(tuple(key))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        events = pd.concat(list(rows)).sort_values(["at_s", "turn", "event_id"], kind="stable")
        done: dict[str, list] = {"event_id": [], "cache_key": [], "answer": []}
        for event, kind, name, answer, at in zip(
            *[events[c].tolist() for c in ("event_id", "kind", "cache_key", "answer", "at_s")], strict=True
        ):
            if kind == PUT:
                self._put(name, answer, at)
            elif kind == PURGE:
                self._purge(name, at)
            else:
                found = self._ask(name, at)
                for column, value in zip(done, (event, name, found), strict=True):
                    done[column].append(value)
        yield pd.DataFrame(done, dtype=object)

    def close(self) -> None:
        pass


def cache_answers(
    events: DataFrame, ttl: int, root: str, shards: int = 64, copies: int = 4
) -> DataFrame:
    """event_id, cache_key, answer, cache_status for the questions in a stream of cache events.

    An event is a `put` of an answer under a key, an `ask` for a key or a `purge` of all keys with a
    prefix (in cache_key). Events of a batch are taken in the order of their times, at the same time
    puts before purges before questions. An entry lives for `ttl` seconds from its time; the newest
    counts. Expired entries go when they are asked for and with the next purge. Keys are dealt to shards; puts and purges go to all copies of a shard, questions to one
    of them, so a key that everybody asks for is spread over `copies` tasks.
    """
    spark = events.sparkSession
    one = F.pmod(F.xxhash64("cache_key"), F.lit(shards)) * copies
    to_all = F.sequence(F.lit(0), F.lit(shards * copies - 1))
    own = F.transform(F.sequence(F.lit(0), F.lit(copies - 1)), lambda c: (one + c).cast("int"))
    picked = F.array((one + F.pmod(F.xxhash64("event_id"), F.lit(copies))).cast("int"))
    kind = F.col("kind")
    dealt = events.filter(F.col("cache_key").isNotNull() & F.col("at").isNotNull()).select(
        "event_id", "kind", "cache_key", "answer", F.col("at").cast("double").alias("at_s"),
        F.when(kind == PUT, 0).when(kind == PURGE, 1).otherwise(2).alias("turn"),
        F.explode(F.when(kind == PURGE, to_all).when(kind == PUT, own).otherwise(picked)).alias("shard"),
    )
    made = dealt.groupBy("shard").transformWithStateInPandas(
        CacheShard(ttl), "event_id string, cache_key string, answer string", "Append", "None"
    )
    run_keyed(made, root, "answers")
    status = F.when(F.col("answer").isNotNull(), "hit").otherwise("miss")
    return emitted(spark, root, "answers", made).drop("batch").withColumn("cache_status", status)
