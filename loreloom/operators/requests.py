"""Request tables: guard, tenant routing, session context, tools, prompts, answer cache."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loreloom.functions import fixed
from loreloom.functions import text as tx
from loreloom.operators.entities import exact_lookup, list_entities, mentions
from loreloom.operators.numbering import running_number
from loreloom.operators.rewrite import rewrite_queries
from loreloom.operators.topk import top_k
from loreloom.session import join_small

CONTEXT_TYPE = (
    "array<struct<rank:int,title:string,section:string,content_type:string,source_id:string,"
    "source_url:string,text:string,score:double,rerank_score:double,retrieval_source:string,"
    "retrieval_sources:array<string>,rerank_reasons:array<string>,"
    "source_policy_reasons:array<string>>>"
)


# ---- guard and routing -----------------------------------------------------


def guard(requests: DataFrame, message: str = "message") -> DataFrame:
    """Add allowed and reason; prompt extraction is checked before secrets."""
    low = tx.fold(F.col(message))
    reason = F.when(
        tx.contains_any(low, fixed.PROMPT_EXTRACTION_MARKERS), "system_prompt_extraction"
    ).when(tx.contains_any(low, fixed.SECRET_MARKERS), "secret_exfiltration")
    return requests.withColumn("reason", reason).withColumn("allowed", F.col("reason").isNull())


def blocked_answer(reason: Column) -> Column:
    return F.when(reason == "secret_exfiltration", fixed.BLOCKED_SECRET_ANSWER).otherwise(
        fixed.BLOCKED_PROMPT_ANSWER
    )


def blocked_responses(guarded: DataFrame) -> DataFrame:
    """Fixed answers with empty sources for the requests that were not allowed."""
    none = F.array().cast("array<string>")
    return guarded.filter(~F.col("allowed")).withColumns(
        {
            "answer": blocked_answer(F.col("reason")),
            "sources": none, "tool_calls": none, "retrieved_chunks": none,
        }
    )


def route_tenant(
    requests: DataFrame, tenants: list[str], message: str = "message",
    explicit: str = "explicit_game_id", default: str = fixed.DEFAULT_TENANT,
) -> DataFrame:
    """Add game_id, method, confidence and routing_reason."""
    wanted = F.col(explicit)
    given = wanted.isNotNull() & ~tx.fold(wanted).isin(fixed.AUTO_TENANT_VALUES)
    known = wanted.isin(tenants)
    low = tx.fold(F.col(message))

    def choice(game: Column, method: str, confidence: float, reason: Column) -> Column:
        return F.struct(
            game.alias("game_id"), F.lit(method).alias("method"),
            F.lit(confidence).alias("confidence"), reason.alias("routing_reason"),
        )

    routed = F.when(
        given & known, choice(wanted, "explicit", 1.0, F.lit("User or UI provided game_id."))
    ).when(
        given,
        choice(
            F.lit(default), "invalid_explicit", 0.0,
            F.concat(F.lit("Unknown explicit game_id: "), wanted, F.lit(".")),
        ),
    )
    for tenant, markers, reason in fixed.TENANT_MARKERS:
        routed = routed.when(
            tx.contains_any(low, markers), choice(F.lit(tenant), "keyword", 0.7, F.lit(reason))
        )
    routed = routed.otherwise(
        choice(F.lit(default), "default", 0.0, F.lit("No reliable game signal found."))
    )
    kept = [c for c in requests.columns if c not in ("game_id",)]
    return requests.select(*kept, routed.alias("__r")).select(*kept, "__r.*")


# ---- sessions --------------------------------------------------------------


def stored_turns(turns: DataFrame) -> DataFrame:
    """Turns a session store accepts: a session, a known role and some content.

    A row with another role is an error in the caller; here it is left out.
    """
    return turns.filter(
        F.col("session_id").isNotNull() & F.col("role").isin(fixed.SESSION_ROLES)
        & F.col("content").isNotNull() & (F.col("content") != "")
    )


def session_tail(turns: DataFrame, keep: int = fixed.SESSION_TURNS) -> DataFrame:
    """The last turns of each session, oldest first as `position`."""
    last = top_k(stored_turns(turns), ["session_id"], [F.desc("turn")], keep, "__back")
    order = Window.partitionBy("session_id").orderBy(F.desc("__back"))
    return last.withColumn("position", F.row_number().over(order)).drop("__back")


def memory_context(
    turns: DataFrame, keep: int = fixed.SESSION_TURNS, block: int = 1024
) -> DataFrame:
    """User turns with memory_context and search_query.

    The context of a follow-up is the last two user turns among the `keep` turns before it. A
    session is cut into blocks that overlap by `keep` turns, so a long session is no single task.
    """
    numbered = running_number(
        stored_turns(turns), ["session_id"], ["turn"],
        F.floor(F.col("turn") / block).cast("long"), "__no",
    )
    own = F.floor((F.col("__no") - 1) / block).cast("long")
    late = F.pmod(F.col("__no") - 1, F.lit(block)) >= block - keep
    spread = numbered.withColumn(
        "__b", F.explode(F.when(late, F.array(own, own + 1)).otherwise(F.array(own)))
    ).withColumn("__own", F.col("__b") == own)
    before = Window.partitionBy("session_id", "__b").orderBy("__no").rowsBetween(-keep, -1)
    content = tx.strip(F.col("content"))
    recent = F.collect_list(F.when((F.col("role") == "user") & (content != ""), content)).over(
        before
    )
    staged = spread.withColumn("__recent", recent).filter(
        F.col("__own") & (F.col("role") == "user")
    )
    last_two = F.when(
        F.size("__recent") > 2, F.slice(F.col("__recent"), -2, 2)
    ).otherwise(F.col("__recent"))
    context = F.when(
        tx.is_follow_up(F.col("content")), F.array_join(last_two, " | ")
    ).otherwise("")
    staged = staged.withColumn("memory_context", context)
    return staged.withColumn(
        "search_query", search_query(F.col("content"), F.col("memory_context"))
    ).select("session_id", "turn", "content", "memory_context", "search_query")


def search_query(query: Column, context: Column) -> Column:
    return F.when(context == "", query).otherwise(
        F.concat(
            F.lit("Previous user context: "), context, F.lit("\nFollow-up question: "), query
        )
    )


# ---- tools -----------------------------------------------------------------


def tool_rules(spark: SparkSession, rules: list[dict] | None = None) -> DataFrame:
    """Tool rules as a table; `ord` is the order in which they are tried."""
    return spark.createDataFrame(
        rules or fixed.TOOL_RULES,
        "ord int, game_id string, name string, intent string, entity_content_type string, "
        "min_entities int, limit int, trigger_terms array<string>, argument string",
    )


def select_tools(
    requests: DataFrame, rules: list[dict] | None = None, entities: DataFrame | None = None,
    fix_names: bool = True,
) -> DataFrame:
    """query_id, game_id, query to one row each with tool (null for none) and its arguments.

    The triggers are looked for in the query and its rewritten form; `fix_names` lets the
    rewriting respell entity names.
    """
    spark = requests.sparkSession
    rules = rules or fixed.TOOL_RULES
    asked = rewrite_queries(
        requests.select("query_id", "game_id", "query"), entities if fix_names else None
    )
    same = F.array_join(tx.tokens(F.col("query")), " ") == F.array_join(
        tx.tokens(F.col("retrieval_query")), " "
    )
    asked = asked.select(
        "query_id", "game_id", "query",
        F.when(same, F.col("query"))
        .otherwise(F.concat_ws(" ", "query", "retrieval_query"))
        .alias("__text"),
    )
    low = tx.fold(F.col("__text"))
    compared = tx.has_word(F.col("__text"), fixed.COMPARISON_TOOL_WORDS)
    triggered = F.exists("trigger_terms", lambda t: F.contains(low, tx.fold(t)))
    offers = asked.join(F.broadcast(tool_rules(spark, rules)), "game_id").filter(
        F.when(F.col("intent") == "comparison", compared)
        .when(F.col("intent").isin("list", "hint"), triggered)
        .otherwise(F.lit(False))
    )
    compare = offers.filter(F.col("intent") == "comparison")
    if entities is None:
        named = compare.withColumn("names", F.array().cast("array<string>")).filter(
            F.col("min_entities") <= 0
        )
    else:
        texts = compare.select("query_id", "game_id", "ord", "entity_content_type", "__text")
        found = mentions(
            entities,
            texts.select(
                F.struct("query_id", "ord", "entity_content_type").alias("text_id"), "game_id",
                F.col("__text").alias("text"),
            ),
        ).filter(
            F.col("text_id.entity_content_type").isNull()
            | (F.col("content_type") == F.col("text_id.entity_content_type"))
        )
        first = (
            found.groupBy("text_id")
            .agg(
                F.count(F.lit(1)).alias("n"),
                F.sort_array(
                    F.collect_list(F.struct("position", "canonical_name"))
                ).alias("hits"),
            )
            .select(
                F.col("text_id.query_id").alias("query_id"), F.col("text_id.ord").alias("ord"),
                "n", F.transform("hits", lambda h: h["canonical_name"]).alias("names"),
            )
        )
        named = (
            compare.join(first, ["query_id", "ord"], "left")
            .filter(F.coalesce("n", F.lit(0)) >= F.col("min_entities"))
            .drop("n")
        )
    ready = named.unionByName(
        offers.filter(F.col("intent") != "comparison").withColumn(
            "names", F.lit(None).cast("array<string>")
        )
    )
    topic = tx.squeeze(F.col("__text"))
    topic = F.when(
        F.length(topic) > fixed.HINT_TOPIC_CHARS,
        F.rtrim(F.substring(topic, 1, fixed.HINT_TOPIC_CHARS)),
    ).otherwise(topic)
    limit = F.col("limit").cast("string")
    prefix = F.coalesce("argument", F.lit("entity"))
    arguments = (
        F.when(
            F.col("intent") == "comparison",
            F.map_from_arrays(
                F.array(F.concat(prefix, F.lit("_a")), F.concat(prefix, F.lit("_b")),
                        F.lit("limit")),
                F.array(F.get("names", F.lit(0)), F.get("names", F.lit(1)), limit),
            ),
        )
        .when(
            F.col("intent") == "hint",
            F.map_from_arrays(F.array(F.lit("topic"), F.lit("limit")), F.array(topic, limit)),
        )
        .otherwise(F.map_from_arrays(F.array(F.lit("limit")), F.array(limit)))
    )
    chosen = (
        ready.withColumn("arguments", arguments)
        .groupBy("query_id")
        .agg(
            F.min_by(
                F.struct(F.col("name").alias("tool"), "intent", "arguments"), F.col("ord")
            ).alias("t")
        )
        .select("query_id", "t.tool", "t.intent", "t.arguments")
    )
    return asked.drop("__text").join(chosen, "query_id", "left")


def tool_queries(selected: DataFrame) -> DataFrame:
    """The search each chosen tool runs: query_id, game_id, query."""
    a, b = F.get(F.map_values("arguments"), F.lit(0)), F.get(F.map_values("arguments"), F.lit(1))
    text = F.when(
        F.col("intent") == "comparison",
        F.concat(F.lit("Compare "), a, F.lit(" and "), b, F.lit(" damage range saves scaling")),
    ).when(
        F.col("intent") == "hint",
        F.concat(F.lit("Blue Prince puzzle hint "), F.col("arguments")["topic"]),
    )
    return selected.select("query_id", "game_id", text.alias("query")).filter(
        F.col("query").isNotNull()
    )


def listing_evidence(selected: DataFrame, entities: DataFrame, rules: list[dict] | None = None):
    """Evidence rows of the list tools: the entities of the wanted type, up to the limit."""
    rules = rules or fixed.TOOL_RULES
    parts = []
    for rule in rules:
        if rule["intent"] != "list":
            continue
        listed = list_entities(
            entities, rule["game_id"], rule["entity_content_type"], rule["limit"]
        ).select(
            F.lit(rule["name"]).alias("tool"),
            F.col("position").alias("rank"),
            F.col("canonical_name").alias("title"),
            F.lit("Entity registry").alias("section"),
            "content_type", "source_url",
            F.concat(
                F.col("canonical_name"),
                F.lit(" is listed as a Baldur's Gate 3 character or companion entity."),
            ).alias("text"),
        )
        parts.append(listed)
    evidence = parts[0]
    for more in parts[1:]:
        evidence = evidence.unionByName(more)
    return join_small(selected.select("query_id", "game_id", "tool"), evidence, ["tool"])


def compared_entities(selected: DataFrame, entities: DataFrame) -> DataFrame:
    """What a comparison tool knows of the things it compares: query_id, tool, argument, name and the
    entity of that name; without one its columns are null."""
    named = selected.filter(F.col("intent") == "comparison").select(
        "query_id", "game_id", "tool", F.explode("arguments").alias("argument", "name")
    )
    return exact_lookup(entities, named.filter(F.col("argument") != "limit"))


# ---- context, prompts and traces -------------------------------------------


def context_lists(results: DataFrame) -> DataFrame:
    """One row per query with its ranked results as an array (at most the search limit long)."""
    fields = {
        "rank": "int", "title": "string", "section": "string", "content_type": "string",
        "source_id": "string", "source_url": "string", "text": "string", "score": "double",
        "rerank_score": "double", "retrieval_source": "string",
        "retrieval_sources": "array<string>", "rerank_reasons": "array<string>",
        "source_policy_reasons": "array<string>",
    }
    item = F.struct(
        *[
            (F.col(n) if n in results.columns else F.lit(None)).cast(t).alias(n)
            for n, t in fields.items()
        ]
    )
    return results.groupBy("query_id").agg(F.sort_array(F.collect_list(item)).alias("context"))


def prompt(game_id: Column, question: Column, context: Column) -> Column:
    blocks = F.transform(
        context,
        lambda c: F.concat(
            F.lit("["), c["rank"].cast("string"), F.lit("] "), c["title"], F.lit(" / "),
            c["section"], F.lit(" / "), c["content_type"], F.lit("\n"),
            F.coalesce(c["text"], F.lit("")),
        ),
    )
    return F.concat(
        F.lit("Game: "), game_id, F.lit("\nQuestion: "), question, F.lit("\n\n"),
        F.lit(fixed.PROMPT_GUARD_LINE + "\nRetrieved context:\n"),
        F.array_join(blocks, "\n\n"), F.lit("\n\n" + fixed.PROMPT_TAIL),
    )


def citations(context: Column) -> Column:
    """The sources of an answer, numbered as in the prompt."""
    return F.transform(
        context,
        lambda c: F.struct(
            c["rank"].alias("id"), c["title"].alias("title"), c["section"].alias("section"),
            c["content_type"].alias("content_type"), c["source_url"].alias("url"),
            c["score"].alias("score"), c["rerank_score"].alias("rerank_score"),
        ),
    )


def trace_items(context: Column) -> Column:
    return F.transform(
        context,
        lambda c: F.struct(
            *[
                c[n].alias(n)
                for n in (
                    "title", "section", "source_id", "retrieval_source", "retrieval_sources",
                    "score", "rerank_score", "rerank_reasons", "source_policy_reasons",
                )
            ]
        ),
    )


def source_mix(results: DataFrame) -> DataFrame:
    """query_id and how many results each source gave, as a map."""
    return (
        results.withColumn("__s", F.coalesce(F.nullif("source_id", F.lit("")), F.lit("unknown")))
        .groupBy("query_id", "__s")
        .agg(F.count(F.lit(1)).cast("int").alias("__n"))
        .groupBy("query_id")
        .agg(
            F.map_from_entries(F.sort_array(F.collect_list(F.struct("__s", "__n")))).alias(
                "source_mix"
            )
        )
    )


def policy_reasons(context: Column) -> Column:
    """Distinct policy reasons in first-seen order."""
    return F.array_distinct(
        F.flatten(
            F.transform(
                context,
                lambda c: F.coalesce(
                    c["source_policy_reasons"], F.array().cast("array<string>")
                ),
            )
        )
    )


# ---- answer cache ----------------------------------------------------------


def cache_key(
    question: Column, game_id: Column, retrieval_query: Column, context: Column,
    provider: str = "unknown", model: str = "unknown", prefix: str = "answers:v1",
) -> Column:
    """Key of an answer: digest of the sorted JSON of everything the answer depends on."""
    fingerprints = F.transform(
        context,
        lambda c: F.concat_ws(
            ":",
            F.coalesce(c["title"], F.lit("")), F.coalesce(c["section"], F.lit("")),
            F.coalesce(c["source_url"], F.lit("")),
            F.sha2(F.coalesce(c["text"], F.lit("")), 256),
        ),
    )
    payload = F.concat(
        F.lit('{"chunk_fingerprints": ['),
        F.array_join(F.transform(fingerprints, _json_string), ", "),
        F.lit('], "game_id": '), _json_string(game_id),
        F.lit(', "model": '), _json_string(F.lit(model)),
        F.lit(', "prompt_version": '), _json_string(F.lit(fixed.PROMPT_VERSION)),
        F.lit(', "provider": '), _json_string(F.lit(provider)),
        F.lit(', "question": '), _json_string(question),
        F.lit(', "retrieval_query": '), _json_string(retrieval_query),
        F.lit(', "temperature": 0}'),
    )
    return F.concat(F.lit(prefix + ":"), F.sha2(payload, 256))


def _json_string(text: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(text)), r"^\[|\]$", "")


def cache_lookup(
    wanted: DataFrame, cache: DataFrame, now: Column, ttl: int = fixed.ANSWER_CACHE_TTL_SECONDS
) -> DataFrame:
    """`wanted` (with cache_key) plus answer and cache_status hit or miss.

    `cache` has cache_key, answer, created_at; an entry lives for `ttl` seconds, the newest counts.
    """
    alive = (
        cache.filter(F.timestamp_diff("SECOND", F.col("created_at"), now) < ttl)
        .groupBy("cache_key")
        .agg(F.max_by("answer", "created_at").alias("answer"))
    )
    return join_small(wanted, alive, ["cache_key"], "left").withColumn(
        "cache_status", F.when(F.col("answer").isNotNull(), "hit").otherwise("miss")
    )


@dataclass(frozen=True)
class Purge:
    kept: DataFrame
    counts: DataFrame


def cache_purge(cache: DataFrame, prefix: str, dry_run: bool = True) -> Purge:
    """Drop the keys with a prefix; a dry run only counts them."""
    hit = F.startswith("cache_key", F.lit(prefix))
    matched = F.count_if(hit)
    counts = cache.agg(
        matched.alias("matched"),
        (F.lit(0).cast("long") if dry_run else matched).alias("deleted"),
    ).select(
        F.lit(prefix + "*").alias("pattern"), "matched", "deleted",
        F.lit(dry_run).alias("dry_run"),
    )
    return Purge(cache if dry_run else cache.filter(~hit), counts)


# ---- request limits --------------------------------------------------------


def rate_limit(
    hits: DataFrame, per_minute: int = fixed.REQUESTS_PER_MINUTE,
    per_day: int = fixed.REQUESTS_PER_DAY,
) -> DataFrame:
    """hit_id, client, ts plus minute_count, day_count, limit_name and retry_after.

    Rejected requests count too. Clients are numbered by the second, then offset by the totals of
    the seconds before, so a busy client is spread over its seconds.
    """
    staged = hits.withColumn("__minute", F.date_trunc("minute", "ts")).withColumn(
        "__day", F.date_trunc("day", "ts")
    )
    second = F.date_trunc("second", "ts")
    counted = running_number(
        staged, ["client", "__minute"], ["ts", "hit_id"], second, "minute_count"
    )
    counted = running_number(counted, ["client", "__day"], ["ts", "hit_id"], second, "day_count")
    return judge(counted, per_minute, per_day).drop("__minute", "__day")


def judge(counted: DataFrame, per_minute: int, per_day: int) -> DataFrame:
    """The minute limit is reported first."""
    over_minute, over_day = F.col("minute_count") > per_minute, F.col("day_count") > per_day
    return counted.withColumn(
        "limit_name", F.when(over_minute, "minute").when(over_day, "day")
    ).withColumn("retry_after", F.when(over_minute, 60).when(over_day, 86400))
