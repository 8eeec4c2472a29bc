"""SQL statements of the registered queries, for a second engine to check them against.

Each statement is built from named common table expressions; `sql` pulls in what a final SELECT
mentions. Fixed word lists come from the same module as the operators', the logic does not.
"""

from __future__ import annotations

import re

from loreloom.functions import fixed
from loreloom.functions.text import spellings
from loreloom.plans import bindings as b

WS = r"[\s\x0b\x1c-\x1f\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LB = r"\r\n|[\n\x0b\f\r\x1c-\x1e\x85\x{2028}\x{2029}]"
CTES: dict[str, str] = {}
ORACLES: dict[str, str] = {}


# ---- SQL fragments ---------------------------------------------------------


def lit(value) -> str:
    return "NULL" if value is None else "'" + str(value).replace("'", "''") + "'"


def lits(values) -> str:
    return "[" + ", ".join(lit(v) for v in values) + "]::VARCHAR[]"


def fold(x: str) -> str:
    return f"replace(lower({x}), 'ß', 'ss')"


def squeeze(x: str) -> str:
    return f"trim(regexp_replace({x}, '{WS}+', ' ', 'g'))"


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS}+|{WS}+$', '', 'g')"


def words(x: str) -> str:
    return rf"regexp_extract_all({x}, '[\p{{L}}\p{{N}}_]+')"


def toks(x: str) -> str:
    return words(fold(x))


def spoken(x: str) -> str:
    return f"array_to_string({words(x)}, ' ')"


def head(x: str, n: int) -> str:
    return f"array_to_string(list_slice({words(x)}, 1, {n}), ' ')"


def pick(values, index: str) -> str:
    return f"([{', '.join(lit(v) for v in values)}])[({index}) + 1]"


def contains_any(x: str, markers) -> str:
    return "(" + " OR ".join(f"contains({x}, {lit(m)})" for m in markers) + ")"


def starts_any(x: str, prefixes) -> str:
    return "(" + " OR ".join(f"starts_with({x}, {lit(p)})" for p in prefixes) + ")"


def has_word(x: str, vocabulary) -> str:
    return f"list_has_any({toks(x)}, {lits(vocabulary)})"


def important(x: str) -> str:
    return (
        f"list_sort(list_filter(list_distinct({toks(x)}), lambda t: length(t) > 1 "
        f"AND NOT list_contains({lits(fixed.RANKING_STOP_WORDS)}, t)))"
    )


def normalise(x: str) -> str:
    return squeeze(fold(x))


def entity_name(x: str) -> str:
    letters, single, longer = spellings()
    out = f"translate({x}, {lit(letters)}, {lit(single)})"
    for letter, spelled in longer.items():
        out = f"replace({out}, {lit(letter)}, {lit(spelled)})"
    return squeeze(f"replace({fold(out)}, '_', ' ')")


def slug(x: str) -> str:
    cleaned = f"regexp_replace(regexp_replace({x}, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g')"
    return f"coalesce(nullif(lower({cleaned}), ''), 'section')"


def content_hash(x: str) -> str:
    return f"'sha256:' || sha256({x})"


def joined(x: str, sep: str = "|") -> str:
    return f"array_to_string({x}, {lit(sep)})"


def point_id(x: str) -> str:
    h = f"sha1(unhex('6ba7b8119dad11d180b400c04fd430c8') || encode({x}))"
    return (
        f"substr({h},1,8)||'-'||substr({h},9,4)||'-5'||substr({h},14,3)||'-'||"
        f"translate(substr({h},17,1),'0123456789abcdef','89ab89ab89ab89ab')||substr({h},18,3)"
        f"||'-'||substr({h},21,12)"
    )


def content_type_of(title: str, categories: str) -> str:
    haystack = fold(f"concat_ws(' ', {title}, {categories})")
    cases = " ".join(
        f"WHEN {contains_any(haystack, found)} THEN {lit(name)}"
        for name, found in fixed.CONTENT_TYPE_RULES
    )
    return f"CASE {cases} ELSE {lit(fixed.DEFAULT_CONTENT_TYPE)} END"


def is_hint(x: str) -> str:
    return has_word(x, fixed.HINT_WORDS)


def is_comparative(x: str) -> str:
    return has_word(x, fixed.COMPARATIVE_WORDS)


def is_definitional(x: str) -> str:
    return has_word(x, fixed.DEFINITION_WORDS)


def cte(name: str, body: str) -> None:
    CTES[name] = body


def sql(final: str, recursive: bool = False) -> str:
    """The final SELECT behind the expressions it mentions, in their order of definition."""
    needed: set[str] = set()
    todo = [final]
    while todo:
        text = todo.pop()
        for name, body in CTES.items():
            if name not in needed and re.search(rf"\b{name}\b", text):
                needed.add(name)
                todo.append(body)
    parts = [f"{name} AS ({body})" for name, body in CTES.items() if name in needed]
    if not parts:
        return final
    return f"WITH {'RECURSIVE ' if recursive else ''}" + ",\n".join(parts) + "\n" + final


def oracle(name: str, final: str, recursive: bool = False) -> None:
    ORACLES[name] = sql(final, recursive)


# ---- views of the given tables ---------------------------------------------

cte("v_raw", f"""
SELECT 'doc:' || doc_id AS doc_id, lang AS game_id,
  source || CASE WHEN doc_id % 5 = 0 THEN '_reddit' ELSE '_wiki' END AS source_id,
  'https://wiki.example/' || doc_id AS source_url, {spoken("string_split(text, chr(10))[1]")} AS title,
  {pick(['spell', 'item', 'character', 'mechanic'], 'doc_id % 4')} AS content_type,
  text AS text_en, doc_id AS ord
FROM documents""")
cte("v_corpus", f"""
SELECT doc_id AS chunk_id, ord, game_id, source_id, source_url, title, content_type,
  {pick(['Lead', 'History', 'Overview'], 'ord % 3')} AS section, text_en AS text FROM v_raw""")
cte("v_queries", f"""
SELECT item_id AS query_id, 'en' AS game_id,
  {pick(['', 'compare ', 'what is ', 'hint '], 'item_id % 4')} || {spoken('text')} AS query
FROM benchmark""")
cte("v_game_corpus", """
SELECT * REPLACE (CASE WHEN game_id = 'en' THEN 'bg3' ELSE 'blue_prince' END AS game_id)
FROM v_corpus""")

# ---- text ------------------------------------------------------------------

forum = "replace(text_en, 'and', '&amp;lt;')"
for found, plain in (("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">")):
    forum = f"replace({forum}, {lit(found)}, {lit(plain)})"
oracle("tokens", f"""
SELECT doc_id, len({toks('text_en')}) ::INTEGER AS n_tokens, md5({joined(toks('text_en'), ' ')}) AS tokens_md5,
  md5({joined(important('text_en'), ' ')}) AS important_md5, md5({squeeze(forum)}) AS forum_md5,
  {content_hash('text_en')} AS content_hash, {slug('title')} AS slug FROM v_raw""")

cte("v_cyrillic", """
SELECT doc_id, translate(title, 'abvhdezyiklmnoprstufgwcxqj', 'абвгдезиіклмнопрстуфґшцщжї') || 'ь'
  AS title FROM v_raw""")
oracle("entity_names", f"""
SELECT doc_id, title, {entity_name('title')} AS normalized_name FROM v_cyrillic""")

cte("v_listed", f"""
SELECT doc_id, {pick(b.LISTED_PREFIXES, 'ord % 12')} || title AS title, content_type AS categories
FROM v_raw""")
oracle("content_type_rules", f"""
SELECT doc_id, title, {starts_any(fold('title'), fixed.WIKI_A_SKIP_PREFIXES)} AS skip_a,
  {starts_any(fold('title'), fixed.WIKI_B_SKIP_PREFIXES)} AS skip_b,
  {content_type_of('title', 'categories')} AS content_type FROM v_listed""")

# The pages hold one <article> without nested blocks to skip except scripts, styles and notes.
ARTICLE = "regexp_extract(html, '(?is)<article[^>]*>(.*)</article>', 1)"
TEXT = f"regexp_replace({ARTICLE}, '(?is)<(script|style|sup)\\b[^>]*>.*?</(script|style|sup)>', '', 'g')"
TEXT = f"regexp_replace({TEXT}, '(?s)<!--.*?-->', '', 'g')"
TEXT = f"regexp_replace({TEXT}, '(?i)<(p|li|h2|h3|h4|br|tr)\\b[^>]*>', chr(1), 'g')"
# Every other tag ends a run of text: its white space is trimmed and one space follows.
TEXT = f"regexp_replace({TEXT}, '<[^>]+>', ' ', 'g')"
cte("v_pages", f"SELECT page_id, {TEXT} AS t FROM pages")
for entity, char in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"),
                     ("&nbsp;", "\u00a0"), ("&amp;", "&")):
    CTES["v_pages"] = CTES["v_pages"].replace(TEXT, f"replace({TEXT}, {lit(entity)}, {lit(char)})")
    TEXT = f"replace({TEXT}, {lit(entity)}, {lit(char)})"
cte("v_page_lines", f"""
SELECT page_id, unnest(l) AS line, generate_subscripts(l, 1) AS i
FROM (SELECT page_id, string_split_regex(t, chr(1) || '|{LB}') AS l FROM v_pages)""")
cte("v_page_text", f"""
SELECT page_id, coalesce(string_agg(c, chr(10) ORDER BY i) FILTER (c <> ''), '') AS text FROM (
  SELECT page_id, i, trim({squeeze('line')}, ' |') AS c FROM v_page_lines) GROUP BY page_id""")
oracle("html_text", """
SELECT page_id, length(text)::INTEGER AS n_chars, md5(text) AS text_md5 FROM v_page_text""")

# ---- sections --------------------------------------------------------------

cte("v_sectioned", """
SELECT * REPLACE (array_to_string(list_transform(string_split(text_en, chr(10)), lambda x, i:
  CASE (i - 1) % 6 WHEN 1 THEN 'Overview' || chr(10) || x
    WHEN 2 THEN '## Background [edit]' || chr(10) || x
    WHEN 3 THEN 'Technical details zz ' || x || ' Notes yy'
    WHEN 4 THEN 'Gallery' || chr(10) || x
    WHEN 5 THEN 'Details' || chr(10) || x || ' UID ab_1 [ 3 ]' ELSE x END), chr(10))
  || CASE WHEN ord % 3 = 0 THEN chr(10) || 'Retrieved from wiki' ELSE '' END AS text_en)
FROM v_raw""")
cte("v_lines", f"""
SELECT doc_id, content_type, unnest(l) AS line, generate_subscripts(l, 1) AS i FROM (
  SELECT doc_id, content_type, list_filter(list_transform(string_split_regex(text_en, '{LB}'),
    lambda x: {strip('x')}), lambda x: x <> '') AS l FROM v_sectioned)""")


def section_ctes(tag: str, rules: dict) -> None:
    clean = f"trim(regexp_replace(regexp_replace(line, '\\[.*?\\]', '', 'g'), '{WS}+', ' ', 'g'), ' #')"
    line = "regexp_replace(line, '\\[ *\\d+ *\\]', '', 'g')"
    if rules["technical"]:
        line = f"replace({line}, chr(8288), ' ')"
        ends = "|".join(fixed.WIKI_A_BLOCK_ENDS)
        for start in fixed.WIKI_A_BLOCK_STARTS:
            line = f"regexp_replace({line}, '(?i)\\b{start}\\b.*?(\\b(?:{ends})\\b|$)', '\\1', 'g')"
        for pattern in (
            r"\bUID\s+[A-Za-z0-9_]+", r"\bUUID\s+[A-Fa-f0-9-]{8,}", r"\bStats\s+[A-Za-z0-9_]+",
            r"\bEqp\.\s+[A-Za-z0-9_]+",
        ):
            line = f"regexp_replace({line}, '{pattern}', '', 'g')"
    footers = "|".join(re.sub(r"([?.:])", r"[\1]", m) for m in rules["footers"])
    cte(f"v_head_{tag}", f"""
SELECT *, sum(h::INT) OVER (PARTITION BY doc_id ORDER BY i) AS no FROM (
  SELECT *, {clean} AS clean, length({clean}) <= 80 AND NOT ends_with({clean}, '.')
    AND list_contains({lits(rules['headings'])}, {fold(clean)}) AS h FROM v_lines)""")
    cte(f"v_title_{tag}", f"""
SELECT doc_id, no, clean, CASE WHEN list_contains({lits(rules['blocked'])}, lower(clean)) THEN ''
  WHEN list_contains({lits(rules['parents'])}, lower(clean)) THEN clean END AS event
FROM v_head_{tag} WHERE h""")
    cte(f"v_path_{tag}", f"""
SELECT doc_id, no, CASE WHEN event IS NOT NULL OR scope = '' THEN clean
  ELSE scope || ' > ' || clean END AS section FROM (SELECT *, coalesce(last_value(event IGNORE NULLS)
  OVER (PARTITION BY doc_id ORDER BY no), '') AS scope FROM v_title_{tag})""")
    cte(f"v_body_{tag}", f"""
SELECT b.doc_id, b.content_type, b.no, coalesce(p.section, 'Lead') AS section, {squeeze(
    f"regexp_replace(b.text, '(?s)(?:{footers}).*$', '')")} AS text
FROM (SELECT doc_id, any_value(content_type) AS content_type, no,
  string_agg(c, ' ' ORDER BY i) FILTER (c <> '') AS text FROM (
    SELECT *, {squeeze(line)} AS c FROM v_head_{tag} WHERE NOT h) GROUP BY doc_id, no) b
LEFT JOIN v_path_{tag} p USING (doc_id, no) WHERE b.text IS NOT NULL""")
    blocked = (
        f"list_has_any(list_transform(string_split({fold('section')}, '>'), lambda x: {strip('x')}), "
        f"{lits(rules['blocked'])})"
    )
    if rules["technical"]:
        blocked = f"({blocked} OR (content_type = 'character' AND section = 'Lead'))"
    spoiler = "section || ' ' || text" if rules["in_text"] else "section"
    cte(f"v_section_{tag}", f"""
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY no) AS section_no, section, text,
  CASE WHEN {contains_any(fold(spoiler), rules['spoilers'])} THEN 'spoiler_heavy'
  ELSE 'standard' END AS spoiler_level
FROM v_body_{tag} WHERE text <> '' AND NOT {blocked}""")


section_ctes("a", {
    "headings": fixed.WIKI_A_HEADINGS, "blocked": fixed.WIKI_A_BLOCKED, "technical": True,
    "parents": fixed.WIKI_A_PARENTS, "footers": fixed.WIKI_A_FOOTERS, "in_text": False,
    "spoilers": fixed.WIKI_A_SPOILERS,
})
section_ctes("b", {
    "headings": fixed.WIKI_B_HEADINGS, "blocked": fixed.WIKI_B_BLOCKED, "technical": False,
    "parents": [], "footers": fixed.WIKI_B_FOOTERS, "in_text": True,
    "spoilers": fixed.WIKI_B_SPOILERS,
})
SECTION_SELECT = """
SELECT doc_id, section_no::INTEGER AS section_no, section, length(text)::INTEGER AS n_chars,
  md5(text) AS text_md5, spoiler_level FROM """
oracle("doc_sections", SECTION_SELECT + "v_section_a")
# Without parents a path is the heading itself, blocked or not.
CTES["v_path_b"] = "SELECT doc_id, no, clean AS section FROM v_title_b"
oracle("doc_sections_plain", SECTION_SELECT + "v_section_b")

cte("v_thread_lines", """
SELECT doc_id, content_type, title, source_id, ord, unnest(l) AS line,
  generate_subscripts(l, 1) - 1 AS i
FROM (SELECT *, string_split(text_en, chr(10)) AS l FROM v_raw)""")
cte("v_comments", f"""
SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS n FROM (
  SELECT doc_id, i, CASE WHEN i % 4 = 3 THEN 'unknown' ELSE 'user' || i END AS author,
    CASE WHEN i % 7 = 6 THEN 0 ELSE i * 3 END AS score, CASE WHEN i % 5 = 4 THEN '[deleted]'
      ELSE {squeeze("replace(replace(replace(replace(line, 'and', '&amp;'), '&amp;', '&'), '&lt;', '<'), '&gt;', '>')")} END AS body
  FROM v_thread_lines WHERE i > 0 AND i % 6 <> 5)
WHERE body <> '' AND body <> '[deleted]' AND body <> '[removed]'""")
NL = "chr(10)"
clean_line = squeeze("replace(replace(replace(line, '&amp;', '&'), '&lt;', '<'), '&gt;', '>')")
selftext = f"(CASE WHEN {clean_line} = '' THEN '' ELSE {clean_line} || {NL} END)"
post_text = squeeze(
    f"'Reddit post: ' || title || {NL} || 'Author: u/' || source_id || {NL} || 'Score: ' || ord || "
    f"{NL} || {selftext} || 'Permalink: https://www.reddit.com/r/x/comments/' || ord"
)
comment_text = squeeze(
    f"'Comment ' || n || ' by u/' || author || {NL} || 'Score: ' || score || {NL} || body || {NL} || "
    f"'Permalink: https://www.reddit.com/r/x/' || i || '/'"
)
cte("v_thread", f"""
SELECT doc_id, content_type, 1 AS section_no, 'Post' AS section, {post_text} AS text
FROM v_thread_lines WHERE i = 0
UNION ALL
SELECT doc_id, any_value(content_type), 2, 'Top comments', string_agg({comment_text},
  chr(10) || chr(10) ORDER BY n) FROM v_comments JOIN v_raw USING (doc_id)
WHERE n <= {fixed.THREAD_MAX_COMMENTS} GROUP BY doc_id""")
oracle("thread_sections", f"""
SELECT doc_id, section_no::INTEGER AS section_no, section, length(text)::INTEGER AS n_chars, md5(text) AS text_md5,
  CASE WHEN {contains_any(fold("content_type || ' ' || text"), fixed.THREAD_SPOILERS)}
  THEN 'spoiler_heavy' ELSE 'standard' END AS spoiler_level FROM v_thread""")

# ---- chunks ----------------------------------------------------------------


def windows(text: str, size: int, overlap: int) -> str:
    step = size - overlap
    return (
        f"(CASE WHEN {text} = '' THEN []::VARCHAR[] ELSE list_transform(range(0, 1 + greatest(0, "
        f"ceil((length({text}) - {size}) / {step}.0)::BIGINT)), "
        f"lambda w: substring({text}, (w * {step} + 1)::BIGINT, {size})) END)"
    )


cte("v_stripped", f"SELECT doc_id, title, {strip('text_en')} AS t FROM v_raw")
cte("v_fixed", f"""
SELECT doc_id, title, unnest(c) AS c, generate_subscripts(c, 1) AS n
FROM (SELECT doc_id, title, {windows('t', 800, 100)} AS c FROM v_stripped)""")
oracle("chunk_fixed", f"""
SELECT doc_id || ':' || {slug('title')} || ':' || printf('%04d', n) AS chunk_id,
  length(c)::INTEGER AS n_chars, md5(c) AS text_md5 FROM v_fixed""")


def sentences(x: str) -> str:
    cut = f"regexp_replace({strip(x)}, '([.!?]){WS}+', '\\1' || chr(1), 'g')"
    return (
        f"list_filter(list_transform(string_split({cut}, chr(1)), lambda s: {strip('s')}), "
        f"lambda s: s <> '')"
    )


cte("v_sentences", f"SELECT doc_id, {sentences('text_en')} AS s FROM v_raw")
oracle("sentence_split", """
SELECT doc_id, len(s)::INTEGER AS n_sentences, md5(array_to_string(s, '|')) AS text_md5 FROM v_sentences""")

SIZE = 800
OVER = 100
# Paragraph rows of a text, long ones cut into pieces by a fold over their sentences.
EMPTY = "[]::VARCHAR[]"


def pieces_of(p: str) -> str:
    """Sentences packed to the size inside one paragraph."""
    state = f"struct_pack(o := '', d := {EMPTY}, s := '')"
    items = f"list_transform({sentences(p)}, lambda q: struct_pack(o := '', d := {EMPTY}, s := q))"
    closed = "(CASE WHEN a.o = '' THEN a.d ELSE list_append(a.d, a.o) END)"
    grown = "(CASE WHEN a.o = '' THEN x.s ELSE a.o || ' ' || x.s END)"
    fold_sql = (
        f"list_reduce({items}, lambda a, x: CASE "
        f"WHEN length(x.s) > {SIZE} THEN struct_pack(o := '', d := list_concat({closed}, "
        f"{windows('x.s', SIZE, OVER)}), s := '') "
        f"WHEN length({grown}) > {SIZE} THEN struct_pack(o := x.s, d := {closed}, s := '') "
        f"ELSE struct_pack(o := {grown}, d := a.d, s := '') END, {state})"
    )
    return fold_sql


def pack_ctes(tag: str, source: str, key: str, paragraphs: str) -> None:
    """v_packed_<tag>(key, chunks) from `source`, given the list of its paragraphs."""
    cte(f"v_par_{tag}", f"""
SELECT {key}, unnest(ps) AS p, generate_subscripts(ps, 1) AS i
FROM (SELECT {key}, {paragraphs} AS ps FROM {source})""")
    cte(f"v_long_{tag}", f"""
SELECT *, CASE WHEN length(p) > {SIZE} THEN CASE WHEN len({sentences('p')}) <= 1
  THEN {windows('p', SIZE, OVER)} ELSE (SELECT CASE WHEN r.o = '' THEN r.d ELSE list_append(r.d, r.o)
  END FROM (SELECT {pieces_of('p')} AS r)) END END AS pieces FROM v_par_{tag}""")
    blank = f"struct_pack(o := {EMPTY}, d := {EMPTY}, p := '', pieces := NULL::VARCHAR[])"
    closed = "(CASE WHEN len(a.o) = 0 THEN a.d ELSE list_append(a.d, array_to_string(a.o, chr(10)||chr(10))) END)"
    tail = "list_slice(a.o, -1, -1)"
    cte(f"v_packed_{tag}", f"""
SELECT {key}, CASE WHEN len(r.o) = 0 THEN r.d
  ELSE list_append(r.d, array_to_string(r.o, chr(10)||chr(10))) END AS chunks
FROM (SELECT {key}, list_reduce(items, lambda a, x: CASE
    WHEN x.pieces IS NOT NULL THEN struct_pack(o := {tail}, d := list_concat({closed}, x.pieces),
      p := '', pieces := NULL::VARCHAR[])
    WHEN len(a.o) > 0 AND length(array_to_string(list_append(a.o, x.p), chr(10)||chr(10))) > {SIZE}
      THEN struct_pack(o := list_append({tail}, x.p), d := {closed}, p := '',
        pieces := NULL::VARCHAR[])
    ELSE struct_pack(o := list_append(a.o, x.p), d := a.d, p := '', pieces := NULL::VARCHAR[]) END,
  {blank}) AS r FROM (SELECT {key}, list(struct_pack(o := {EMPTY}, d := {EMPTY}, p := p,
    pieces := pieces) ORDER BY i) AS items FROM v_long_{tag} GROUP BY {key}))""")


line_paragraphs = (
    f"list_filter(list_transform(string_split(replace(replace(text_en, chr(10), "
    f"chr(10)||chr(10)), chr(13)||chr(10), chr(10)), chr(10)||chr(10)), lambda x: "
    f"array_to_string(list_filter(list_transform(string_split_regex(x, '{LB}'), lambda y: "
    f"{strip('y')}), lambda y: y <> ''), ' ')), lambda x: x <> '')"
)
pack_ctes("doc", "v_raw", "doc_id", line_paragraphs)
oracle("chunk_paragraphs", """
SELECT doc_id, n::INTEGER AS chunk_no, length(c)::INTEGER AS n_chars, md5(c) AS text_md5
FROM (SELECT doc_id, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS n FROM v_packed_doc)""")
# A wiki section is one line, hence one paragraph.
cte("v_section_key", """
SELECT doc_id || '#' || lpad(section_no::VARCHAR, 6, '0') AS k, text FROM v_section_a""")
pack_ctes("sec", "v_section_key", "k", "[text]")
cte("v_doc_chunks", """
SELECT s.doc_id, s.section, s.spoiler_level, c.c,
  row_number() OVER (PARTITION BY s.doc_id ORDER BY s.section_no, c.n) AS n
FROM (SELECT k, unnest(chunks) AS c, generate_subscripts(chunks, 1) AS n FROM v_packed_sec) c
JOIN (SELECT *, doc_id || '#' || lpad(section_no::VARCHAR, 6, '0') AS k FROM v_section_a) s USING (k)""")
oracle("chunk_table", f"""
SELECT doc_id || ':' || {slug('section')} || ':' || printf('%04d', n) AS chunk_id, game_id, source_id,
  section, spoiler_level, length(c)::INTEGER AS n_chars, md5(c) AS text_md5
FROM v_doc_chunks JOIN v_raw USING (doc_id)""")

# ---- lexical and vector search ---------------------------------------------

INDEX_TEXT = (
    "concat_ws(' ', title, title, title, title, section, section, content_type, text)"
)


def bm25_ctes(tag: str, corpus: str, queries: str) -> None:
    cte(f"v_toks_{tag}", f"""
SELECT chunk_id, ord, game_id, {toks(INDEX_TEXT)} AS t FROM {corpus}""")
    cte(f"v_tf_{tag}", f"""
SELECT chunk_id, ord, game_id, dl, term, count(*) AS tf FROM (
  SELECT chunk_id, ord, game_id, len(t) AS dl, unnest(t) AS term FROM v_toks_{tag}) GROUP BY ALL""")
    cte(f"v_df_{tag}", f"SELECT term, count(*) AS df FROM v_tf_{tag} GROUP BY term")
    cte(f"v_stats_{tag}", f"SELECT count(*) AS n, avg(len(t)) AS avgdl FROM v_toks_{tag}")
    cte(f"v_qt_{tag}", f"""
SELECT query_id, game_id, term, count(*) AS qtf FROM (
  SELECT query_id, game_id, unnest({toks('query')}) AS term FROM {queries}) GROUP BY ALL""")
    cte(f"v_score_{tag}", f"""
SELECT query_id, chunk_id, ord, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5
  / (tf + 1.5 * (0.25 + 0.75 * dl / greatest(avgdl, 1.0)))) AS raw
FROM v_qt_{tag} JOIN v_tf_{tag} USING (game_id, term) JOIN v_df_{tag} USING (term), v_stats_{tag}
GROUP BY ALL""")
    cte(f"v_bm25_{tag}", f"""
SELECT query_id, chunk_id, ord, round(raw, 6) AS bm25_score, round(raw / (raw + 1), 6) AS score,
  row_number() OVER (PARTITION BY query_id ORDER BY round(raw, 6) DESC, ord) AS rank
FROM v_score_{tag} WHERE raw > 0""")


bm25_ctes("q", "v_corpus", "v_queries")
oracle("bm25_topk", """
SELECT query_id, chunk_id, bm25_score, score, rank::INTEGER AS rank FROM v_bm25_q WHERE rank <= 5""")
oracle("corpus_stats", """
SELECT term, df, n AS total_documents, round(avgdl, 6) AS average_length FROM v_df_q, v_stats_q""")


def hash_vector(text: str, size: int = 64) -> str:
    digests = " || ".join(f"sha256('{i}:' || {text})" for i in range(-(-size // 32)))
    nibble = "(instr('0123456789abcdef', substr(h, {}, 1)) - 1)"
    return (
        f"(SELECT list_transform(v, lambda x: x / sqrt(list_sum(list_transform(v, lambda y: y * y)))) "
        f"FROM (SELECT list_transform(range({size}), lambda j: ("
        f"{nibble.format('(2 * j + 1)::BIGINT')} * 16 + {nibble.format('(2 * j + 2)::BIGINT')}) / 127.5 - 1.0) AS v "
        f"FROM (SELECT {digests} AS h)))"
    )


cte("v_emb", f"SELECT chunk_id, ord, game_id, {hash_vector('text')} AS e FROM v_corpus")
cte("v_qemb", f"SELECT query_id, game_id, {hash_vector('query')} AS e FROM v_queries")
oracle("hash_embeddings", """
SELECT chunk_id AS doc_id, (generate_subscripts(e, 1) - 1)::INTEGER AS pos, round(unnest(e), 6) AS value
FROM v_emb""")
oracle("vector_topk", """
SELECT query_id, vec_id, score, rank::INTEGER AS rank FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM (
    SELECT q.vec_id AS query_id, v.vec_id, round(list_cosine_similarity(q.embedding::DOUBLE[],
      v.embedding::DOUBLE[]), 6) AS score
    FROM embeddings q JOIN embeddings v ON q.label = v.label)) WHERE rank <= 5""")
cte("v_vec", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM (
  SELECT query_id, chunk_id, ord, round(list_dot_product(q.e, d.e), 6) AS score
  FROM v_qemb q JOIN v_emb d USING (game_id))""")
cte("v_merged", """
SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.chunk_id, l.chunk_id) AS chunk_id,
  greatest(v.score, l.score) AS score, l.bm25_score,
  concat_ws('+', CASE WHEN v.rank IS NOT NULL THEN 'vector' END,
    CASE WHEN l.rank IS NOT NULL THEN 'bm25' END) AS retrieval_source,
  CASE WHEN v.rank IS NOT NULL THEN 0 ELSE 1 END AS list_no,
  coalesce(v.rank, l.rank)::INTEGER AS list_rank
FROM (SELECT * FROM v_vec WHERE rank <= 50) v
FULL OUTER JOIN (SELECT * FROM v_bm25_q WHERE rank <= 50) l USING (query_id, chunk_id)""")
oracle("hybrid_merge", "SELECT * FROM v_merged")

# ---- policy, rerank, diversification ---------------------------------------

cte("v_cand", """
SELECT b.query_id, b.chunk_id, b.score, 0 AS list_no, b.rank AS list_rank, q.query, c.title, c.section,
  c.text, c.source_id, c.source_url, c.content_type, c.game_id
FROM v_bm25_q b JOIN v_queries q USING (query_id) JOIN v_corpus c USING (chunk_id) WHERE b.rank <= 50""")


def policy_cte(name: str, source: str) -> None:
    wiki, forum = "ends_with(source_id, '_wiki')", "ends_with(source_id, '_reddit')"
    cte(name, f"""
SELECT * REPLACE (round(score + CASE WHEN hint AND {forum} THEN {fixed.FORUM_HINT_BOOST}
    WHEN NOT hint AND {wiki} THEN {fixed.WIKI_FACT_BOOST}
    WHEN NOT hint AND {forum} THEN -{fixed.FORUM_FACT_PENALTY} ELSE 0 END, 6) AS score),
  CASE WHEN hint AND {forum} THEN 'source_policy:prefer_reddit_hints'
    WHEN NOT hint AND {wiki} THEN 'source_policy:prefer_wiki_facts'
    WHEN NOT hint AND {forum} THEN 'source_policy:deprioritize_reddit_for_facts' ELSE '' END AS policy
FROM (SELECT *, {is_hint('query')} AS hint FROM {source})""")


def rerank_ctes(tag: str, source: str) -> None:
    cte(f"v_norm_{tag}", f"""
SELECT *, {normalise('query')} AS qn, {important('query')} AS qw, {normalise('title')} AS tn,
  {important('title')} AS tw, {normalise('section')} AS sn, {normalise('text')} AS xn,
  {is_comparative('query')} AS cmp, {is_definitional('query')} AS def FROM {source}""")
    cte(f"v_flag_{tag}", f"""
SELECT *, tn <> '' AND contains(qn, tn) AS exact, CASE WHEN contains(qn, tn) THEN {EMPTY}
    ELSE list_filter(tw, lambda t: list_contains(qw, t)) END AS shared,
  list_filter(qw, lambda t: contains(xn, t)) AS hits FROM v_norm_{tag}""")
    cte(f"v_lead_{tag}", f"""
SELECT *, exact AND list_contains({lits(fixed.LEAD_SECTIONS)}, sn) AND def AS lead FROM v_flag_{tag}""")
    cte(f"v_rr_{tag}", f"""
SELECT *, round(score + CASE WHEN exact THEN {fixed.TITLE_EXACT_BONUS} ELSE 0 END
    + {fixed.TITLE_TOKEN_BONUS} * len(shared) + CASE WHEN lead THEN {fixed.LEAD_SECTION_BONUS} ELSE 0 END
    + {fixed.TEXT_TERM_BONUS} * len(hits), 6) AS rerank_score,
  list_concat(list_concat(CASE WHEN exact THEN ['title_exact:' || tn] ELSE {EMPTY} END,
    list_transform(shared, lambda t: 'title_token:' || t)),
    list_concat(CASE WHEN lead THEN ['section_lead_for_definition'] ELSE {EMPTY} END,
    list_transform(hits, lambda t: 'text_term:' || t))) AS reasons FROM v_lead_{tag}""")
    cte(f"v_ord_{tag}", f"""
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY exact DESC, lead DESC, rerank_score DESC,
  list_no, list_rank, chunk_id) AS pos FROM v_rr_{tag}""")


def diversity_ctes(tag: str, limit: int) -> None:
    cte(f"v_div_{tag}", f"""
SELECT query_id, cmp, list(struct_pack(pos := pos, key := CASE WHEN cmp THEN tn
  ELSE concat_ws(chr(10), tn, sn) END, eligible := cmp OR exact, score := rerank_score) ORDER BY pos) AS l
FROM v_ord_{tag} WHERE cmp OR def GROUP BY query_id, cmp""")
    gap = f"CASE WHEN cmp THEN {fixed.TITLE_DIVERSITY_GAP} ELSE {fixed.SECTION_DIVERSITY_GAP} END"
    free = (
        "list_filter(lft, lambda c: len(seen) > 0 AND c.eligible AND NOT list_contains(seen, c.key) "
        f"AND c.score >= round(lft[1].score - {gap}, 6))"
    )
    cte(f"v_pick_{tag}", f"""
SELECT query_id, cmp, 0 AS n, l AS lft, {EMPTY} AS seen, NULL::BIGINT AS pos, false AS added
FROM v_div_{tag}
UNION ALL
SELECT query_id, cmp, n + 1, list_filter(lft, lambda c: c.pos <> p.pos), list_append(seen, p.key), p.pos,
  len(seen) > 0 AND NOT list_contains(seen, p.key) AND p.eligible
FROM (SELECT *, coalesce(({free})[1], lft[1]) AS p FROM v_pick_{tag} WHERE n < {limit} AND len(lft) > 0)""")
    cte(f"v_ranked_{tag}", f"""
SELECT * EXCLUDE (pos), pos AS rank FROM v_ord_{tag} WHERE NOT cmp AND NOT def AND pos <= {limit}
UNION ALL
SELECT o.* EXCLUDE (pos) REPLACE (CASE WHEN p.added THEN list_append(o.reasons, CASE WHEN o.cmp
  THEN 'comparative_diversity' ELSE 'section_diversity' END) ELSE o.reasons END AS reasons), p.n AS rank
FROM v_ord_{tag} o JOIN v_pick_{tag} p USING (query_id, pos)""")


policy_cte("v_policy", "v_cand")
rerank_ctes("c", "v_policy")
diversity_ctes("c", 10)
oracle("source_policy", "SELECT query_id, chunk_id, score, policy AS reasons FROM v_policy")
oracle("rerank_order", """
SELECT query_id, chunk_id, pos::INTEGER AS rank, rerank_score, exact AS rerank_exact_title_match,
  lead AS rerank_definition_lead_section, array_to_string(reasons, '|') AS reasons
FROM v_ord_c WHERE pos <= 10""")
RANKED = """
SELECT query_id, chunk_id, rank::INTEGER AS rank, rerank_score, array_to_string(reasons, '|') AS reasons
FROM v_ranked_c WHERE """
oracle("diversify_title", RANKED + "cmp", recursive=True)
oracle("diversify_section", RANKED + "def AND NOT cmp", recursive=True)
FINAL_ORDER = """row_number() OVER (PARTITION BY query_id ORDER BY
  (hint AND ends_with(source_id, '_reddit'))::INT DESC,
  CASE WHEN hint THEN rerank_score ELSE 0 END DESC, {})::INTEGER"""
oracle("hint_finalize", f"""
SELECT query_id, chunk_id, source_id, {FINAL_ORDER.format('pos')} AS rank
FROM v_ord_c WHERE pos <= 10""")

# The whole search: what rewriting keeps of these queries is their words.
cte("v_asked", f"SELECT query_id, game_id, query AS original, {joined(words('query'), ' ')} AS query FROM v_queries")
bm25_ctes("h", "v_corpus", "v_asked")
cte("v_hemb", f"SELECT query_id, game_id, {hash_vector('query')} AS e FROM v_asked")
cte("v_hvec", """
SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, ord) AS rank FROM (
  SELECT query_id, chunk_id, ord, round(list_dot_product(q.e, d.e), 6) AS score
  FROM v_hemb q JOIN v_emb d USING (game_id))""")
cte("v_hfound", """
SELECT coalesce(v.query_id, l.query_id) AS query_id, coalesce(v.chunk_id, l.chunk_id) AS chunk_id,
  greatest(v.score, l.score) AS score, l.bm25_score,
  concat_ws('+', CASE WHEN v.rank IS NOT NULL THEN 'vector' END,
    CASE WHEN l.rank IS NOT NULL THEN 'bm25' END) AS retrieval_source,
  CASE WHEN v.rank IS NOT NULL THEN 0 ELSE 1 END AS list_no, coalesce(v.rank, l.rank) AS list_rank
FROM (SELECT * FROM v_hvec WHERE rank <= 50) v
FULL OUTER JOIN (SELECT * FROM v_bm25_h WHERE rank <= 50) l USING (query_id, chunk_id)""")
cte("v_hcand", """
SELECT f.*, q.query, c.title, c.section, c.text, c.source_id FROM v_hfound f
JOIN v_asked q USING (query_id) JOIN v_corpus c USING (chunk_id)""")
policy_cte("v_hpolicy", "v_hcand")
rerank_ctes("h", "v_hpolicy")
diversity_ctes("h", 5)
RESULT = """
SELECT query_id, {rank} AS rank, chunk_id, retrieval_source, bm25_score, score, rerank_score,
  array_to_string(reasons, '|') AS rerank_reasons, {policy} AS source_policy_reasons,
  query AS retrieval_query, '' AS rewrite_reasons FROM {source}"""
oracle("hybrid_search", RESULT.format(
    rank=FINAL_ORDER.format("rank"), policy="policy", source="v_ranked_h"), recursive=True)
cte("v_vcand", """
SELECT v.query_id, v.chunk_id, v.score, NULL::DOUBLE AS bm25_score, 'vector' AS retrieval_source,
  0 AS list_no, v.rank AS list_rank, q.query, c.title, c.section, c.text, c.source_id
FROM v_hvec v JOIN v_asked q USING (query_id) JOIN v_corpus c USING (chunk_id) WHERE v.rank <= 50""")
rerank_ctes("v", "v_vcand")
diversity_ctes("v", 5)
oracle("vector_search", RESULT.format(
    rank="rank::INTEGER", policy="''", source="v_ranked_v"), recursive=True)

# ---- entities and rewriting ------------------------------------------------


def entity_cte(name: str, corpus: str) -> None:
    cte(name, f"""
SELECT game_id, title AS canonical_name, {entity_name('title')} AS normalized_name,
  arg_min(content_type, ord) AS content_type, arg_min(source_url, ord) AS source_url
FROM {corpus} GROUP BY game_id, title""")


entity_cte("v_entities", "v_corpus")
entity_cte("v_game_entities", "v_game_corpus")
oracle("entity_registry", "SELECT *, normalized_name AS aliases FROM v_entities")
oracle("entity_list", """
SELECT game_id, canonical_name, content_type FROM v_entities""")
cte("v_lookups", """
SELECT ord AS lookup_id, game_id, replace(title, ' ', '_') || CASE WHEN ord % 3 = 0 THEN ' x' ELSE '' END
  AS name FROM v_raw""")
oracle("entity_exact", f"""
SELECT l.lookup_id, l.game_id, l.name, e.canonical_name, e.content_type FROM v_lookups l LEFT JOIN (
  SELECT *, row_number() OVER (PARTITION BY game_id, normalized_name
    ORDER BY {fold('canonical_name')}, canonical_name) AS r FROM v_entities WHERE normalized_name <> '') e
ON e.r = 1 AND e.game_id = l.game_id AND e.normalized_name = {entity_name('l.name')}""")
cte("v_texts", f"""
SELECT conv_id || ':' || turn AS text_id, {pick(['en', 'fr', 'de', 'es'], 'conv_id % 4')} AS game_id,
  {entity_name('text')} AS t FROM conversations""")
oracle("entity_mentions", """
SELECT text_id, t.game_id, canonical_name, content_type, instr(t, normalized_name)::INTEGER AS position
FROM v_texts t JOIN v_entities e ON e.game_id = t.game_id AND normalized_name <> ''
  AND contains(t.t, normalized_name)""")
cte("v_mixed", f"""
SELECT item_id AS query_id, {pick(['порівняй мені ', 'Що ', 'блискавка чи фаєрбол ', ''], 'item_id % 4')}
  || {spoken('text')} || CASE WHEN item_id % 3 = 0 THEN ' що завдає більше шкоди' ELSE '' END AS query
FROM benchmark""")
phrase, phrase_new = next(iter(fixed.PHRASE_REWRITES.items()))
MAP = (
    "MAP {" + ", ".join(f"{lit(k)}: {lit(v)}" for k, v in fixed.TOKEN_REWRITES.items()) + "}"
)
cte("v_mapped", f"""
SELECT query_id, query, regexp_matches(query, '(?i){phrase}') AS p, list_transform(
  {words(f"regexp_replace(query, '(?i){phrase}', {lit(phrase_new)}, 'g')")},
  lambda w: struct_pack(w := w, n := {MAP}[{fold('w')}])) AS m FROM v_mixed""")
cte("v_rewritten", f"""
SELECT query_id, query, array_to_string(list_filter(list_transform(m, lambda x: coalesce(x.n, x.w)),
    lambda x: x <> ''), ' ') AS retrieval_query,
  list_concat(CASE WHEN p THEN [{lit(phrase + '->' + phrase_new)}] ELSE {EMPTY} END,
    list_transform(list_filter(m, lambda x: x.n IS NOT NULL), lambda x: x.w || '->' || x.n)) AS r
FROM v_mapped""")
oracle("rewrite_queries", f"""
SELECT query_id, retrieval_query, CASE WHEN retrieval_query = {squeeze('query')} THEN ''
  ELSE array_to_string(r, '|') END AS rewrite_reasons FROM v_rewritten""")

# ---- evaluation ------------------------------------------------------------

cte("v_golden", f"""
SELECT item_id AS case_id, {spoken('text')} AS query,
  {pick(['items', 'lore', None], 'item_id % 3')} AS category,
  coalesce(titles, {EMPTY}) AS titles, {words('text')} AS terms,
  coalesce(sources, {EMPTY}) AS sources, item_id * 7 % 97 AS latency_ms
FROM benchmark LEFT JOIN (SELECT item_id, list_sort(list(DISTINCT title)) AS titles,
  list_sort(list(DISTINCT source_id)) AS sources
  FROM benchmark JOIN v_raw ON contains(text_en, text) GROUP BY item_id) USING (item_id)""")
cte("v_results", """
SELECT b.query_id, b.rank, b.score, c.* EXCLUDE (ord) FROM v_bm25_q b JOIN v_corpus c USING (chunk_id)
WHERE b.rank <= 5""")
# The cases ask with their own words, so they have their own results.
cte("v_golden_q", "SELECT case_id AS query_id, 'en' AS game_id, query FROM v_golden")
bm25_ctes("g", "v_corpus", "v_golden_q")
cte("v_result_lists", """
SELECT b.query_id AS case_id, list(struct_pack(title := title, section := section, text := text,
  source_id := source_id) ORDER BY b.rank) AS l FROM v_bm25_g b JOIN v_corpus c USING (chunk_id)
WHERE b.rank <= 5 GROUP BY b.query_id""")


def folded(x: str) -> str:
    return f"list_transform(list_filter({x}, lambda v: v <> ''), lambda v: {fold('v')})"


cte("v_case_base", f"""
SELECT g.*, coalesce(l.l, []) AS l, {folded('titles')} AS et, {folded('sources')} AS es,
  {folded('terms')} AS tt FROM v_golden g LEFT JOIN v_result_lists l USING (case_id)""")
cte("v_case_rows", f"""
SELECT *, {folded('list_transform(l, lambda x: x.title)')} AS rt,
  {fold("array_to_string(list_transform(l[1:5], lambda x: x.title || ' ' || x.section || ' ' || x.text), chr(10))")} AS hay
FROM v_case_base""")
cte("v_cases", f"""
SELECT case_id, query, category, latency_ms, l, len(es) > 0 AS stated,
  list_position(list_transform(rt, lambda t: list_contains(et, t)), true) AS first_rank,
  list_has_any(et, {folded('list_transform(l[1:1], lambda x: x.title)')}) AS hit_at_1,
  list_has_any(et, {folded('list_transform(l[1:5], lambda x: x.title)')}) AS hit_at_5,
  CASE WHEN len(et) = 0 THEN 0.0 ELSE len(list_intersect(list_distinct(et), rt[1:5]))
    / len(list_distinct(et))::DOUBLE END AS coverage_at_5,
  CASE WHEN len(tt) = 0 THEN 0.0 ELSE len(list_filter(tt, lambda t: contains(hay, t)))
    / len(tt)::DOUBLE END AS term_coverage_at_5,
  true AS tenant_isolated,
  list_has_any(es, list_transform(l[1:5], lambda x: {fold('x.source_id')})) AS source_hit_at_5
FROM v_case_rows""")
oracle("retrieval_cases", """
SELECT case_id, category, nullif(first_rank, 0)::BIGINT AS first_rank, hit_at_1, hit_at_5,
  round(coverage_at_5, 6) AS coverage_at_5, round(term_coverage_at_5, 6) AS term_coverage_at_5,
  tenant_isolated, source_hit_at_5 FROM v_cases""")
oracle("eval_report", """
SELECT case_id, query, 'en' AS game_id, array_to_string(list_transform(l, lambda x: x.title), '|')
  AS top_titles, hit_at_1, hit_at_5, source_hit_at_5, tenant_isolated FROM v_cases""")


def nearest(source: str, value: str, keys: str = "") -> str:
    part = f"PARTITION BY {keys} " if keys else ""
    group = f"{keys}, " if keys else ""
    return f"""SELECT {group}{value} AS p FROM (
  SELECT {group}{value}, row_number() OVER ({part}ORDER BY {value}) AS r,
    count(*) OVER ({part.strip()}) AS n FROM {source} WHERE {value} IS NOT NULL)
  WHERE r = round_even((n - 1) * 0.95, 0) + 1"""


def avg6(x: str) -> str:
    return f"coalesce(round(avg({x}), 6), 0.0)"


cte("v_p95", nearest("v_cases", "latency_ms"))
oracle("retrieval_metrics", f"""
SELECT g.*, CASE WHEN is_overall THEN coalesce((SELECT p FROM v_p95), 0)::DOUBLE END AS p95_latency_ms FROM (
  SELECT category, grouping(category) = 1 AS is_overall, count(*) AS total,
    CASE WHEN grouping(category) = 1 THEN {avg6('(coalesce(first_rank, 0) = 1)::INT')}
      ELSE {avg6('hit_at_1::INT')} END AS hit_at_1,
    {avg6('(coalesce(first_rank, 0) BETWEEN 1 AND 3)::INT')} AS hit_at_3,
    CASE WHEN grouping(category) = 1 THEN {avg6('(coalesce(first_rank, 0) BETWEEN 1 AND 5)::INT')}
      ELSE {avg6('hit_at_5::INT')} END AS hit_at_5,
    {avg6('CASE WHEN first_rank BETWEEN 1 AND 5 THEN 1.0 / first_rank ELSE 0.0 END')} AS mrr,
    {avg6('coverage_at_5')} AS coverage_at_5, {avg6('term_coverage_at_5')} AS term_coverage_at_5,
    {avg6('tenant_isolated::INT')} AS tenant_isolation,
    {avg6('CASE WHEN stated THEN source_hit_at_5::INT END')} AS source_hit_at_5,
    count(*) FILTER (stated) AS source_expectation_total, {avg6('latency_ms::DOUBLE')} AS avg_latency_ms
  FROM v_cases GROUP BY GROUPING SETS ((), (category))) g WHERE is_overall OR category IS NOT NULL""")
oracle("nearest_rank_p95", f"""
SELECT event_type, p AS p95 FROM ({nearest('events', 'value', 'event_type')})
UNION ALL SELECT 'all', p FROM ({nearest('events', 'value')})""")

cte("v_answers", f"""
SELECT conv_id || ':' || turn AS id, text || {pick([' [1]', ' [2] not enough context', '', ' [3]'], '(conv_id + turn) % 4')} AS answer,
  CASE WHEN turn % 5 = 4 THEN {EMPTY} ELSE {words('text')} END AS sources,
  CASE conv_id % 3 WHEN 0 THEN {EMPTY} WHEN 1 THEN {words('text')} ELSE ['zzz'] END AS wanted,
  CASE WHEN turn % 7 = 3 THEN [['nope']] WHEN turn % 2 = 0 THEN []::VARCHAR[][]
    WHEN turn % 7 = 5 THEN list_transform({words('text')}, lambda w: [w || 'zzz', 'the'])
    ELSE list_transform({words('text')}, lambda w: [w, 'zzz']) END AS terms,
  conv_id % 2 = 0 AS allow, {pick(['rooms', 'lore', None], 'conv_id % 3')} AS category,
  (conv_id * 13 + turn) % 101 AS latency_ms
FROM conversations WHERE role = 'assistant'""")
cte("v_answer_rows", f"""
SELECT *, len(sources) > 0 AS present, CASE WHEN len(wanted) = 0 THEN len(sources) > 0
    ELSE list_has_any(list_transform(wanted, lambda x: {fold('x')}),
      list_transform(sources, lambda x: {fold('x')})) END AS hit,
  regexp_matches(answer, '\\[\\d+\\]') AS cited, CASE WHEN len(terms) = 0 THEN 1.0
    ELSE len(list_filter(terms, lambda a: len(list_filter(a, lambda t: contains({fold('answer')},
      {fold('t')}))) > 0)) / len(terms)::DOUBLE END AS coverage,
  {contains_any(fold('answer'), fixed.INSUFFICIENT_CONTEXT_MARKERS)} AS lacking FROM v_answers""")
oracle("answer_metrics", f"""
SELECT category, grouping(category) = 1 AS is_overall, count(*) AS total,
  {avg6('present::INT')} AS source_presence, {avg6('hit::INT')} AS source_hit,
  {avg6('cited::INT')} AS citation_presence, {avg6('coverage')} AS answer_term_coverage,
  {avg6('(present AND cited AND hit AND coverage >= 1 AND NOT (lacking AND NOT allow))::INT')}
    AS grounded_answer_rate,
  {avg6('(allow OR NOT lacking)::INT')} AS no_unexpected_insufficient_context,
  {avg6('latency_ms::DOUBLE')} AS avg_latency_ms, 0.0::DOUBLE AS avg_answer_latency_ms
FROM v_answer_rows GROUP BY GROUPING SETS ((), (category))
HAVING grouping(category) = 1 OR category IS NOT NULL""")

# ---- requests --------------------------------------------------------------

cte("v_turns", f"""
SELECT conv_id, turn, role, conv_id::VARCHAR AS session_id, conv_id || ':' || turn AS request_id,
  CASE WHEN role = 'user' THEN {pick(b.REQUEST_LEADS, '(conv_id * 7 + turn) % 11')} || text
    ELSE text END AS content FROM conversations""")
cte("v_requests", f"""
SELECT *, content AS message, {pick([None, None, 'bg3', 'nope', 'auto', None], '(conv_id + turn) % 6')}
  AS explicit_game_id FROM v_turns WHERE role = 'user'""")
cte("v_guard", f"""
SELECT *, CASE WHEN {contains_any(fold('message'), fixed.PROMPT_EXTRACTION_MARKERS)}
    THEN 'system_prompt_extraction' WHEN {contains_any(fold('message'), fixed.SECRET_MARKERS)}
    THEN 'secret_exfiltration' END AS reason FROM v_requests""")
oracle("request_guard", f"""
SELECT request_id, reason IS NULL AS allowed, reason, CASE reason WHEN 'secret_exfiltration'
  THEN {lit(fixed.BLOCKED_SECRET_ANSWER)} WHEN 'system_prompt_extraction'
  THEN {lit(fixed.BLOCKED_PROMPT_ANSWER)} END AS answer FROM v_guard""")
ROUTES = " ".join(
    f"WHEN {contains_any(fold('message'), markers)} THEN struct_pack(g := {lit(tenant)}, m := 'keyword', "
    f"c := 0.7::DOUBLE, r := {lit(reason)})"
    for tenant, markers, reason in fixed.TENANT_MARKERS
)
cte("v_routed", f"""
SELECT *, CASE
  WHEN {fold('explicit_game_id')} NOT IN ('', 'auto', 'detect') AND explicit_game_id IN ('bg3', 'blue_prince')
    THEN struct_pack(g := explicit_game_id, m := 'explicit', c := 1.0::DOUBLE,
      r := 'User or UI provided game_id.')
  WHEN {fold('explicit_game_id')} NOT IN ('', 'auto', 'detect')
    THEN struct_pack(g := 'bg3', m := 'invalid_explicit', c := 0.0::DOUBLE,
      r := 'Unknown explicit game_id: ' || explicit_game_id || '.')
  {ROUTES}
  ELSE struct_pack(g := 'bg3', m := 'default', c := 0.0::DOUBLE, r := 'No reliable game signal found.')
  END AS rt FROM v_requests""")
oracle("tenant_route", """
SELECT request_id, rt.g AS game_id, rt.m AS method, rt.c AS confidence, rt.r AS routing_reason FROM v_routed""")

STORED = f"role IN ({', '.join(lit(r) for r in fixed.SESSION_ROLES)}) AND content <> ''"
oracle("session_tail", f"""
SELECT session_id, turn, role, row_number() OVER (PARTITION BY session_id ORDER BY turn)::INTEGER AS position
FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn DESC) AS back
  FROM v_turns WHERE {STORED}) WHERE back <= {fixed.SESSION_TURNS}""")
low = strip(fold("content"))
follow = (
    f"({low} <> '' AND ({contains_any(low, fixed.FOLLOW_UP_PHRASES)} OR list_has_any(string_split("
    f"{squeeze(f'''translate({low}, '?.,', '   ')''')}, ' '), {lits(fixed.FOLLOW_UP_WORDS)})))"
)
cte("v_memory", f"""
SELECT *, CASE WHEN {follow} THEN array_to_string(recent[-2:], ' | ') ELSE '' END AS ctx FROM (
  SELECT *, list({strip('content')}) FILTER (role = 'user' AND {strip('content')} <> '') OVER (
    PARTITION BY session_id ORDER BY turn ROWS BETWEEN {fixed.SESSION_TURNS} PRECEDING AND 1 PRECEDING)
    AS recent FROM v_turns WHERE {STORED}) WHERE role = 'user'""")
cte("v_memory_row", """
SELECT session_id, turn, coalesce(ctx, '') AS ctx, content FROM v_memory""")
oracle("memory_context", """
SELECT session_id, turn, md5(ctx) AS context_md5, md5(CASE WHEN ctx = '' THEN content
  ELSE 'Previous user context: ' || ctx || chr(10) || 'Follow-up question: ' || content END) AS search_md5
FROM v_memory_row""")

oracle("stream_sessions", f"""
SELECT session_id, turn, role FROM (
  SELECT conv_id::VARCHAR AS session_id, turn, role, row_number() OVER (PARTITION BY conv_id
    ORDER BY turn DESC) AS back FROM conversations
  WHERE role IN ('user', 'assistant') AND text <> '') WHERE back <= {fixed.SESSION_TURNS}""")

# ---- tools -----------------------------------------------------------------

cte("v_tool_words", f"""
SELECT request_id, rt.g AS game_id, message, list_transform({words(
    f"regexp_replace(message, '(?i){phrase}', {lit(phrase_new)}, 'g')")},
  lambda w: struct_pack(w := w, n := {MAP}[{fold('w')}])) AS m FROM v_routed""")
cte("v_tool_text", f"""
SELECT request_id, game_id, CASE WHEN {joined(toks('message'), ' ')} = {joined(toks('rw'), ' ')}
  THEN message ELSE message || ' ' || rw END AS t FROM (SELECT *, array_to_string(list_filter(
    list_transform(m, lambda x: coalesce(x.n, x.w)), lambda x: x <> ''), ' ') AS rw FROM v_tool_words)""")
cte("v_tool_hits", f"""
SELECT request_id, list(canonical_name ORDER BY instr(n, normalized_name), canonical_name) AS names
FROM (SELECT request_id, game_id, {entity_name('t')} AS n FROM v_tool_text WHERE game_id = 'bg3'
  AND {has_word('t', fixed.COMPARISON_TOOL_WORDS)}) t
JOIN v_game_entities e ON e.game_id = t.game_id AND e.content_type = 'spell' AND normalized_name <> ''
  AND contains(n, normalized_name) GROUP BY request_id""")
topic = squeeze("t")
TOPIC = f"CASE WHEN length({topic}) > {fixed.HINT_TOPIC_CHARS} THEN rtrim({topic}[1:{fixed.HINT_TOPIC_CHARS}]) ELSE {topic} END"
cte("v_tools", f"""
SELECT request_id, game_id, CASE
    WHEN game_id = 'bg3' AND len(names) >= 2 THEN struct_pack(tool := 'compare_bg3_spells',
      args := 'limit=5|spell_a=' || names[1] || '|spell_b=' || names[2])
    WHEN game_id = 'bg3' AND {contains_any(fold('t'), fixed.TOOL_RULES[1]['trigger_terms'])}
      THEN struct_pack(tool := 'list_bg3_companions', args := 'limit=50')
    WHEN game_id = 'blue_prince' AND {contains_any(fold('t'), fixed.TOOL_RULES[2]['trigger_terms'])}
      THEN struct_pack(tool := 'search_puzzle_hint', args := 'limit=5|topic=' || {TOPIC}) END AS s
FROM v_tool_text LEFT JOIN v_tool_hits USING (request_id)""")
oracle("tool_routing", """
SELECT request_id, game_id, s.tool AS tool, s.args AS arguments FROM v_tools""")
cte("v_expected_tools", f"""
SELECT request_id, {pick(['comparison', 'list', None], 'turn % 3')} AS category,
  CASE (conv_id * 7 + turn) % 11 WHEN 2 THEN 'compare_bg3_spells' WHEN 3 THEN 'search_puzzle_hint'
    WHEN 4 THEN 'list_bg3_companions' END AS expected, (conv_id + turn) % 17 AS latency_ms FROM v_requests""")
oracle("tool_metrics", f"""
SELECT category, grouping(category) = 1 AS is_overall, count(*) AS total,
  {avg6('(expected IS NOT DISTINCT FROM s.tool)::INT')} AS accuracy,
  {avg6('latency_ms::DOUBLE')} AS avg_latency_ms
FROM v_expected_tools JOIN v_tools USING (request_id) GROUP BY GROUPING SETS ((), (category))
HAVING grouping(category) = 1 OR category IS NOT NULL""")

# ---- prompts and sources ---------------------------------------------------

block = "'[' || rank || '] ' || title || ' / ' || section || ' / ' || content_type || chr(10) || text"
guard_line = lit(fixed.PROMPT_GUARD_LINE)
cte("v_prompts", f"""
SELECT r.query_id, 'Game: en' || chr(10) || 'Question: ' || any_value(q.query) || chr(10) || chr(10)
  || {guard_line} || chr(10) || 'Retrieved context:' || chr(10)
  || string_agg({block}, chr(10) || chr(10) ORDER BY rank) || chr(10) || chr(10)
  || {lit(fixed.PROMPT_TAIL)} AS prompt,
  string_agg(rank || '~' || title || '~' || section || '~' || source_url, '|' ORDER BY rank) AS sources
FROM v_results r JOIN v_queries q USING (query_id) GROUP BY r.query_id""")
oracle("prompt_pack", "SELECT query_id, md5(prompt) AS prompt_md5, sources FROM v_prompts")
cte("v_result_q", "SELECT r.*, q.query FROM v_results r JOIN v_queries q USING (query_id)")
policy_cte("v_rpolicy", "v_result_q")
oracle("source_mix", """
SELECT query_id, source_mix, coalesce(policy_reasons, '') AS policy_reasons FROM (SELECT query_id, string_agg(source_id || '=' || n, '|'
  ORDER BY source_id) AS source_mix FROM (SELECT query_id, source_id, count(*) AS n FROM v_results
  GROUP BY ALL) GROUP BY query_id) LEFT JOIN (SELECT query_id, coalesce(string_agg(policy, '|' ORDER BY first), '') AS policy_reasons
  FROM (SELECT query_id, policy, min(rank) AS first FROM v_rpolicy WHERE policy <> '' GROUP BY ALL)
  GROUP BY query_id) USING (query_id)""")

# ---- answer cache, limits --------------------------------------------------


def js(x: str) -> str:
    return f"to_json({x})::VARCHAR"


cte("v_cache_keys", f"""
SELECT ord AS question_id, 'answers:v1:' || sha256('{{"chunk_fingerprints": [' ||
  {js("title || ':' || section || ':' || source_url || ':' || sha256(text)")} || '], "game_id": ' ||
  {js('game_id')} || ', "model": "unknown", "prompt_version": "{fixed.PROMPT_VERSION}", "provider": "unknown", "question": '
  || {js('title')} || ', "retrieval_query": ' || {js('title')} || ', "temperature": 0}}') AS cache_key
FROM v_corpus""")
cte("v_cache", """
SELECT k.cache_key, 'quality ' || quality AS answer,
  TIMESTAMP '2024-02-01 00:00:00' - to_days((k.question_id % 3)::INTEGER) AS created_at
FROM v_cache_keys k JOIN labels l ON l.doc_id = k.question_id""")
oracle("answer_cache_lookup", f"""
SELECT question_id, cache_key, answer, CASE WHEN answer IS NULL THEN 'miss' ELSE 'hit' END AS cache_status
FROM v_cache_keys LEFT JOIN (SELECT cache_key, arg_max(answer, created_at) AS answer FROM v_cache
  WHERE epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(created_at) < {fixed.ANSWER_CACHE_TTL_SECONDS}
  GROUP BY cache_key) USING (cache_key)""")
oracle("cache_purge", """
SELECT 'answers:v1*' AS pattern, m.matched, CASE WHEN d.dry_run THEN 0 ELSE m.matched END AS deleted,
  d.dry_run, 0::BIGINT AS remaining FROM (SELECT count(*) AS matched FROM v_cache) m,
  (VALUES (true), (false)) d(dry_run)""")
LIMITS = """
SELECT hit_id, client, minute_count, day_count, CASE WHEN minute_count > 1 THEN 'minute'
  WHEN day_count > 5 THEN 'day' END AS limit_name,
  (CASE WHEN minute_count > 1 THEN 60 WHEN day_count > 5 THEN 86400 END)::INTEGER AS retry_after FROM (
  SELECT event_id AS hit_id, user_id AS client,
    row_number() OVER (PARTITION BY user_id, date_trunc('minute', ts) ORDER BY ts, event_id) AS minute_count,
    row_number() OVER (PARTITION BY user_id, date_trunc('day', ts) ORDER BY ts, event_id) AS day_count
  FROM events)"""
oracle("rate_limit", LIMITS)
oracle("stream_rate_limit", LIMITS)
oracle("stream_windows", """
SELECT strftime(ts, '%Y-%m-%d') AS day, user_id AS client, count(*) AS n FROM events GROUP BY ALL""")

# ---- crawl, manifests, index -----------------------------------------------

cte("v_state", f"""
SELECT doc_id, ord, game_id, 'old/' || doc_id AS raw_path, {content_hash(
    "CASE WHEN quality = 1 THEN text_en ELSE 'old ' || text_en END")} AS content_hash,
  TIMESTAMP '2024-02-01 00:00:00' - to_days((ord % 14)::INTEGER) AS seen, 'e' || ord AS etag
FROM v_raw JOIN (SELECT doc_id AS ord, quality FROM labels) USING (ord)""")
cte("v_landed", f"""
SELECT doc_id, {pick(['304', '500', '404', None, *['200'] * 6], 'ord % 10')}::INTEGER AS code,
  'n' || ord AS etag FROM v_raw""")
cte("v_plan", f"""
SELECT r.doc_id, r.game_id, r.source_id, l.code, l.etag, CASE WHEN l.code < 300 THEN
    {content_hash('r.text_en')} END AS content_hash, s.etag AS if_none_match,
  CASE WHEN s.doc_id IS NOT NULL AND epoch(TIMESTAMP '2024-02-01 00:00:00') - epoch(s.seen)
      < {fixed.CRAWL_TTL_HOURS * 3600} THEN 'cached'
    WHEN l.code IS NULL THEN 'to_fetch' WHEN l.code = 304 AND s.doc_id IS NOT NULL THEN 'not_modified'
    WHEN l.code >= 400 AND s.doc_id IS NOT NULL THEN 'cached_stale_http_' || l.code
    WHEN l.code >= 300 THEN 'failed_http_' || l.code
    WHEN s.content_hash = {content_hash('r.text_en')} THEN 'unchanged' ELSE 'fetched' END AS status
FROM v_raw r LEFT JOIN v_state s USING (doc_id) LEFT JOIN v_landed l USING (doc_id)""")
oracle("crawl_plan", "SELECT doc_id, status, content_hash, if_none_match FROM v_plan")
cte("v_new_state", """
SELECT coalesce(s.doc_id, p.doc_id) AS doc_id, coalesce(p.game_id, s.game_id) AS game_id,
  CASE WHEN p.w THEN 'raw/' || p.game_id || '/' || p.source_id || '/' || translate(p.doc_id, ':/', '__')
    || '.json' ELSE s.raw_path END AS raw_path,
  CASE WHEN p.w THEN p.content_hash ELSE s.content_hash END AS content_hash,
  (CASE WHEN p.w THEN p.code WHEN p.status = 'not_modified' THEN 304 ELSE 200 END)::INTEGER AS status_code,
  CASE WHEN p.w THEN p.etag ELSE s.etag END AS etag,
  CASE WHEN p.w THEN TIMESTAMP '2024-02-01 00:00:00' ELSE s.seen END AS fetched_at,
  CASE WHEN p.w OR p.status = 'not_modified' THEN TIMESTAMP '2024-02-01 00:00:00' ELSE s.seen END AS checked_at
FROM v_state s FULL OUTER JOIN (SELECT *, status IN ('fetched', 'unchanged') AS w FROM v_plan) p USING (doc_id)
WHERE s.doc_id IS NOT NULL OR p.w""")
oracle("crawl_merge", """
SELECT * REPLACE (strftime(fetched_at, '%Y-%m-%d %H:%M:%S') AS fetched_at,
  strftime(checked_at, '%Y-%m-%d %H:%M:%S') AS checked_at) FROM v_new_state""")
# The stream has no stale fallback; neither kind of failure changes the state.
oracle("stream_crawl", "SELECT doc_id, content_hash, status_code, etag FROM v_new_state")

cte("v_refs", """
SELECT game_id || ':' || replace(title, ' ', '_') AS doc_id, title, content_type, ord FROM v_raw""")
cte("v_deduped", """
SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r
  FROM v_refs) WHERE r = 1""")
oracle("manifest_dedupe", "SELECT doc_id, title, content_type, ord FROM v_deduped")
oracle("manifest_check", """
SELECT game_id || '/' || source_id AS category FROM v_raw EXCEPT
SELECT game_id || '/' || source_id FROM v_raw JOIN labels ON labels.doc_id = ord""")
oracle("even_sample", """
SELECT doc_id, content_type, position::INTEGER AS position FROM (
  SELECT *, row_number() OVER (ORDER BY CASE WHEN n > 101 THEN r END, CASE WHEN n > 101 THEN first END, ord)
    AS position FROM (
    SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY ord) AS r, count(*) OVER () AS n,
      min(ord) OVER (PARTITION BY content_type) AS first FROM v_deduped)) WHERE position <= 101""")
cte("v_budget", """
SELECT * FROM (VALUES (0, 'spell', 30), (1, 'item', 25), (2, 'mechanic', 20), (3, 'character', 18))
  t(type_ord, content_type, budget)""")
cte("v_share", """
SELECT *, least(greatest(1, floor(exact)), have) AS base FROM (
  SELECT b.*, 101.0 * budget / (SELECT sum(budget) FROM v_budget) AS exact,
    (SELECT count(*) FROM v_deduped d WHERE d.content_type = b.content_type) AS have FROM v_budget b)""")
cte("v_alloc", """
SELECT *, base + CASE WHEN base < have AND row_number() OVER (PARTITION BY base < have
  ORDER BY exact - floor(exact) DESC, content_type DESC) <= 101 - (SELECT sum(base) FROM v_share)
  THEN 1 ELSE 0 END AS alloc FROM v_share""")
cte("v_chosen", """
SELECT d.*, a.type_ord, d.r FROM (SELECT *, row_number() OVER (PARTITION BY content_type ORDER BY ord) AS r
  FROM v_deduped) d JOIN v_alloc a USING (content_type) WHERE d.r <= a.alloc
ORDER BY type_ord, r LIMIT 101""")
oracle("budget_sample", """
SELECT doc_id, content_type, position::INTEGER AS position FROM (
  SELECT *, row_number() OVER (ORDER BY phase, type_ord, r) AS position FROM (
    SELECT doc_id, content_type, 0 AS phase, type_ord, r FROM v_chosen UNION ALL
    SELECT doc_id, content_type, 1, 0, ord FROM v_deduped
    WHERE doc_id NOT IN (SELECT doc_id FROM v_chosen))) WHERE position <= 101""")
cte("v_list_rows", f"""
SELECT struct_pack(o := ord, i := i) AS ord, content_type, i,
  CASE WHEN i % 7 = 0 THEN 'List of ' ELSE '' END || {spoken('line')} AS title FROM v_thread_lines""")
cte("v_list_a", f"""
SELECT 'wiki_a:' || replace(title, ' ', '_') AS doc_id,
  'https://a.example/wiki/' || url_encode(replace(title, ' ', '_')) AS source_url, title, content_type, ord
FROM v_list_rows WHERE title <> '' AND NOT {starts_any(fold('title'), fixed.WIKI_A_SKIP_PREFIXES)}""")
cte("v_list_b", f"""
SELECT 'wiki_b:' || replace(title, ' ', '_') AS doc_id,
  'https://b.example/wiki/' || replace(url_encode(replace(title, ' ', '_')), '%3A', ':') AS source_url, title,
  {content_type_of('title', pick(['Rooms', 'Keys', 'Lore pages', 'Safe codes', 'Other'], 'i % 5'))} AS content_type, ord
FROM v_list_rows WHERE title <> '' AND NOT {starts_any(fold('title'), fixed.WIKI_B_SKIP_PREFIXES)}""")
oracle("manifest_listing", """
SELECT doc_id, source_url, title, content_type FROM (
  SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ord) AS r FROM (
    SELECT * FROM v_list_a UNION ALL SELECT * FROM v_list_b)) WHERE r = 1""")
SEED = list(fixed.SEED_BUDGETS)
cte("v_seed", f"""
SELECT ord, {pick(SEED, 'ord % 5')} AS category,
  {pick([fixed.SEED_CONTENT_TYPES[c] for c in SEED], 'ord % 5')} AS content_type,
  ({'[' + ', '.join(str(v) for v in fixed.SEED_BUDGETS.values()) + ']'})[ord % 5 + 1] AS budget,
  replace(title, ' ', '_') || CASE WHEN ord % 4 = 0 THEN '%27s' ELSE '' END AS page FROM v_raw""")
cte("v_urls", """
SELECT 'https://forum.example/r/games/' || CASE page_id % 3
  WHEN 0 THEN 'comments/' || page_id || '/patch_' || page_id || '?x=1'
  WHEN 1 THEN 'comments/' || page_id || '/some_title/' ELSE url END AS url FROM pages""")
TAIL = "lower(regexp_replace(regexp_replace(url, '[^a-zA-Z0-9]+', '_', 'g'), '^_+|_+$', '', 'g'))"
cte("v_slugs", f"""
SELECT url, CASE WHEN regexp_matches(url, '/comments/([^/]+)/([^/?#]+)')
  THEN regexp_extract(url, '/comments/([^/]+)/([^/?#]+)', 1) || '_' ||
    regexp_extract(url, '/comments/([^/]+)/([^/?#]+)', 2)
  ELSE right({TAIL}, 120) END AS s FROM v_urls""")
PAGE_TITLE = "replace(replace(page, '_', ' '), '%27', '''')"
oracle("manifest_seed", f"""
SELECT 'wiki_a:' || page AS doc_id, 'https://a.example/wiki/' || page AS source_url, {PAGE_TITLE} AS title,
  content_type FROM (SELECT *, row_number() OVER (PARTITION BY category ORDER BY ord) AS r FROM v_seed)
WHERE r <= budget
UNION ALL SELECT 'wiki_b:' || page, 'https://b.example/wiki/' || replace(url_encode(page), '%3A', ':'),
  {PAGE_TITLE}, content_type FROM v_seed
UNION ALL SELECT 'forum:' || s, url, trim(replace(s, '_', ' ')),
  CASE WHEN contains(s, 'patch') THEN 'patch_note' ELSE 'community_tip' END FROM v_slugs""")
oracle("point_ids", f"""
SELECT {point_id('chunk_id')} AS point_id, chunk_id, game_id, source_id, title FROM v_corpus""")
cte("v_changed", "SELECT c.* REPLACE (text || ' v2' AS text) FROM v_corpus c JOIN labels ON labels.doc_id = ord")


def index_sql(fresh: str, kept: str) -> str:
    return f"""
SELECT {point_id('chunk_id')} AS point_id, chunk_id, game_id, source_id, md5(text) AS md5 FROM (
  SELECT chunk_id, game_id, source_id, text FROM v_changed WHERE {fresh} UNION ALL
  SELECT chunk_id, game_id, source_id, text FROM v_corpus WHERE {kept}
    AND chunk_id NOT IN (SELECT chunk_id FROM v_changed WHERE {fresh}))"""


oracle("index_append", index_sql("game_id = 'en'", "true"))
SLICE = "game_id = 'en' AND source_id = 'src1_wiki'"
oracle("index_rebuild_source", index_sql(SLICE, f"NOT ({SLICE})"))
oracle("index_rebuild_game", index_sql(SLICE, "game_id <> 'en'"))
oracle("embed_batch", f"""
SELECT {point_id('chunk_id')} AS point_id, chunk_id, 64 AS dimensions, round(e[1], 6) AS first_value FROM v_emb""")
oracle("stream_index", f"""
SELECT {point_id('chunk_id')} AS point_id, chunk_id, game_id, source_id, md5(text) AS md5 FROM v_corpus""")

# After the deliveries: new versions of labelled documents; of a rebuilt source only what came again.
cte("v_delivered", """
SELECT c.* REPLACE (CASE WHEN doc_id IS NULL THEN text WHEN source_id = 'src1_wiki' THEN text || ' v3'
  ELSE text || ' v2' END AS text) FROM v_corpus c LEFT JOIN (SELECT DISTINCT doc_id FROM labels) ON doc_id = ord
WHERE source_id <> 'src1_wiki' OR doc_id IS NOT NULL OR game_id NOT IN (SELECT game_id FROM v_corpus
  JOIN labels ON doc_id = ord WHERE source_id = 'src1_wiki')""")
bm25_ctes("d", "v_delivered", "v_queries")
oracle("stream_postings", """
SELECT term, df, n AS total_documents, round(avgdl, 6) AS average_length FROM v_df_d, v_stats_d""")
oracle("stream_bm25", """
SELECT query_id, chunk_id, bm25_score, score, rank::INTEGER AS rank FROM v_bm25_d WHERE rank <= 5""")
oracle("stream_cache", f"""
SELECT kind || ':' || question_id AS event_id, cache_key, answer,
  CASE WHEN answer IS NULL THEN 'miss' ELSE 'hit' END AS cache_status
FROM (SELECT *, unnest([0, 1]) AS half FROM v_cache_keys)
JOIN (VALUES (0, 'now'), (1, 'later')) k(half, kind) USING (half)
LEFT JOIN (SELECT half, cache_key, arg_max(answer, created_at) AS answer
  FROM v_cache, (VALUES (0), (1)) h(half)
  WHERE epoch(TIMESTAMP '2024-02-01 00:00:00') + half * {fixed.ANSWER_CACHE_TTL_SECONDS} / 2
    - epoch(created_at) < {fixed.ANSWER_CACHE_TTL_SECONDS}
  GROUP BY ALL) USING (half, cache_key)""")

# ---- files and reports -----------------------------------------------------

oracle("landed_documents", """
SELECT doc_id, game_id, source_id, title, content_type, md5(text_en) AS text_md5, strftime(
  TIMESTAMP '2024-01-01 00:00:00' + to_minutes((ord % 1440)::INTEGER), '%Y-%m-%d %H:%M:%S') AS fetched_at
FROM v_raw WHERE game_id = 'en'""")
oracle("landed_stream", """
SELECT game_id, source_id, count(*) AS n, sum(length(text_en))::BIGINT AS n_chars FROM v_raw GROUP BY ALL""")
oracle("raw_json_documents", """
SELECT doc_id, game_id, source_id, title, md5(text_en) AS text_md5 FROM v_raw""")
ORACLES["entity_files"] = ORACLES["entity_registry"]
oracle("golden_answers", f"""
SELECT conv_id || ':' || turn AS id, array_to_string({words('text')}, ' ') AS query,
  CASE WHEN turn % 2 = 0 THEN 'blue_prince' ELSE {lit(fixed.DEFAULT_TENANT)} END AS game_id,
  0 AS n_titles, array_to_string(list_transform({words('text')}, lambda w, i: CASE (i - 1) % 3
    WHEN 0 THEN w WHEN 1 THEN w || '~or' ELSE '["' || w || '"]' END), '|') AS terms,
  false AS allow_insufficient_context
FROM conversations WHERE role = 'user'""")
oracle("hybrid_merge_keys", """
SELECT query_id, md5(CASE WHEN ord % 3 <> 0 THEN chunk_id
    ELSE source_url || '|' || title || '|' || section || '|' || text END) AS result_key,
  m.score, bm25_score, retrieval_source, list_no, list_rank
FROM v_merged m JOIN v_corpus USING (chunk_id)""")
oracle("answer_report", """
SELECT id, category, 'about ' || lower(coalesce(sources[1], '')) AS retrieval_query,
  len(sources)::INTEGER AS n_sources, 'https://wiki.example/' || sources[1] AS first_url,
  hit AS source_hit, cited AS citation_present, round(coverage, 6) AS answer_term_coverage,
  lacking AS insufficient_context, latency_ms FROM v_answer_rows""")
oracle("tool_report", """
SELECT request_id AS id, t.game_id, category, expected AS expected_tool, s.tool AS selected_tool,
  expected IS NOT DISTINCT FROM s.tool AS passed, latency_ms, md5(message) AS query_md5
FROM v_tools t JOIN v_expected_tools USING (request_id) JOIN v_requests USING (request_id)""")
cte("v_cmp_routed", """
SELECT a.ord::VARCHAR AS request_id, struct_pack(g := 'bg3') AS rt,
  'compare ' || a.title || ' and ' || b.title AS message
FROM v_game_corpus a JOIN v_game_corpus b ON b.ord = a.ord + 20
WHERE a.game_id = 'bg3' AND b.game_id = 'bg3' AND a.content_type = 'spell' AND b.content_type = 'spell'""")
for part in ("words", "text", "hits", "s"):  # the steps from routed requests to tools, for these questions
    own = "v_tools" if part == "s" else f"v_tool_{part}"
    body = CTES[own].replace("v_routed", "v_cmp_routed").replace("v_tool_", "v_cmp_")
    cte("v_cmp_tools" if part == "s" else f"v_cmp_{part}", body)
oracle("tool_entities", f"""
SELECT request_id, 'compare_bg3_spells' AS tool, argument, name, canonical_name, content_type, source_url
FROM (SELECT request_id, unnest(['spell_a', 'spell_b']) AS argument, unnest([names[1], names[2]]) AS name
  FROM v_cmp_tools JOIN v_cmp_hits USING (request_id) WHERE s.tool = 'compare_bg3_spells')
LEFT JOIN (SELECT *, row_number() OVER (PARTITION BY normalized_name
  ORDER BY {fold('canonical_name')}, canonical_name) AS r FROM v_game_entities WHERE game_id = 'bg3')
  ON r = 1 AND normalized_name = {entity_name('name')}""")
ORACLES["corpus_union"] = ORACLES["chunk_table"]
oracle("golden_retrieval", f"""
SELECT conv_id || ':' || turn AS id, {joined(words('text'), ' ')} AS query,
  CASE WHEN turn % 2 = 0 AND conv_id % 2 = 0 THEN 'blue_prince' ELSE {lit(fixed.DEFAULT_TENANT)} END AS game_id,
  CASE WHEN turn % 2 = 0 THEN 'items' END AS category, {joined(words('text'))} AS titles,
  CASE WHEN turn % 3 <> 0 THEN len({words('text')}) ELSE 0 END::INTEGER AS n_terms,
  CASE WHEN turn % 4 = 0 THEN conv_id || ':' || turn ELSE '' END AS sources
FROM conversations WHERE role = 'user'""")
oracle("golden_tools", f"""
SELECT request_id AS id, 'ask ' || request_id AS query, {lit(fixed.DEFAULT_TENANT)} AS game_id,
  expected AS expected_tool, category FROM v_expected_tools""")
