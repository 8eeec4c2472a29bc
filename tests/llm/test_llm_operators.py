"""Every corpus operator against a brute-force version, and its edge cases."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from loreloom.llm import bpe, decontaminate, exact, jaccard, mainblocks, substrings, suffixes, toxicity, warc
from loreloom.llm import wordpiece
from loreloom.llm.common import keyed
from loreloom.llm.components import components
from loreloom.llm.queries import ORACLES, QUERIES, vocabulary_path

SCHEMA = "doc_id bigint, text string"
ODD = [
    (1, None), (2, ""), (3, "   \n\t"), (4, "a"), (5, "same words in a row"), (5, "same words in a row"),
    (6, "same  words\tin a row"), (None, "same words in a row"), (7, "é ñ 日本 Σ"), (8, "x " * 30_000),
]


def table(spark, rows, schema=SCHEMA):
    return keyed(spark.createDataFrame(rows, schema))


def empty(spark):
    return table(spark, [])


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def noise(seed, count=40, letters="ab cd"):
    chance = random.Random(seed)
    texts = ["".join(chance.choice(letters) for _ in range(chance.randint(0, 90))) for _ in range(count)]
    return [*texts, *chance.sample(texts, 5), None, texts[0] + texts[1], "a" * 70, "a" * 71]


# ---- exact duplicates ----


def test_exact_groups_equal_brute_force(spark):
    rows = [*ODD, *((20 + i, t) for i, t in enumerate(noise(1)))]
    docs = table(spark, rows)
    texts = defaultdict(list)
    for doc_id, text in rows:
        texts[re.sub(r"[\x20\x09-\x0D]+", " ", text or "")].append(doc_id)
    want = sorted(
        (str(i), str(min((x for x in ids if x is not None), default=None)), len(ids))
        for ids in texts.values() for i in ids
    )
    got = exact.exact_groups(docs).collect()
    assert sorted((str(r["doc_id"]), str(r["keep_id"]), r["group_size"]) for r in got) == want
    assert sum(r["kept"] for r in got) == len(texts)
    assert exact.exact_groups(empty(spark)).count() == 0


def test_block_names_of_long_texts(spark):
    chance = random.Random(3)
    texts = ["".join(chance.choice("ab") for _ in range(chance.randint(1, 14))) for _ in range(120)]
    docs = table(spark, list(enumerate(texts)))
    names = exact.identities(docs, block_chars=2).join(docs, "row_key").collect()
    same = {(r["n_blocks"], r["name"]) for r in names}
    assert len(same) == len(set(texts)) == len({(r["n_blocks"], r["name"], r["text"]) for r in names})


def test_kept_rows_keep_their_columns(spark):
    rows = [(1, "t t", "r", 0.5), (1, "t t", "r", 0.5), (2, "t  t", "s", 1.0), (3, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, row_key string, score double")
    for drop in (exact.drop_copies, jaccard.drop_near_duplicates):
        out = drop(docs)
        assert out.columns == docs.columns
        assert sorted((r["doc_id"], r["row_key"] or "") for r in out.collect()) == [(1, "r"), (3, "")]


# ---- Jaccard join ----


def linked(texts, width, percent):
    sets = []
    for text in texts:
        w = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(len(w) - width + 1)} or ({tuple(w)} if w else set()))
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a and sets[j] and 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return sets, label


@pytest.mark.parametrize(("width", "percent"), [(3, 90), (5, 80), (2, 50)])
def test_near_duplicates_equal_brute_force(spark, width, percent):
    chance = random.Random(width)
    base = [[chance.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(chance.randint(1, 120))] for _ in range(8)]
    texts = [t for _, t in ODD[:-1]]
    for w in base:
        for _ in range(9):
            copy = list(w)
            for _ in range(chance.randint(0, 3)):
                copy[chance.randrange(len(copy))] = chance.choice(["X", "y", "zz"])
            texts.append(" ".join(copy))
    sets, label = linked(texts, width, percent)
    groups = defaultdict(list)
    for i, x in enumerate(label):
        groups[x].append(i)
    got = {r["doc_id"]: r for r in jaccard.near_duplicates(table(spark, list(enumerate(texts))), width, percent).collect()}
    assert len(got) == len(texts)
    for i in range(len(texts)):
        assert got[i]["n_shingles"] == len(sets[i])
        assert got[i]["component"] == min(groups[label[i]])
        assert got[i]["kept"] == (i == min(groups[label[i]]))


@pytest.mark.parametrize("percent", [20, 50])
def test_texts_link_with_their_beginnings(spark, percent):
    texts = []
    for n in range(1, 40):
        words = [f"w{n}x{i}" for i in range(100 // percent * n + 1)]
        texts += [" ".join(words), " ".join(words[: n + 1])]
    got = jaccard.near_duplicates(table(spark, list(enumerate(texts))), 2, percent).collect()
    assert {r["doc_id"]: r["component"] for r in got} == {i: i - i % 2 for i in range(len(texts))}


def test_near_duplicates_of_nothing(spark):
    assert jaccard.near_duplicates(empty(spark)).count() == 0


def test_bitmap_bound_is_a_bound():
    chance = np.random.default_rng(5)
    for _ in range(100):
        a, b = (np.unique(chance.integers(0, 400, chance.integers(1, 200)).astype(np.uint64)) for _ in range(2))
        maps = [jaccard.bitmap(x, int(jaccard.bitmap_bits(np.array(len(x))))) for x in (a, b)]
        bound = jaccard.overlap_bound(maps[0], len(a), maps[1], len(b))
        assert len(np.intersect1d(a, b)) <= bound <= min(len(a), len(b))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(0, 60)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(components(links).collect())
    assert got == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100}


# ---- tokens ----


def test_ids_and_decoding_equal_the_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(vocabulary_path())
    texts = [
        *[t for _, t in ODD], "It's 42 <|endoftext|>x<|startoftext|> they've", "ababab" * 40, "#" * 400,
        "Łódź ẞ İ ﬁ \x1c\x85 ​", "x́ ͅ", *noise(4, 20),
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), SCHEMA).withColumn("ids", F.lit("taken"))
    got = {r["doc_id"]: r for r in bpe.encode_texts(docs, vocabulary_path()).collect()}
    for i, text in enumerate(texts):
        want = library.encode(text or "", add_special_tokens=False).ids
        assert got[i]["ids"] == want, text
        assert got[i]["decoded"] == library.decode(want, skip_special_tokens=False)
    assert bpe.encode_texts(empty(spark), vocabulary_path()).count() == 0


def test_piece_counts_equal_greedy_matching(spark):
    import json

    with open(vocabulary_path(), encoding="utf-8") as file:
        vocab = set(json.load(file)["model"]["vocab"])
    letters = bpe.byte_letters()

    def greedy(word):
        symbols = [letters[b] for b in word.encode()]
        symbols[-1] += "</w>"
        at = count = 0
        while at < len(symbols):
            end = len(symbols)
            while "".join(symbols[at:end]) not in vocab:
                end -= 1
            at, count = end, count + 1
        return count

    texts = [t for _, t in ODD[:-1]] + ["unbelievable antidisestablishmentarianism 日本語 " + "q" * 300, *noise(6, 30)]
    got = {r["doc_id"]: r for r in wordpiece.count_pieces(spark.createDataFrame(list(enumerate(texts)), SCHEMA), vocabulary_path()).collect()}
    for i, text in enumerate(texts):
        words = wordpiece.SPLIT.findall((text or "").lower())
        assert (got[i]["n_words"], got[i]["n_pieces"]) == (len(words), sum(map(greedy, words)))
    assert wordpiece.count_pieces(empty(spark), vocabulary_path()).count() == 0


# ---- repeats ----


def test_suffix_order_is_the_order_of_the_suffixes():
    chance = random.Random(8)
    spans = ["".join(chance.choice("abc") for _ in range(chance.randint(1, 60))).encode() for _ in range(30)]
    text = np.zeros(sum(len(s) + 1 for s in spans) + 56, dtype=np.uint8)
    at, places = 0, []
    for span in spans:
        text[at : at + len(span)] = np.frombuffer(span, np.uint8) + 1
        places += range(at, at + len(span))
        at += len(span) + 1
    wanted = np.zeros(len(text), dtype=bool)
    wanted[places] = True
    order = suffixes.suffix_order(text, wanted, 40)
    raw = text.tobytes()
    heads = [raw[p : p + 40].split(b"\0")[0] for p in order]
    assert sorted(order.tolist()) == places and heads == sorted(heads)


@pytest.mark.parametrize("shard", [2048, 2])
def test_bytes_that_start_earlier(spark, monkeypatch, shard):
    monkeypatch.setattr(suffixes, "SPANS_PER_SHARD", shard)
    rows = [*ODD[:-1], *((10 + i, t) for i, t in enumerate(noise(9)))]
    seen, want = set(), []
    for doc_id, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        raw = (text or "").encode()
        keep = [True] * len(raw)
        for i in range(len(raw) - 7):
            if raw[i : i + 8] in seen:
                keep[i : i + 8] = [False] * 8
            seen.add(raw[i : i + 8])
        kept = bytes(b for b, k in zip(raw, keep, strict=True) if k)
        runs = sum(not k and (i == 0 or keep[i - 1]) for i, k in enumerate(keep))
        want.append((str(doc_id), len(raw), len(raw) - len(kept), runs, kept))
    got = suffixes.drop_repeated_bytes(table(spark, rows), length=8, seed=3).collect()
    assert sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"], len(r["starts"] or []), bytes(r["kept"])) for r in got) == sorted(want)


def test_words_that_recur_anywhere(spark):
    chance = random.Random(10)
    texts = [" ".join(chance.choice("abc") for _ in range(chance.randint(0, 40))) for _ in range(30)]
    rows = [*ODD[:-1], *((10 + i, t) for i, t in enumerate([*texts, texts[0], "q " * 50]))]
    size = 6
    count = Counter(tuple(words_of(t)[i : i + size]) for _, t in rows for i in range(len(words_of(t)) - size + 1))
    want = []
    for doc_id, text in rows:
        w = words_of(text)
        keep = [True] * len(w)
        for i in range(len(w) - size + 1):
            if count[tuple(w[i : i + size])] > 1:
                keep[i : i + size] = [False] * size
        want.append((str(doc_id), len(w), keep.count(False), " ".join(x for x, k in zip(w, keep, strict=True) if k)))
    got = substrings.drop_repeats(table(spark, rows), words=size, seed=2).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept"]) for r in got) == sorted(want)


def test_repeats_of_nothing(spark):
    assert substrings.drop_repeats(empty(spark)).count() == suffixes.drop_repeated_bytes(empty(spark)).count() == 0


# ---- toxicity ----


def toxic_rows(count, seed):
    chance = random.Random(seed)
    plain = ["river", "stone", "window", "garden", "letter", "music", "winter", "paper"]
    rows = []
    for i in range(count):
        lines = [" ".join(chance.choices(plain, k=6)) for _ in range(5)]
        toxic = i % 4 == 0
        if toxic:
            lines[chance.randrange(5)] += " " + chance.choice(["vilething", "nastyword"])
        rows.append((i, ". ".join(lines), int(toxic)))
    return rows


def test_toxic_texts_and_their_sentences(spark):
    rows = toxic_rows(300, 11)
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(None, 1), (0, None)], "doc_id bigint, toxic int")
    docs = spark.createDataFrame([(i, t, y) for i, t, y in rows], "doc_id bigint, text string, score int")
    scored = {r["doc_id"]: r for r in toxicity.score_texts(docs, labels).withColumn("out", toxicity.held_out()).collect()}
    held = [i for i in scored if scored[i]["out"]]
    assert held and all(scored[i]["predicted"] == rows[i][2] for i in held)
    for i, text, y in rows:
        if y:
            sentence = text.split(". ")[scored[i]["worst_sentence"]]
            assert "vilething" in sentence or "nastyword" in sentence
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and {r["score"] for r in kept.collect()} == {0}
    odd = {str(r["doc_id"]): r for r in toxicity.score_texts(spark.createDataFrame(ODD, SCHEMA), labels).collect()}
    assert odd["1"]["score"] == odd["2"]["score"] == 0 and odd["1"]["worst_sentence"] is None
    assert toxicity.score_texts(empty(spark).drop("row_key"), labels).count() == 0


def test_without_labels_nothing_is_toxic(spark):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    got = toxicity.score_texts(spark.createDataFrame(ODD, SCHEMA), none).collect()
    assert len(got) == len(ODD) and not any(r["predicted"] for r in got)


# ---- benchmark ----


def test_contaminated_texts(spark):
    chance = random.Random(12)
    item = [f"w{chance.randrange(10**6)}" for _ in range(40)]
    fill = lambda n: [f"v{chance.randrange(10**6)}" for _ in range(n)]
    near = [*item[:39], "other"]
    rows = [
        (1, " ".join([*fill(30), *item, *fill(5)])), (2, " ".join([*fill(9), *near])),
        (3, " ".join([*fill(9), *item[:20]])), (4, None), (5, " "), (6, " ".join(item).upper() + "!"),
        (7, "two words here"), (8, "two words"), (None, " ".join(item)),
    ]
    items = spark.createDataFrame([(0, " ".join(item)), (1, None), (2, ""), (3, "Two words")], "item_id int, text string")
    got = sorted((str(r["doc_id"]), r["item_id"], round(r["similarity"], 3), r["start"]) for r in decontaminate.contaminated(table(spark, rows), items).collect())
    assert got == [("1", 0, 1.0, 30), ("2", 0, round(35 / 37, 3), 8), ("6", 0, 1.0, 0), ("7", 3, 1.0, 0), ("8", 3, 1.0, 0), ("None", 0, 1.0, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("item_id", F.lit(1))
    left = decontaminate.drop_contaminated(docs, items)
    assert sorted(r["doc_id"] for r in left.collect()) == [3, 4, 5] and left.columns == docs.columns
    assert decontaminate.contaminated(empty(spark), items).count() == 0
    assert decontaminate.contaminated(table(spark, rows), items.limit(0)).count() == 0


def test_items_whose_tail_repeats_one_word_are_found(spark):
    chance = random.Random(13)
    items = [[f"w{chance.randrange(10**6)}" for _ in range(157)] for _ in range(8)]
    rows = [(i, " ".join(["lead", *item[:140], *["again"] * 17])) for i, item in enumerate(items)]
    benchmark = spark.createDataFrame([(i, " ".join(item)) for i, item in enumerate(items)], "item_id int, text string")
    got = decontaminate.contaminated(table(spark, rows), benchmark).collect()
    # The window that begins with the word before the item holds as much of it, and is the first.
    assert sorted((r["doc_id"], r["item_id"], r["similarity"], r["start"], r["n_words"]) for r in got) == [
        (i, i, 0.8, 0, 157) for i in range(8)
    ]


# ---- pages ----

PAGE = """<html><head><title>no</title><script>if (a < b) "</p>";</script></head><body>
<header><h1>Site</h1></header><nav><a href=1>Menu</a></nav><div class="cookie-notice">We use cookies.</div>
<main><article><h1>A  title</h1><p>First &amp; <b>bold</b><p>Second<br>line<div class="share">Share</div>
<aside>Beside</aside><form><label>Mail</label></form><p>Last.</p>
<section id="comments"><p>A long comment by a reader who had a lot to say about it.</p></section></article></main>
<div class="sidebar">More to read elsewhere</div><footer>&copy; 2024</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, "u", PAGE), (1, "u", PAGE), (2, None, None), (3, "", ""), (None, "v", "<article><p>cut &am")]
    got = mainblocks.extract_main_text(spark.createDataFrame(rows, "page_id int, text string, html string"))
    assert got.columns == ["page_id", "text"]
    texts = sorted((str(r["page_id"]), r["text"]) for r in got.collect())
    main = "A title\nFirst & bold\nSecond line\nLast."
    assert texts == [("1", main), ("1", main), ("2", ""), ("3", ""), ("None", "cut &am")]


def test_main_text_without_an_article():
    body = "<div id=menu><a>One</a> <a>Two</a></div><p>" + "word " * 40 + "</p><p>" + "text " * 50 + "</p>"
    assert mainblocks.main_texts([body])[0].split("\n") == [("word " * 40).strip(), ("text " * 50).strip()]


@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>no</title><body><article>{}</article>",
        "<html><head><title>no</title><meta charset=utf-8><article>{}</article>",
        "<head><title>no</title><script>var a = '<svg>';</script></head><article>{}<svg>no</svg></article>",
        "<article><svg width='1' />{}<math/></article><div class=sidebar><svg><text>no</text></svg></div>",
        "<article><svg><svg>no</svg><text>no</text></svg>{}</article>",
        "<article><iframe src=a>{}</article>", "<article><object data=a>{}</article>",
        "<article><noscript>{}</article>", "<article><template>{}</article>", "<article><svg>{}</article>",
        "<article><svg>{}<iframe>no</iframe><svg>no</svg></article>",
        "<article><select><option>no<option>no{}</article>",
        "<div class='layout-with-sidebar'><article>{}</article><div class=sidebar><p>no</div></div>",
        "<div class='has-sidebar'><main>{}</main></div>", "<div id='sidebar-right'><article>{}</article></div>",
        "<div class='sidebar-right'><article>{}</article><div class=sidebar><article>no</article></div></div>",
        "<div class='sidebar'><main>{}</main><div class=comments><article>no</article></div></div>",
        "<main>{}<div class=comments><article>no</article></div></main>",
    ],
)
def test_open_elements_and_layout_names_leave_the_article(page):
    lines = [" ".join(f"{word}{i}" for i in range(40)) for word in ("first", "second")]
    got = mainblocks.main_texts([page.format("".join(f"<p>{line}</p>" for line in lines))])
    assert got[0].split("\n") == lines


def test_many_open_elements_take_linear_time():
    assert mainblocks.main_texts(["<article>" + "<svg><iframe>" * 50_000 + "word " * 40])[0] == ("word " * 40).strip()


def test_pages_of_the_table_give_their_article(spark, data):
    import html

    got = {r["page_id"]: r["text"] for r in QUERIES["op7_html_text"](spark, data).collect()}
    for page_id, page in duckdb.sql(f"SELECT page_id, html FROM '{data}/pages.parquet'").fetchall():
        article = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ")
        parts = [re.sub(r"<[^>]*>", "", p) for p in re.split(r"</?(?:p|h1)>", article)]
        clean = [" ".join(html.unescape(p).split()) for p in parts]
        assert got[page_id] == "\n".join(p for p in clean if p)


# ---- archives ----


def test_archives_round_trip(spark, tmp_path):
    rows = [
        (1, "http://a/ b\n", "<p>same</p>"), (2, None, "<p>same</p>"), (2, None, "<p>same</p>"), (None, "c", "<p>same</p>"),
        (3, "d", None), (4, "e", ""), (5, "f", "é" * 5000), (6, "g", "\r\n\r\nWARC/1.1\r\n"),
    ]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string")
    archives = warc.materialise(warc.write_archives(warc.decided(pages)))
    read = warc.read_archives(archives).collect()
    by_id = defaultdict(list)
    for r in read:
        by_id[r["page_id"]].append((r["record_type"], r["refers_to"], r["payload_bytes"]))
    assert len(read) == len(rows)
    assert by_id[1] == by_id[None] == [("revisit", 2, 11)]
    assert sorted(by_id[2], key=str) == [("response", None, 11), ("revisit", 2, 11)]
    assert by_id[3] == [("revisit", 4, 0)] and by_id[4] == [("response", None, 0)]
    assert {bytes(r["payload"]).decode() for r in read if r["record_type"] == "response"} == {h or "" for _, _, h in rows}
    assert all(r["record_type"] == "response" for r in warc.archive_pages(pages, least_bytes=10**6).collect())
    assert warc.archive_pages(pages.limit(0)).count() == 0
    warc.export_archives(archives, f"file://{tmp_path}")
    files = list(tmp_path.glob("*.warc.zst"))
    assert sum(sum(h["WARC-Type"] != "warcinfo" for h, _ in warc.parsed(f.read_bytes())) for f in files) == len(rows)


def test_archives_have_a_dictionary():
    records = [f"WARC/1.1\r\nContent-Length: 0\r\nX: {i} common header text of all records\r\n\r\n\r\n\r\n".encode() for i in range(3000)]
    content, offsets = warc.compressed(records)
    assert int.from_bytes(content[:4], "little") == warc.DICTIONARY_FRAME and int.from_bytes(content[4:8], "little") > 0
    assert len(content) < sum(map(len, records)) / 2 and len(offsets) == len(records)
    assert [h["X"].split()[0] for h, _ in warc.parsed(content)] == [str(i) for i in range(3000)]


# ---- registered queries ----


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, data, name):
    connection = duckdb.connect()
    for view in ("documents", "benchmark", "embeddings", "labels"):
        connection.execute(f"CREATE VIEW {view} AS SELECT * FROM '{data}/{view}.parquet'")
    result = connection.execute(ORACLES[name])
    columns = [c[0] for c in result.description]
    frame = QUERIES[name](spark, data)
    assert sorted(columns) == sorted(frame.columns)
    assert sorted(str([r[c] for c in columns]) for r in frame.collect()) == sorted(str(list(r)) for r in result.fetchall())


def test_pipeline_equals_plain_python(spark, data):
    import corpus_pipeline
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{data}/documents.parquet")
    clean = {r["doc_id"] for r in toxicity.drop_toxic(docs, spark.read.parquet(f"{data}/labels.parquet")).collect()}
    texts = {i: t or "" for i, t in duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet' ORDER BY 1").fetchall() if i in clean}
    first = {}
    for i, t in texts.items():
        first.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t), i)
    kept = sorted(first.values())
    _, label = linked([texts[i] for i in kept], 5, 80)
    kept = [i for n, i in enumerate(kept) if label[n] == n]
    bad = {r["doc_id"] for r in QUERIES["op6_decontamination"](spark, data).collect()}
    library = Tokenizer.from_file(vocabulary_path())
    want = {i: library.encode(texts[i], add_special_tokens=False).ids for i in kept if i not in bad}
    rows = corpus_pipeline.run(spark, data).collect()
    assert {r["doc_id"]: r["token_ids"] for r in rows} == want and len(rows) == len(want)
    assert all(r["n_tokens"] == len(r["token_ids"]) for r in rows)
    one = rows[0]
    decoded = library.decode(one["token_ids"], skip_special_tokens=False)
    assert one["decoded_sha256"] == hashlib.sha256(decoded.encode()).hexdigest()
