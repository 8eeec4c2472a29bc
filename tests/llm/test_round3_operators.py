"""Hard negatives, SimHash groups and the filter audit against brute-force versions."""

import math
import random
import re
from collections import Counter
from itertools import permutations

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from loreloom.llm import bpe, decontaminate, filteraudit, hardnegatives, mainblocks, simhash
from loreloom.llm.common import keyed
from loreloom.llm.components import components
from loreloom.llm.queries import QUERIES, vocabulary_path


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# ---- hard negatives ----


def brute_negatives(rows, percent=80, scale=256):
    sound = []
    for at, (vec_id, label, x) in enumerate(rows):
        if vec_id is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        sound.append((vec_id, label, [math.floor(scale * v) for v in x], at))
    dot = lambda a, b: sum(p * q for p, q in zip(a, b, strict=True))
    out = []
    for anchor in sound:
        if anchor[0] % 100:
            continue
        scored = sorted((-dot(anchor[2], r[2]), r[0], r[3], r[1]) for r in sound
                        if r[3] != anchor[3] and len(r[2]) == len(anchor[2]))
        for p, positive, *_ in [s for s in scored if s[3] == anchor[1]][:5]:
            fit = [s for s in scored if s[3] != anchor[1] and percent * -p <= 100 * -s[0] <= 100 * -p]
            out += [(anchor[0], positive, n, s[1], -p, -s[0]) for n, s in enumerate(fit[:5], 1)]
    return sorted(out)


def mined(spark, rows, **extra):
    made = spark.createDataFrame([(*r, 0.5) for r in rows],
                                 "vec_id bigint, label int, embedding array<double>, score double")
    names = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    frame = hardnegatives.mine_hard_negatives(made, F.col("vec_id") % 100 == 0, **extra)
    assert frame.columns == names
    return sorted(tuple(r) for r in frame.collect())


@pytest.mark.parametrize("coarse", [False, True])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, coarse):
    """Many cells, and with coarse components many equal scores."""
    monkeypatch.setattr(hardnegatives, "ROWS_PER_CELL", 60)
    monkeypatch.setattr(hardnegatives, "ANCHORS_PER_CELL", 2)
    chance = np.random.default_rng(7)
    rows = []
    for vec_id in range(0, 4000, 10):
        x = chance.normal(0, 0.3, 20) + (0.2 if vec_id % 3 else 0)
        rows.append((vec_id, int(chance.integers(0, 3)), (np.round(x) if coarse else x).tolist()))
    got = mined(spark, rows)
    assert len(got) > 100
    assert got == brute_negatives(rows)


def test_hard_negatives_of_odd_rows(spark):
    rows = [
        (100, 1, [0.5, 0.5]), (100, 1, [0.5, 0.5]), (1, 1, [0.5, 0.25]), (2, 2, [0.5, 0.4]),
        (2, 2, [0.5, 0.4]), (3, 2, None), (4, None, [0.5, 0.5]), (None, 2, [0.5, 0.5]),
        (5, 2, [0.5, None]), (6, 2, [float("nan"), 0.5]), (7, 2, [float("inf"), 0.5]), (8, 2, [0.5]),
        (200, 2, []), (300, 5, [-0.5, 0.5]), (9, 5, [0.0, 0.0]), (10, 6, [0.0, 0.0]),
    ]
    assert mined(spark, rows) == brute_negatives(rows)
    assert mined(spark, []) == []
    assert mined(spark, rows[2:4]) == []


def test_hard_negatives_beyond_exact_doubles(spark):
    chance = np.random.default_rng(3)
    rows = [(i, i % 3, (chance.normal(0, 1, 4) * 2.0**16).tolist()) for i in range(0, 3000, 25)]
    assert mined(spark, rows) == brute_negatives(rows)


# ---- SimHash groups ----


def brute_fingerprint(text, width=3):
    words = words_of(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    span = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[i : i + span]).encode(), seed=42)
              for i in range(len(words) - span + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_labels(prints):
    label = list(range(len(prints)))
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2 and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = [low if x == high else x for x in label]
    return label


def grouped(spark, rows, **extra):
    docs = keyed(spark.createDataFrame(rows, "doc_id bigint, text string"))
    return simhash.simhash_groups(docs, **extra).collect()


def test_simhash_groups_equal_brute_force(spark):
    chance = random.Random(5)
    texts = [None, "", " \n\t", "one", "One", "two words", "é É Σ ß", "x " * 30_000, "a b c"]
    for _ in range(12):
        base = [chance.choice("abcdefghij") + chance.choice("klm") for _ in range(chance.randint(30, 250))]
        for _ in range(12):
            copy = list(base)
            for _ in range(chance.randint(0, 2)):
                copy[chance.randrange(len(copy))] = "zz"
            texts.append(" ".join(copy))
    prints = [brute_fingerprint(t) for t in texts]
    label = brute_labels(prints)
    assert len(set(label)) < len(set(prints))
    rows = grouped(spark, list(enumerate(texts)))
    assert len(rows) == len(texts)
    for r in rows:
        assert r["fp"] % (1 << 64) == prints[r["doc_id"]]
        assert r["component"] == label[r["doc_id"]]
        assert r["kept"] == (r["doc_id"] == label[r["doc_id"]])


@pytest.mark.parametrize("compared", [1, 4, 1000])
def test_fingerprint_links_connect_all_that_link(spark, compared):
    """Clusters of close fingerprints, so that keys are crowded; both ways give the same components."""
    chance = random.Random(9)
    prints = {chance.getrandbits(64) for _ in range(40)}
    for centre in list(prints)[:6]:
        for _ in range(60):
            p = centre
            for _ in range(chance.randint(1, 6)):
                p ^= 1 << chance.choice([0, 3, 31, 32, 33, 40, 63, *range(8, 20)])
            prints.add(p)
    signed = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    links = simhash.fingerprint_links(frame, compared)
    pairs = [(r["a"], r["b"]) for r in links.collect()]
    assert all(((a ^ b) % (1 << 64)).bit_count() in (1, 2) for a, b in pairs)
    want = brute_labels([p % (1 << 64) for p in signed])
    label = {r["node"]: r["label"] for r in components(links).collect()}
    assert [label.get(p, p) for p in signed] == [signed[x] for x in want]


def test_simhash_groups_of_odd_rows(spark):
    rows = [(None, "a b c"), (3, "A  b c"), (3, "a b c"), (None, "alone here"), (7, None), (6, "")]
    got = {(r["doc_id"], r["fp"] == 0, r["component"], r["kept"]) for r in grouped(spark, rows)}
    assert {(7, True, 6, False), (6, True, 6, True), (None, False, None, True), (None, False, 3, False)} <= got
    assert sum(r["kept"] for r in grouped(spark, rows)) == 3
    assert grouped(spark, []) == []
    docs = spark.createDataFrame([(1, "a b", "k"), (2, "a  b", "k")], "doc_id int, text string, row_key string")
    out = simhash.drop_simhash_duplicates(docs)
    assert out.columns == docs.columns and [r["doc_id"] for r in out.collect()] == [1]


def test_simhash_query(spark, data):
    texts = duckdb.sql(f"SELECT doc_id, text FROM '{data}/documents.parquet' ORDER BY doc_id").fetchall()
    prints = [brute_fingerprint(t) for _, t in texts]
    label = brute_labels(prints)
    want = sorted((d, f"{p:016x}", texts[x][0]) for (d, _), p, x in zip(texts, prints, label, strict=True))
    assert sorted(tuple(r) for r in QUERIES["op12_simhash_dedup"](spark, data).collect()) == want


# ---- filter audit ----


def brute_audit(docs, labels):
    fails, parts = [], {}
    for doc_id, text, source in docs:
        text = text or ""
        words = words_of(text)
        bad = set()
        if len(words) < 50:
            bad.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            bad.add("B")
        if 100 * len(re.findall("[A-Z]", text)) > 5 * len(text):
            bad.add("C")
        if re.search("[#$%&*|]", text):
            bad.add("D")
        if doc_id is not None and any(
            i is not None and i < doc_id and (t or "") == text for i, t, _ in docs
        ):
            bad.add("E")
        good = any(i == doc_id and q == 1 for i, q, _ in labels) if doc_id is not None else False
        toxic = any(i == doc_id and t == 1 for i, _, t in labels) if doc_id is not None else False
        parts.setdefault(source or "", []).append((bad, good, toxic))
    out = []
    for part, rows in parts.items():
        shapley, made = dict.fromkeys("ABCDE", 0), []
        for order in permutations("ABCDE"):
            for step, own in enumerate(order, 1):
                before = set(order[: step - 1])
                here = [r for r in rows if own in r[0] and not r[0] & before]
                shapley[own] += len(here)
                made.append([
                    part, "".join(order), step, sum(not r[0] & (before | {own}) for r in rows), len(here),
                    sum(own in r[0] and bool(r[0] & before) for r in rows),
                    sum(r[0] == {own} for r in rows), sum(r[1] for r in here), sum(r[2] for r in here),
                ])
        out += [(*row, shapley[row[1][row[2] - 1]]) for row in made]
    return sorted(out)


def audited(spark, docs, labels):
    frame = filteraudit.audit_filters(
        spark.createDataFrame([(*d, 1, "x") for d in docs],
                              "doc_id bigint, text string, source string, mask int, part string"),
        spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int"),
    )
    return sorted(tuple(r[c] for c in ["part", "filter_order", "step", *filteraudit.COUNTS, "shapley"])
                  for r in frame.collect())


def test_audit_equals_brute_force(spark):
    chance = random.Random(1)
    texts = ["", None, " \n ", "SHOUT it", "a & b", "plain " * 60, "ÉÀ é" * 3, "w " * 20_000 + "|"]
    texts += [" ".join(chance.choice(["the", "Cat", "SAT", "on", "mat#", f"w{chance.random()}"])
                       for _ in range(chance.randint(0, 90))) for _ in range(40)]
    docs = [(i if i % 9 else None, chance.choice(texts), chance.choice(["s", "t", "", None])) for i in range(150)]
    docs += docs[:10]
    labels = [(i, chance.choice([0, 1, None]), chance.choice([0, 1])) for i in range(0, 150, 2)]
    labels += [(4, 1, 1), (None, 1, 1), (999, 1, 1)]
    got = audited(spark, docs, labels)
    assert len(got) == 3 * 600
    assert got == brute_audit(docs, labels)
    assert audited(spark, [], labels) == []
    assert audited(spark, docs[:20], []) == brute_audit(docs[:20], [])


# ---- decontamination ----


def best_window(words, item, similarity=0.8):
    """Every window of the item's length, by weighted Jaccard of five-word shingles."""
    counts = lambda w: Counter(tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1)))
    want, best = counts(item), None
    for start in range(max(len(words) - len(item), 0) + 1):
        have = counts(words[start : start + len(item)])
        common = sum(min(n, want[k]) for k, n in have.items())
        rate = common / (sum(have.values()) + sum(want.values()) - common)
        if rate >= similarity and (best is None or rate > best[0]):
            best = (rate, start)
    return best


def test_every_similar_window_is_found(spark):
    """Swapped halves, repeats, edits near the bound and texts shorter than the item, inside long texts."""
    chance = random.Random(21)
    fill = lambda n: [f"v{chance.randrange(10**6)}" for _ in range(n)]
    items = [fill(100), fill(30), fill(9), fill(60)[:30] * 2, ["na"] * 400, fill(5) + ["so"] * 20, fill(4), fill(1)]
    texts = [
        fill(200) + items[0][50:] + items[0][:50] + fill(200), fill(20_000) + items[1] + fill(300),
        ["na"] * 3000, ["na"] * 350, items[3][5:] + fill(40), items[5][3:] + ["so"] * 9, items[6], items[7] + fill(2),
        fill(3) + items[2] * 2,
    ]
    for item in items[:4]:
        for _ in range(14):
            copy = list(item)
            for _ in range(chance.randint(0, 4)):
                at, kind = chance.randrange(len(copy)), chance.random()
                copy[at : at + 1] = [] if kind < 0.3 else ["x"] if kind < 0.6 else [copy[at], copy[at - 1]]
            texts.append(fill(chance.randint(0, 30)) + copy + fill(chance.randint(0, 30)))
    docs = keyed(spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(texts)], "doc_id int, text string"))
    benchmark = spark.createDataFrame([(i, " ".join(t)) for i, t in enumerate(items)], "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]): (round(r["similarity"], 9), r["start"])
           for r in decontaminate.contaminated(docs, benchmark).collect()}
    want = {}
    for d, text in enumerate(texts):
        for i, item in enumerate(items):
            short = text if len(text) < 1000 or i in (4,) else text[19_900:]
            found = best_window(short, item)
            if found:
                want[d, i] = (round(found[0], 9), found[1] + len(text) - len(short))
    assert {(0, 0), (1, 1), (2, 4)} <= set(want)
    assert got == want


def test_radius_of_an_item_covers_what_is_similar(spark):
    """Fingerprints of windows at the bound never leave the radius, and short items have blocks."""
    chance = random.Random(22)
    item = [f"w{i}" for i in range(30)]
    windows = []
    for _ in range(60):
        copy = list(item)
        copy[-1] = copy[0] = f"x{chance.randrange(10**6)}"
        windows.append(copy if chance.random() < 0.5 else copy[:-1] + [item[-1]])
    rows = [(i, 0, i, w) for i, w in enumerate(windows)]
    frame = spark.createDataFrame(rows, "win long, item long, start int, words array<string>")
    items = spark.createDataFrame([(0, item)], "item long, words array<string>")
    counted = lambda df, *k: decontaminate._counted(df, *k)
    near = decontaminate._within_radius(
        frame, counted(frame, "win", "item"), items, counted(items, "item"), 0.8
    )
    similar = {i for i, w in enumerate(windows) if best_window(w, item)}
    assert similar and similar <= {r["win"] for r in near.collect()}


# ---- pages ----


@pytest.mark.parametrize(("page", "want"), [
    ('<article><p title="what is hidden here">kept</p><p hidden>no</p><p hidden="">no</p></article>', "kept"),
    ('<article><div class="related-work"><p>one</p></div><div class="form-of-government">two</div>'
     '<p class="social-history">three</p><span class="ad-hoc">four</span></article>', "one\ntwo\nthree\nfour"),
    ('<article><h2 class="section-header">Head</h2><div class="tags-explained">text</div></article>', "Head\ntext"),
    ('<article><p>text</p><div class="post-comments"><p>no</p></div><div class="share-buttons">no</div></article>', "text"),
    ('<div class="layout-with-sidebar"><article><p>text</p></article></div>', "text"),
    ("<h1>Title here</h1><p>a nine word paragraph that says one whole thing</p>",
     "Title here\na nine word paragraph that says one whole thing"),
    ('<div><a href=1>Home</a> <a href=2>About us</a></div><h2>Small</h2><p>one two</p><div>Copyright 2024</div>', "Small\none two"),
])
def test_what_is_main_text(page, want):
    assert mainblocks.main_texts([page])[0] == want


def test_words_and_links_decide_where_regions_have_no_names():
    links = "".join(f"<a href={i}>see page {i}</a> " for i in range(9))
    page = f"<div>{links}</div><div>{'text ' * 30}</div><div>{links} and {'more ' * 20}</div><div>Site 2024</div>"
    found = mainblocks.blocks(page)
    rows = mainblocks.described(found)
    assert mainblocks.decide(mainblocks.block_tree(), rows).tolist() == [False, True, False, False]
    rows[:, :6] = 0
    assert mainblocks.decide(mainblocks.block_tree(), rows).tolist() != [False, True, False, False]


# ---- tokens ----


def test_letters_newer_than_the_library(spark):
    """Random runs of old and new letters, digits and capitals are cut as the library cuts them."""
    from tokenizers import Tokenizer

    chance = random.Random(31)
    library = Tokenizer.from_file(vocabulary_path())
    rare = "\U00010EE3\uA7DD\U00010D55\uA7CB\U00016EA5\U000323B0\U00011DE3\u1C89\uA7DA\u0558\U0001E6C1"
    texts = ["".join(chance.choice(rare + "abZ19 .,'é") for _ in range(chance.randint(1, 30))) for _ in range(400)]
    made = bpe.encode_texts(spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string"), vocabulary_path())
    for r in made.collect():
        want = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids
        assert list(r["ids"]) == want, texts[r["doc_id"]]


# ---- pipeline ----


def test_pipeline_of_odd_rows(spark, tmp_path):
    """Nulls, repeated rows, very long texts, clashing columns, and no rows at all."""
    import corpus_pipeline

    chance = random.Random(41)
    words = lambda n: " ".join(f"w{chance.randrange(10**6)}" for _ in range(n))
    item, long = words(40), words(30_000)
    shape = "doc_id long, text string, lang string, source string, n_chars long, token_ids string, score double"
    rows = [
        (1, None), (2, ""), (None, "  "), (3, words(30)), (4, long), (5, long + " tail"), (6, f"so {item} it is"),
        (None, words(12)), (7, "short"), (7, "short"), (8, "short "),
    ]
    docs = [(i, t, "en", "s", 0, "mine", 0.5) for i, t in rows]
    labels = [(100 + i, 1, 0) for i in range(60)]  # one class only
    train = [(100 + i, f"{'kind warm calm' if i % 4 else 'vile slur hate'} {words(8)}", "en", "s", 0, "x", 0.1) for i in range(60)]
    for name, made in (("documents", spark.createDataFrame(docs + train, shape)),
                       ("labels", spark.createDataFrame(labels, "doc_id long, quality int, toxic int")),
                       ("benchmark", spark.createDataFrame([(1, item), (2, None)], "item_id int, text string"))):
        made.write.parquet(str(tmp_path / "in" / f"{name}.parquet"))
    frame = corpus_pipeline.run(spark, str(tmp_path / "in"))
    assert frame.columns == ["doc_id", "text", "lang", "source", "n_chars", "token_ids", "score", "n_tokens", "decoded_sha256"]
    out = [r for r in frame.collect() if r["doc_id"] is None or r["doc_id"] < 100]
    assert sorted(str(r["doc_id"]) for r in out) == sorted(["1", "None", "3", "4", "None", "7"])
    assert {r["doc_id"]: r["n_tokens"] for r in out}[1] == 0
    docs = spark.createDataFrame([], shape)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, str(tmp_path / "in")).count() == 0, name
