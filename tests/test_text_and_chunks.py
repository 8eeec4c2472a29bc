import uuid

import pytest
from pyspark.sql import functions as F

from loreloom.functions import text as tx
from loreloom.functions.html import article_text
from loreloom.operators import chunking, sections

RAW = (
    "doc_id string, game_id string, source_id string, source_url string, title string, "
    "text_en string, content_type string"
)


def one(spark, value, column, type_="string"):
    return spark.createDataFrame([(value,)], f"x {type_}").select(column(F.col("x"))).first()[0]


def test_names_ids_and_slugs(spark):
    assert one(spark, "Астаріон", tx.entity_name) == "astarion"
    assert one(spark, "Щука_Їжак  Ю", tx.entity_name) == "shchuka yizhak yu"
    assert one(spark, "чунк ß 1", tx.point_id) == str(uuid.uuid5(uuid.NAMESPACE_URL, "чунк ß 1"))
    assert one(spark, " >> ", tx.slug) == "section"
    assert one(spark, "Overview > Starting class", tx.slug) == "overview_starting_class"
    assert one(spark, "a b~*é:", tx.url_quote) == "a%20b~%2A%C3%A9%3A"
    assert one(spark, "x &amp;lt; y\n z", tx.forum_text) == "x < y z"
    assert one(spark, "Straße_1 öl-2", tx.tokens) == ["strasse_1", "öl", "2"]


def test_follow_up_markers(spark):
    asked = ["What about it", "a garden far", "Is he tall?", "Fireball damage", "", "а що далі"]
    rows = spark.createDataFrame([(q,) for q in asked], "q string")
    got = [r[0] for r in rows.select(tx.is_follow_up(F.col("q"))).collect()]
    assert got == [True, False, True, False, False, True]
    assert one(spark, "the land here", tx.is_follow_up) is True  # "and " inside a word


def test_content_types(spark):
    got = one(spark, "Secret Garden Key", lambda c: tx.content_type_of(c, F.lit("Rooms")))
    assert got == "rooms"
    assert one(spark, "Fast chess", lambda c: tx.content_type_of(c, F.lit(None))) == "puzzles"
    assert one(spark, "Nothing", lambda c: tx.content_type_of(c, F.lit(None))) == "mechanics"


def test_fixed_windows(spark):
    got = one(spark, "0123456789XYZ", lambda c: chunking.fixed_windows(c, 5, 2))
    assert got == ["01234", "34567", "6789X", "9XYZ"]
    assert one(spark, "  ", lambda c: chunking.fixed_windows(c, 4, 1)) == []
    assert one(spark, "abc", lambda c: chunking.fixed_windows(c, 4, 1)) == ["abc"]


def test_paragraphs_share_the_overlap(spark):
    text = "\n\n".join(["a" * 30, "b" * 30, "c" * 30])
    got = one(spark, text, lambda c: chunking.pack_paragraphs(c, 80, 1))
    assert got == ["a" * 30 + "\n\n" + "b" * 30, "b" * 30 + "\n\n" + "c" * 30]


def test_long_paragraph_breaks_at_sentences(spark):
    text = "One is forty characters long, I believe. Two is also that long, or so I hope. Three."
    got = one(spark, text, lambda c: chunking.pack_paragraphs(c, 50, 0))
    assert got == [
        "One is forty characters long, I believe.",
        "Two is also that long, or so I hope. Three.",
    ]


def test_overlap_tail_comes_out_again_after_a_long_paragraph(spark):
    text = "short one\n\n" + "x" * 30
    got = one(spark, text, lambda c: chunking.pack_paragraphs(c, 20, 1))
    assert got[0] == "short one" and got[-1] == "short one"
    assert got[1:3] == ["x" * 20, "x" * 14]


@pytest.mark.parametrize("size, overlap", [(0, 0), (10, -1), (10, 10)])
def test_window_parameters(size, overlap):
    with pytest.raises(ValueError):
        chunking.fixed_windows(F.lit("x"), size, overlap)


def test_packing_parameters():
    with pytest.raises(ValueError):
        chunking.pack_paragraphs(F.lit("x"), 0, 1)
    with pytest.raises(ValueError):
        chunking.pack_paragraphs(F.lit("x"), 10, -1)


PAGE = """
Overview
Background
Grew up among lighthouse keepers on the northern shore.
Starting class
Begins as a ranger of the third rank. UID S_Keeper UUID 00000000-1111-4222-8333-444444444444 Stats AB_2 Kind.
Technical
UID
S_Keeper
Gallery
Portrait in oil
Personality
Patient [ 3 ] with strangers. Technical details flags flags How to learn more.
Retrieved from elsewhere
"""


def test_sections_of_a_character_page(spark):
    raw = spark.createDataFrame(
        [("d", "g", "s_wiki", "u", "T", "Lead text\n" + PAGE, "character")], RAW
    )
    docs = sections.split_sections(raw, sections.WIKI_A)
    rows = sections.explode_sections(docs).orderBy("ord").collect()
    assert [r["section"] for r in rows] == [
        "Overview > Background", "Overview > Starting class", "Personality",
    ]
    assert rows[1]["text"] == "Begins as a ranger of the third rank. Kind."
    assert rows[2]["text"] == "Patient with strangers. How to learn more."
    chunks = chunking.chunk_documents(docs, 30, 5).collect()
    assert chunks[0]["chunk_id"] == "d:overview_background:0001"
    assert [c["chunk_id"][-4:] for c in chunks] == [f"{i:04d}" for i in range(1, len(chunks) + 1)]


def test_sections_with_tables_and_spoilers(spark):
    text = (
        "Rooms matter.\nList of rooms\n46 | Room 46 | None\nReferences\nRetrieved from x\n"
    )
    raw = spark.createDataFrame([("d", "g", "s", "u", "T", text, "rooms")], RAW)
    rows = sections.explode_sections(sections.split_sections(raw, sections.WIKI_B)).collect()
    assert [(r["section"], r["spoiler_level"]) for r in rows] == [
        ("Lead", "standard"), ("List of rooms", "spoiler_heavy"),
    ]


HTML = """<html><body><nav>Menu</nav><div id="mw-content-text">
<p><b>Parlor</b> is a room.<br>Second line</p>
<table><tr><th>Room</th><th>Type</th></tr><tr><td>Parlor</td><td>Puzzle</td></tr></table>
<script>var a = 1;</script><span class="mw-editsection">edit <i>x</i></span><sup>[1]</sup>
<h2>After</h2></div><p>Footer</p></body></html>"""


def test_article_text_with_and_without_tables():
    plain = article_text(HTML, root_id="mw-content-text")
    assert plain == "Parlor is a room.\nSecond line\nAfter"
    kept = article_text(HTML, root_id="mw-content-text", keep_tables=True)
    assert "Room | Type\nParlor | Puzzle" in kept
    assert "Menu" not in kept and "Footer" not in kept and "edit" not in kept
    assert article_text("<p>no root</p>", root_id="mw-content-text") == ""
