import itertools

import pytest

from pyspark.sql import functions as F

from topicweave.llm import textform as X


@pytest.mark.parametrize(
    ("a", "b"),
    [
        ("ｗｉｄｅ text", "wide text"),
        ("ﬁne", "fine"),
        ("cafe\u0301", "café"),
        ("zero\u200bwidth\u00ad", "zerowidth"),
        ("no\u00a0break\u2009thin\u3000wide", "no break thin wide"),
        ("сосоа", "cocoa"),
        ("5 \u212a and \u212b", "5 K and Å"),
        ("3 \u00b5m", "3 \u03bcm"),
        ("a\u2011b\u2010c", "a-b-c"),
        ("one\r\ntwo", "one\ntwo"),
    ],
)
def test_same_look(a, b):
    assert X.visible_form(a) == X.visible_form(b)


@pytest.mark.parametrize(("a", "b"), [("A", "a"), ("é", "e"), ("H₂", "H2"), ("10³", "103"), ("a-b", "a b"), ("a.", "a"), ("a\nb", "a b")])
def test_different_look(a, b):
    assert X.visible_form(a) != X.visible_form(b)


def test_folded():
    assert X.folded_form("STRASSE") == X.folded_form("straße") and X.folded_form(None) is None and X.visible_form("") == ""


ROWS = [
    (1, "one ﬁle", "x"), (2, "one file", "x"), (3, "one file", "x"), (4, "One file", "x"), (5, None, None), (6, "", "\u200b"),
    (7, "\u200b", ""), (8, "long " * 20000 + "ｅ", "y"), (9, "long " * 20000 + "e", "y"),
]


def test_pairs_against_brute_force(spark):
    df = spark.createDataFrame(ROWS, "look long, title string, own string")
    want = {("title", a[0], b[0]) for a, b in itertools.combinations(ROWS, 2) if a[1] and b[1] and a[1] != b[1] and X.visible_form(a[1]) and X.visible_form(a[1]) == X.visible_form(b[1])}
    got = X.look_alike_pairs(df, "look", ["title", "own"]).collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) == 3
    assert X.look_alike_pairs(df.limit(0), "look", ["title"]).count() == 0


def test_canonical(spark):
    got = X.canonical_texts(spark.createDataFrame(ROWS, "id long, title string, own string"), "id", ["title"]).collect()
    assert {r.id: r.visible for r in got}[1] == "one file" and {r.id: r.folded for r in got}[4] == "one file" and {r.id: r.visible for r in got}[5] is None and len(got) == 9


def test_greek_symbols_stay_and_greek_letters_in_latin_words_do_not():
    assert X.visible_form("α decay of γ rays, ρ = 1") == "α decay of γ rays, ρ = 1"
    assert X.visible_form("qυαntυm ΑTOM sοlid") == "quantum ATOM solid" and X.visible_form("νιρ αγ") == "νιρ αγ"


def test_many_copies_beside_one_variant(spark):
    rows = spark.range(200_000).select(F.col("id").alias("row_id"), F.lit("the same text").alias("title")).unionByName(spark.createDataFrame([(10**7, "the\u00a0same text")], "row_id long, title string"))
    assert X.look_alike_pairs(rows, "row_id", ["title"]).count() == 200_000
