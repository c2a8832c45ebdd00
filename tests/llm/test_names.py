import pytest
from pyspark.sql import functions as F

from topicweave.llm import names as N


@pytest.mark.parametrize(
    ("name", "want"),
    [
        ("Kozilar, Luomar H.", ("kozilar", "luomar", "lh")), ("KOZILAR, LUOMAR H.", ("kozilar", "luomar", "lh")), ("L. Kozilar", ("kozilar", "", "l")), ("Kozilar LH", ("kozilar", "", "lh")),
        ("Luomar Kozilar", ("kozilar", "luomar", "l")), ("Kozilar, L.H.", ("kozilar", "", "lh")), ("Kozilar, L", ("kozilar", "", "l")), ("von der Porekøs, Zelestin V.", ("porekos", "zelestin", "zv")),
        ("Kipenund, Jorimar van", ("kipenund", "jorimar", "j")), ("T. de Breboton", ("breboton", "", "t")),
    ],
)
def test_parse(name, want):
    assert N.parse_person(name) == want


@pytest.mark.parametrize(("a", "b", "want"), [("abc", "abc", True), ("abc", "abxc", True), ("abc", "ac", True), ("abc", "acb", True), ("abc", "axc", True), ("abcd", "badc", False), ("abc", "abcde", False)])
def test_one_edit(a, b, want):
    assert N.one_edit(a, b) is want and N.one_edit(b, a) is want
    if want:
        assert set(N.near_forms(a + "0000")) & set(N.near_forms(b + "0000"))


def test_organisation_forms():
    same = ["University of Spulduzis", "Univ. of Spulduzis", "SPULDUZIS UNIV", "Spülduzis University", "Spuelduzis Univ"]
    assert len({N.organisation_form(x) for x in same}) == 1
    assert N.organisation_form("TU Nealninas") == N.organisation_form("Nealninas Univ. of Technol") != N.organisation_form("University of Nealninas")
    assert N.organisation_form("Helm & Kay Foundry") == N.organisation_form("Helm/Kay Foundry") and N.organisation_form("Natl Lab Kay (NLKA)") == N.organisation_form("National Laboratory Kay")


def test_organisations(spark):
    rows = [("University of Kay",)] * 20 + [("Univ Kay",)] * 5 + [("Universitty of Kay",)] * 3 + [("University ofKay",)] * 2 + [("University of May",)] * 9 + [("May University",)] * 4 + [("Univ. May",)] + [(None,), ("",), (" ",)]
    got = {r.name: r.entity for r in N.organisations(spark.createDataFrame(rows, "affiliation string"), "affiliation").collect()}
    assert len({got[x] for x in ("University of Kay", "Univ Kay", "Universitty of Kay", "University ofKay")}) == 1 and len({got[x] for x in ("University of May", "May University", "Univ. May")}) == 1
    assert got["University of Kay"] != got["University of May"] and len(got) == 7


def people(spark):
    rows = [("Kozilar, Luomar H.", "o1", "A")] * 9 + [("Kozilar, Luomar", None, "A"), ("KOZILAR, LUOMAR H.", None, "A"), ("L. Kozilar", None, "A"), ("Kozilar LH", None, None), ("Kozilar, Lomar", "o1", "A"), ("Koziar, Luomar H.", None, "A"), ("Luomar Kozilar", None, "A")]
    rows += [("Kozilar, Lanander B.", "o2", "B")] * 6 + [("Kozilar, Ndery", None, "B"), ("Kozilar, L.", "o2", "B"), ("Kozilar LB", None, None)] + [("Other, Luomar", None, "C")] * 30 + [(None, None, None), ("", None, None)]
    nick = spark.createDataFrame([("Lanander", "Ndery"), ("Alander", "Ndery")], "given_name string, short_form string")
    df = spark.createDataFrame(rows, "author string, orcid string, org string")
    return N.persons(df, "author", [(F.col("orcid"), "orcid"), (F.col("org"), "organisation")], nick, "given_name", "short_form"), df


def test_persons(spark):
    got, _ = people(spark)
    by = {}
    for r in got.collect():
        by.setdefault(r.name, set()).add(r.entity)
    one = by["Kozilar, Luomar H."]
    for x in ("Kozilar, Luomar", "KOZILAR, LUOMAR H.", "L. Kozilar", "Kozilar LH", "Kozilar, Lomar", "Koziar, Luomar H.", "Luomar Kozilar"):
        assert by[x] == one, x
    two = by["Kozilar, Lanander B."]
    assert two != one and by["Kozilar, Ndery"] == by["Kozilar, L."] == by["Kozilar LB"] == two


def test_pairs(spark):
    got, df = people(spark)
    pairs = [tuple(r) for r in N.same_entity_pairs(got).collect()]
    assert len(pairs) == len(set(pairs)) and all(a < b for a, b in pairs) and len(pairs) == 8 * 7 // 2 + 4 * 3 // 2
    assert N.organisations(df.limit(0), "org").count() == 0


def test_score_is_the_rarity_of_the_rewriting_or_the_part_of_the_facts(spark):
    rows = [("Kay, Anna", "o1", "A")] * 5 + [("Kay, Alma", "o2", "B")] * 3 + [("Kay, A.", None, None), ("A. Kay", "o2", None)] + [("Kay, Bert", None, "C"), ("Kay, B.", None, None)]
    df = spark.createDataFrame(rows, "author string, orcid string, org string")
    nick = spark.createDataFrame([], "given_name string, short_form string")
    got = {(r.name, r.entity): r.score for r in N.persons(df, "author", [(F.col("orcid"), "orcid"), (F.col("org"), "organisation")], nick, "given_name", "short_form").collect()}
    assert got["Kay, A.", "kay|anna|"] == 0.5 and got["A. Kay", "kay|alma|"] == 1.0 and got["Kay, B.", "kay|bert|"] == 1.0 and len(got) == 6


def test_a_surname_of_very_many_persons(spark):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(f"Kay, A{x}{y}{z}", f"o{x}{y}{z}", None) for x in letters for y in letters[:12] for z in letters[:10]] + [("A. Kay", "oabc", None), ("Kay A", None, None)]
    df = spark.createDataFrame(rows, "author string, orcid string, org string")
    nick = spark.createDataFrame([], "given_name string, short_form string")
    listed = df.select(F.split("author", ", ")[1].alias("given_name"), F.lit(None).cast("string").alias("short_form"))
    got = N.persons(df, "author", [(F.col("orcid"), "orcid")], nick.unionByName(listed.limit(0)), "given_name", "short_form")
    by = {}
    for r in got.collect():
        by.setdefault(r.name, []).append((r.entity, r.score))
    assert len(by["A. Kay"]) == 1 and len(by["Kay A"]) == 1 and by["Kay A"][0][1] < 0.01
