import pytest
from hypothesis import given
from hypothesis import strategies as st

from topicweave.operators import split_values as sv

CAT = sv.with_known(sv.CATEGORIES, ["Optics", "Mathematics", "Mathematics, Cross-Field Uses", "Physics, Atoms, Ions & Clusters"])
KEY = sv.with_known(sv.KEYWORDS, ["states, cat", "noise; low-frequency"])


@pytest.mark.parametrize(
    ("text", "spec", "want"),
    [
        ("Mathematics, Cross-Field Uses; Optics", CAT, ["Mathematics, Cross-Field Uses", "Optics"]),
        ("Mathematics,Optics", CAT, ["Mathematics", "Optics"]),
        ('Optics,"Physics, Atoms, Ions & Clusters",', CAT, ["Optics", "Physics, Atoms, Ions & Clusters"]),
        ("Unknown, Field | Optics", CAT, ["Unknown, Field", "Optics"]),
        ("a ring, noise; low-frequency · states, cat\tb", KEY, ["a ring", "noise; low-frequency", "states, cat", "b"]),
        ('x;  ; "so-called ""magic"" gate"; y', KEY, ["x", 'so-called "magic" gate', "y"]),
        ("Helm/Kay Foundry / Univ. of B /", sv.ORGANISATIONS, ["Helm/Kay Foundry", "Univ. of B"]),
        ('"A; Branch North"|B', sv.ORGANISATIONS, ["A; Branch North", "B"]),
        ("Doe, J. & Roe, Ann and de Poe, X. &", sv.NAMES, ["Doe, J.", "Roe, Ann", "de Poe, X."]),
        ('"Doe, J.", "Roe, Ann", , "P. Poe"', sv.NAMES, ["Doe, J.", "Roe, Ann", "P. Poe"]),
        ("J. Doe, Ann Roe", sv.NAMES, ["J. Doe", "Ann Roe"]),
        ("Doe, Ann Mary", sv.NAMES, ["Doe, Ann Mary"]),
        ('"never closed; b', sv.KEYWORDS, ['"never closed', "b"]),
        ("", sv.NAMES, []),
        (None, sv.NAMES, []),
        (" ; | ", sv.KEYWORDS, []),
    ],
)
def test_split(text, spec, want):
    assert sv.split_packed(text, spec) == want


@given(st.lists(st.text(st.characters(codec="utf-8"), min_size=1).filter(lambda s: s.strip()), max_size=6), st.sampled_from([";", "|", "; "]))
def test_quoted_values_round_trip(values, sep):
    packed = sep.join('"' + v.replace('"', '""') + '"' for v in values)
    assert sv.split_packed(packed, sv.KEYWORDS) == [v.strip() for v in values]


def test_explode(spark):
    long = "; ".join(f"value {i}" for i in range(5000))
    df = spark.createDataFrame([(1, "a;b", "z"), (1, "a;b", "z"), (2, None, None), (3, "", "q"), (4, long, "z")], "id int, keywords_plus string, pos string")
    got = sv.explode_packed(df, "id", [sv.KEYWORDS]).toPandas()
    assert len(got) == 4 + 5000 and set(got.columns) == {"id", "field_name", "pos", "val"} and got[got.id == 4].pos.max() == 5000
    assert sv.explode_packed(df.limit(0), "id", [sv.KEYWORDS]).count() == 0


def test_too_large_dictionary_is_refused(monkeypatch):
    monkeypatch.setattr(sv, "MAX_KNOWN", 2)
    with pytest.raises(ValueError):
        sv.with_known(sv.KEYWORDS, ["a", "b", "c"])
