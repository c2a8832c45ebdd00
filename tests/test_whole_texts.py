import math

import pytest

from topicweave.plans import queries as core

#: phase, topic, title, abstract
DOCS = [
    (1, 1, "On qubit", "cold atoms in optical lattice traps drift beside cold atoms of another kind"),
    (1, 1, "On qubit", "an optical lattice holds cold atoms while other parts of it drift away slowly"),
    (1, 1, "On qubit", "cold atoms leave the optical lattice when every trap of the row opens again"),
    (1, 2, "On qubit", "molten salt flows through a narrow pipe and heats the outer wall of it"),
    (1, 2, "On qubit", "molten salt cools while a narrow pipe carries the rest of it far away"),
    (1, 2, "On qubit", None),
]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("texts")
    rows = [(f"u{i}", i, f"2020-01-0{i + 1}", p, f"{t} Topic", 2010, title, a) for i, (p, t, title, a) in enumerate(DOCS)]
    spark.createDataFrame(rows, "uid string, row_id long, loaded_at string, phase int, ct_macro string, pub_year int, title string, abstract string").write.parquet(f"{d}/publications.parquet")
    return str(d)


def test_tfidf_has_abstract_words_and_pairs(spark, folder):
    got = {(r.topic, r.term) for r in core.queries()["valid_text_tfidf_terms"](spark, folder).collect()}
    assert {(1, "cold"), (1, "cold atoms"), (1, "optical lattice")} <= got and not any("the" in t.split() for _, t in got)


def test_class_tfidf_counts_abstracts(spark, folder):
    got = {(r.topic, r.term): r.score for r in core.queries()["valid_text_class_tfidf"](spark, folder).collect()}
    docs = [(t, (title + " " + a).lower().split()) for _, t, title, a in DOCS if a]
    kept = {w for _, ws in docs for w in ws if len(w) > 1 and sum(w in x for _, x in docs) >= 2}
    n = {t: [w for s, ws in docs if s == t for w in ws if w in kept] for t in (1, 2)}
    every = n[1] + n[2]
    want = n[1].count("cold") / len(n[1]) * math.log(1 + len(every) / 2 / every.count("cold"))
    assert got[1, "cold"] == pytest.approx(want, abs=1e-6)


def test_coherence_and_diversity_of_whole_texts(spark, folder):
    c = {r.topic: r for r in core.queries()["valid_text_coherence"](spark, folder).collect()}
    d = core.queries()["valid_text_diversity"](spark, folder).filter("tops = 'top_10'").first()
    assert set(c) == {1, 2} and all(-1 <= r.npmi <= 1 for r in c.values()) and d.kinds > 10 and d.total == 20


def test_phrases_of_abstracts(spark, folder):
    got = {r.phrase: r.n for r in core.queries()["scalar_phrases"](spark, folder).collect()}
    assert any("cold atoms" in p for p in got)
