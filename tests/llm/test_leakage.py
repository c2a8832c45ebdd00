import random

from hypothesis import given, settings
from hypothesis import strategies as st

from topicweave.llm import leakage as L


def test_markup_and_case():
    assert L.words_of("<p>The <b>bo</b>ld&nbsp;WORD, \\emph{x_y}</p>") == ["the", "bold", "word", "x", "y"]


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(0, 60), st.integers(0, 60))
def test_every_long_shared_span_has_a_common_fingerprint(seed, before, after):
    rnd = random.Random(seed)
    known = L._Hashes()
    word = lambda: f"w{rnd.randrange(50)}"
    span = [word() for _ in range(L.SPAN)]
    import numpy as np

    a = np.array([known[w] for w in [word() for _ in range(before)] + span + [word() for _ in range(after)]], np.uint64)
    b = np.array([known[w] for w in [word() for _ in range(after)] + span + [word() for _ in range(before)]], np.uint64)
    assert set(L.fingerprints(a)[1].tolist()) & set(L.fingerprints(b)[1].tolist())


def holds(doc, passage):
    d, p = L.words_of(doc or ""), L.words_of(passage or "")
    spans = {tuple(p[i : i + L.SPAN]) for i in range(len(p) - L.SPAN + 1)}
    return any(tuple(d[i : i + L.SPAN]) in spans for i in range(len(d) - L.SPAN + 1))


def case():
    rnd = random.Random(1)
    items = [(i, " ".join(f"k{rnd.randrange(400)}" for _ in range(rnd.randrange(10, 40)))) for i in range(30)] + [(99, None), (98, ""), (97, "a b c")]
    items.append((50, items[3][1]))
    docs = []
    for i in range(150):
        noise = [f"z{rnd.randrange(300)}" for _ in range(rnd.randrange(5, 120))]
        w = (rnd.choice(items[:30])[1]).split()
        k = rnd.randrange(4, 20)
        part = w[(s := rnd.randrange(max(1, len(w) - k))) : s + k]
        at = rnd.randrange(len(noise))
        docs.append((i, " ".join([*noise[:at], *[x.upper() + rnd.choice(["", ",", "\n", "<br/>"]) for x in part], *noise[at:]])))
    return items, docs + [(900, None), (901, ""), (902, items[3][1]), (902, items[3][1])]


def check(spark, monkeypatch=None):
    items, docs = case()
    want = {(d, i) for d, t in docs for i, p in items if holds(t, p)}
    got = L.leaks(spark.createDataFrame(docs, "doc_id long, text string"), "doc_id", "text", spark.createDataFrame(items, "item_id long, passage string"), "item_id", "passage").collect()
    assert {tuple(r) for r in got} == want and len(got) == len(want) > 20


def test_against_brute_force(spark):
    check(spark)


def test_many_tests_are_joined_by_shuffle(spark, monkeypatch):
    monkeypatch.setattr(L, "MAX_SENT", 1)
    check(spark)


def test_empty(spark):
    e = spark.createDataFrame([], "doc_id long, text string")
    t = spark.createDataFrame([], "item_id long, passage string")
    assert L.leaks(e, "doc_id", "text", t, "item_id", "passage").count() == 0


def test_both_ways_give_the_same_rows(spark, data, monkeypatch):
    docs, items = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/eval_items.parquet")
    run = lambda: {tuple(r) for r in L.leaks(docs, "doc_id", "text", items, "item_id", "passage").collect()}
    sent = run()
    monkeypatch.setattr(L, "MAX_SENT", 0)
    assert sent == run() and sent
