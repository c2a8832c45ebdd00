import random

import numpy as np
import pytest

from topicweave.llm import clusters as C

HEADS = ["cascade", "waveguide", "annealer", "lattice"]


def corpus():
    rnd = random.Random(4)
    name = lambda: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(4))
    rows, truth, n = [], {}, 0
    subjects = [[(name(), rnd.choice(HEADS)) for _ in range(8)] for _ in range(12)]
    subjects[1][:3] = subjects[0][:3]  # neighbours share a few names
    for s, things in enumerate(subjects):
        for _ in range(rnd.randrange(5, 14)):
            own = rnd.sample(things, 6) + [(name(), rnd.choice(HEADS))]
            rows.append((f"u{n:03}", f"On the {own[0][0]} {own[0][1]}", ". ".join(f"We couple the {a} {h} with care" for a, h in own)))
            truth[f"u{n:03}"] = s
            n += 1
    for _ in range(60):
        own = [(name(), rnd.choice(HEADS)) for _ in range(6)] + [rnd.choice(subjects[3])]
        rows.append((f"u{n:03}", "Alone", ". ".join(f"We couple the {a} {h} with care" for a, h in own)))
        truth[f"u{n:03}"] = f"alone{n}"
        n += 1
    rows += [rows[0], ("u900", None, None), ("u901", "x", ""), ("u902", None, "word " * 50000)]
    return rows, truth


SCHEMA = "uid string, title string, abstract string"


def test_planted_subjects(spark):
    rows, truth = corpus()
    df = spark.createDataFrame(rows, SCHEMA)
    assigned = C.RecordClusters(df, "uid", ["title", "abstract"], "abstract").assign().cache()
    got = {tuple(r) for r in C.cluster_pairs(assigned, "uid").collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95
    report = C.cluster_report(assigned, "uid").collect()
    assert len(report) >= 11 and all(2 <= r["size"] and r.typical for r in report)


def test_distributed_flow_equals_blocks(spark):
    rng = np.random.default_rng(1)
    edges = [(i + 100 * g, j + 100 * g, float(rng.uniform(0.5, 1))) for g in range(3) for i in range(8) for j in range(i + 1, 8)] + [(0, 100, 0.31)]
    df = spark.createDataFrame(edges, "a long, b long, similarity double")
    a = {r.node: r.cluster for r in C.markov_clusters(df).collect()}
    b = {r.node: r.cluster for r in C.markov_clusters(df, block=4).collect()}
    groups = lambda d: {frozenset(k for k, v in d.items() if v == c) for c in d.values()}
    assert groups(a) == groups(b) == {frozenset(range(100 * g, 100 * g + 8)) for g in range(3)}


def test_split_steps_give_the_same_flow(spark, monkeypatch):
    edges = [(0, j, 1.0) for j in range(1, 30)] + [(40, j, 0.9) for j in range(41, 60)] + [(5, 45, 0.4)]
    df = spark.createDataFrame(edges, "a long, b long, similarity double")
    whole = sorted((r.node, r.cluster, round(r.flow, 5)) for r in C.sparse_flow(df).collect())
    monkeypatch.setattr(C, "HOT_STEP", 3)
    assert whole == sorted((r.node, r.cluster, round(r.flow, 5)) for r in C.sparse_flow(df).collect()) and {c for _, c, _ in whole} == {0, 40}


def test_an_unfinished_flow_is_an_error(spark):
    df = spark.createDataFrame([(i, i + 1, 1.0) for i in range(9)], "a long, b long, similarity double")
    with pytest.raises(RuntimeError, match="still moves"):
        C.sparse_flow(df, rounds=1)


def test_heads_do_not_depend_on_the_number_of_records(spark):
    rnd = random.Random(2)
    word = lambda k: "".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(k))
    closed = [word(3) for _ in range(53)]

    def texts(n):
        names = [word(5) for _ in range(n // 4)]
        hot = word(5)
        for _ in range(n):
            x = hot if rnd.random() < 1 / 3 else rnd.choice(names)  # one subject in a third of all records
            yield (f"the {x} cavity {rnd.choice(closed)} serves a {'closed' if rnd.random() < 0.5 else rnd.choice(names)} loop near {rnd.choice(closed)} end",)

    found = []
    for n in (1500, 15000, 60000):
        df = spark.createDataFrame(list(texts(n)), "t string").repartition(4).cache()
        found.append({r.head for r in C.productive_heads(df).collect()})
        assert found[-1] == {r.head for r in C.productive_heads(df.unionByName(df).unionByName(df)).collect()}
    assert found == [{"cavity", "loop"}] * 3


@pytest.mark.parametrize("rows", [[], [("u1", None, None)], [("u1", "a", "one text alone"), ("u2", "b", "another text")]])
def test_nothing_to_find(spark, rows):
    assert C.cluster_pairs(C.RecordClusters(spark.createDataFrame(rows, SCHEMA), "uid", ["title", "abstract"], "abstract").assign(), "uid").count() == 0


def linked(spark, sets):
    """Pairs of uid whose nodes are linked, of {uid: numbers of names}."""
    names = C.RecordClusters(spark.createDataFrame([], SCHEMA), "uid", ["title", "abstract"], "abstract")
    members = spark.createDataFrame([(u, sorted(s)) for u, s in sets.items()], "uid string, names array<long>").selectExpr("uid", "names", "xxhash64(names) AS node").cache()
    of = {}
    for r in members.collect():
        of.setdefault(r.node, []).append(r.uid)
    return {tuple(sorted((x, y))) for r in names.edges(members).collect() for x in of[r.a] for y in of[r.b]}


def test_copies_do_not_unlink_other_records(spark, monkeypatch):
    monkeypatch.setattr(C, "COMMON", 1.0)
    sets = {f"c{n:04}": range(6) for n in range(2000)}
    sets |= {f"r{n}": [*{*range(6)} - {n}, 100 + n] for n in range(5)}  # five of the six names and an own one
    got = linked(spark, sets)
    assert all(("c0000", f"r{n}") in got for n in range(5)) and all((f"r{m}", f"r{n}") in got for n in range(5) for m in range(n))


def test_hot_names_link_all_pairs(spark, monkeypatch):
    rows, truth = corpus()
    monkeypatch.setattr(C, "HOT", 4)
    monkeypatch.setattr(C, "HOT_HEADS", 3)
    got = {tuple(r) for r in C.cluster_pairs(C.RecordClusters(spark.createDataFrame(rows, SCHEMA), "uid", ["title", "abstract"], "abstract").assign(), "uid").collect()}
    want = {(a, b) for a in truth for b in truth if a < b and truth[a] == truth[b]}
    assert len(got & want) / len(want) > 0.95 and len(got & want) / len(got) > 0.95


def test_hot_names_have_every_link(spark, monkeypatch):
    monkeypatch.setattr(C, "COMMON", 1.0)
    sets = {f"r{n:04}": [*range(6), 100 + n] for n in range(C.HOT + 200)}
    assert len(linked(spark, sets)) == len(sets) * (len(sets) - 1) // 2


def test_similarity_does_not_depend_on_the_size_of_the_subject(spark):
    phrase = 99
    sets = {f"s{n}-{k}": [*range(6), 100 + n] for n in range(10) for k in range(500)}  # a third of all records: ten texts that share six of seven names
    sets |= {f"o{n:05}": [phrase, *range(1000 + 7 * n, 1007 + 7 * n)] for n in range(5000)}
    sets |= {f"p{n:05}": range(50000 + 3 * (n // 2), 50003 + 3 * (n // 2)) for n in range(5000)}
    sets["q1"], sets["q2"] = [phrase, 7, 8, *range(200, 205)], [phrase, 7, 8, *range(210, 215)]  # two names and a phrase that names nothing
    got = linked(spark, sets)
    assert all((f"s{m}-0", f"s{n}-0") in got for n in range(10) for m in range(n)) and ("q1", "q2") not in got
