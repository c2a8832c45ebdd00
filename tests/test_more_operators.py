"""Operators against brute force and second implementations on small fixtures."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from topicweave.operators import indicators as I
from topicweave.operators import matching as M
from topicweave.operators import resample as S
from topicweave.operators import validation as V


@pytest.mark.parametrize("hot", [1, 2, 4, 1000])
def test_reference_overlap_with_hot_references(spark, hot):
    rnd = random.Random(3)
    refs = {f"u{i}": set(rnd.sample("abcdefgh", rnd.randint(1, 4))) | ({"hot"} if i % 3 else set()) | ({"warm"} if i % 2 else set()) for i in range(40)}
    refs |= {f"c{i}": {"hot", "a"} for i in range(6)}  # copies
    topic = {u: i % 2 for i, u in enumerate(refs)}
    edges = spark.createDataFrame([(u, r) for u, s in refs.items() for r in s] + [("u0", None), ("zz", "hot"), ("u1", "hot"), ("u1", "hot")], "uid string, uid_ref string")
    refs["u1"].add("hot")
    docs = spark.createDataFrame([(u, 1, t) for u, t in topic.items()] + [("none", 1, 0)], "uid string, phase int, topic int")
    got = {r.topic: (r.n_refs, r.overlap) for r in V.reference_overlap(edges, docs, I.KEYS, hot).collect()}
    for t in (0, 1):
        own = [refs[u] for u in refs if topic[u] == t]
        want = np.mean([len(a & b) / len(a | b) for a, b in itertools.combinations(own, 2)])
        assert got[t] == (len(own), pytest.approx(want))
    assert V.reference_overlap(edges.limit(0), docs, I.KEYS, hot).count() == 0


def test_permuted_years_keep_the_years_of_a_topic(spark):
    rows = [(1, t, f"u{t}-{i}", 2000 + (i * i) % 7) for t in (1, 2) for i in range(90)]
    docs = spark.createDataFrame(rows, "phase int, topic int, uid string, year int")
    got = S.permuted_years(docs, 12, 5).toPandas()
    assert len(got) == 13 * len(rows) and not got.duplicated(["uid", "rep"]).any()
    want = {t: sorted(r[3] for r in rows if r[1] == t) for t in (1, 2)}
    for (t, rep), g in got.groupby(["topic", "rep"]):
        assert sorted(g.year) == want[t]
    first = {r[2]: r[3] for r in rows}
    same = got.assign(same=got.uid.map(first) == got.year).groupby("rep").same.mean()
    assert same[0] == 1 and same[1:].max() < 0.5


@pytest.mark.parametrize("k", [1, 7, 30, 500])
def test_nearest_to_centroids(spark, k):
    rng = np.random.default_rng(k)
    v = np.round(rng.normal(size=(120, 3)), 1)
    v[60:70] = v[0]  # ties
    topic = rng.integers(-1, 3, 120)
    rows = [(1, int(t), f"u{i:03}", [float(x) for x in e]) for i, (t, e) in enumerate(zip(topic, v, strict=True))]
    df = spark.createDataFrame(rows, "phase int, topic int, uid string, embedding array<float>")
    got = {r.topic: r.noise for r in I.nearest_to_centroids(df, lambda n, corpus: F.least(F.lit(k).cast("long"), corpus)).collect()}
    e = np.array([r[3] for r in rows], np.float32).astype(float)
    for t in (0, 1, 2):
        d = np.round(np.sqrt(((e - e[topic == t].mean(axis=0)) ** 2).sum(axis=1)), 9)
        near = sorted(range(120), key=lambda i: (d[i], f"u{i:03}"))[: min(k, 120)]
        assert got[t] == pytest.approx(np.mean(topic[near] == -1))


def test_match_evalues(spark):
    rnd = random.Random(1)
    s = [(a, b, round(rnd.random() * 4) / 4) for a in range(6) for b in range(5)]
    df = spark.createDataFrame(s, "topic1 int, topic2 int, hybrid double")
    got = {r.topic1: r for r in V.match_evalues(df).collect()}
    for a in range(6):
        h = max(x for t, _, x in s if t == a)
        p = np.mean([x > h for *_, x in s])
        assert (got[a].h, got[a].p, got[a].e) == (h, pytest.approx(p), pytest.approx(5 * p))
    r = np.clip([1 - got[a].p for a in got], 1e-12, 1 - 1e-12)
    assert V.effective_candidates(df).first().n_all == pytest.approx(-len(r) / np.log(r).sum())


def test_flags_and_boxes(spark):
    rows = [(a, b, a / 10 + b / 100, (9 - a) / 10) for a in range(10) for b in range(4)]
    got = {r.flag: r for r in V.flag_overlap(spark.createDataFrame(rows, "topic1 int, topic2 int, x double, y double"), ["x", "y"]).collect()}
    q = np.quantile([r[2] for r in rows], 0.99)
    assert got["below_q99"].a == sum(max(r[2] for r in rows if r[0] == a) < q for a in range(10)) and got["below_q99"].common == 8
    box = V.ratio_box(spark.createDataFrame([(1, i, float(i)) for i in range(5)], "phase int, topic int, o double")).first()
    assert (box.n, box.median, box.below) == (5, 1.0, 2) and box.low == pytest.approx(np.quantile(np.maximum(np.arange(5) / 2, 0.1), 0.05))
    assert V.ratio_box(spark.createDataFrame([(1, 1, 0.0)], "phase int, topic int, o double")).count() == 0


def test_first_common_key(spark):
    a = spark.createDataFrame([("u1", None, "t"), ("u2", "d2", "t")], "uid string, doi string, title string")
    b = spark.createDataFrame([("d2", 5, "other"), (None, 6, "x")], "doi string, n int, title string")
    got = {r.uid: r.n for r in V.join_first_key(a, b, ["nr", "doi", "title"]).collect()}
    assert got == {"u1": None, "u2": 5}
    with pytest.raises(ValueError):
        V.join_first_key(a, b, ["nr"])


def test_labels_matched(spark):
    rows = [(f"u{i}", i // 10, i // 10 if i % 10 else -1) for i in range(30)] + [("n", -1, 2)]
    df = spark.createDataFrame(rows, "uid string, old int, new int")
    assert {(r.new, r.old, r.unique_match) for r in M.close_matches(df, "old", "new").collect()} == {(0, 0, True), (1, 1, True), (2, 2, True)}
    rep = {r.new: (r.members, r.noise, r.kinds) for r in M.overlap_report(df, "old", "new").collect()}
    assert rep == {0: (9, 0, 1), 1: (9, 0, 1), 2: (10, 1, 1)}


def test_criteria_and_verdicts(spark):
    rng = np.random.default_rng(2)
    rows, size = [], rng.permutation(40)
    for p in (1, 2):
        for t in range(40):
            x = float(rng.normal())
            for m, value in (("good", x), ("size", float(size[t])), ("like_size", float(size[t] * 2))):
                rows.append((p, t, m, "ref", 0, value))
                for rep in range(3):
                    noise = rng.normal(size=2) * (0.05 if m != "good" or p == 1 else 0.8)
                    rows += [(p, t, m, "half_a", rep, value + float(noise[0])), (p, t, m, "half_b", rep, value + float(noise[1])), (p, t, m, "rare", rep, value), (p, t, m, "null", rep, float(rng.normal()))]
    df = spark.createDataFrame(rows, "phase int, topic int, measure string, sample string, rep int, value double")
    sizes = spark.createDataFrame([(p, t, math.log(2.0 + float(size[t]))) for p in (1, 2) for t in range(40)], "phase int, topic int, ln_n double")
    v = S.verdicts(S.criteria(df, sizes)).cache()
    got = {(r.phase, r.measure): r for r in v.collect()}
    assert got[1, "good"].k2 > 0.98 and got[1, "good"].k4_full == pytest.approx(1) and got[1, "size"].k4 == pytest.approx(1) and got[1, "size"].k6 == pytest.approx(1)
    assert got[1, "size"].s4 == "missed" == got[1, "like_size"].s6 and got[1, "good"].s2 == "good" and not got[1, "size"].passed
    assert {r.measure: r.outcome for r in S.replication(v).collect()}["size"] == "untested"


def test_memberships_against_a_second_implementation(spark):
    """Rank correlation of at least 0.999 and no difference above 1e-6."""
    rng = np.random.default_rng(8)
    x = pd.DataFrame(rng.uniform(size=(60, 16)), columns=I.INDICATORS)
    x["pe2"] = 0.5  # does not vary: takes no part
    rows = [(1, i, *map(float, r)) for i, r in enumerate(x.to_numpy())]
    got = I.memberships(I.dimension_scores(spark.createDataFrame(rows, ["phase", "topic", *I.INDICATORS]))).toPandas().sort_values("topic")
    z = (x - x.mean()) / x.std(ddof=0)
    dims = pd.DataFrame({d: z[[m for m in ms if x[m].std() > 0.01]].mean(axis=1) for d, ms in I.DIMENSIONS.items()})
    both = pd.concat([dims, x[list(I.EC)]], axis=1)
    q = both.quantile([0.25, 0.5, 0.75])
    r = (both - q.loc[0.5]) / np.maximum((q.loc[0.75] - q.loc[0.25]) / 2, 1e-9)
    core, ec = r[I.CORE].mean(axis=1), r[list(I.EC)].mean(axis=1)
    sig = lambda v: 1 / (1 + np.exp(-v))
    want = pd.DataFrame({"m_ws": sig(core), "m_trend": sig(0.5 * r["WP"] - core), "m_ec": sig(ec), "m_latent": sig(-r[[*I.CORE, "WP"]].mean(axis=1))})
    for c in want:
        assert np.abs(got[c].to_numpy() - want[c].to_numpy()).max() < 1e-6 and np.corrcoef(got[c].rank(), want[c].rank())[0, 1] > 0.999


def test_class_shares_against_null(spark):
    rng = np.random.default_rng(4)
    rows = [(1, t, *map(float, rng.uniform(size=16))) for t in range(25)]
    got = S.class_shares_against_null(spark.createDataFrame(rows, ["phase", "topic", *I.INDICATORS]), reps=40).collect()
    assert len(got) == 4 and sum(r.real for r in got) == pytest.approx(1) and sum(r.null_mean for r in got) == pytest.approx(1)
    assert all(0 <= r.p <= 1 and r.low <= r.high and r.reps == 40 and (not r.outside or r.p < 0.3) for r in got)


def test_columns_that_do_not_vary_have_no_correlation(spark):
    from topicweave.operators import kernels as K

    df = spark.createDataFrame([(1, 0.1, float(i), i * 2.0) for i in range(7)] + [(2, 0.5, 1.0, None)], "phase int, flat double, x double, y double")
    assert [r.rho for r in K.spearman(df, ["phase"], "flat", "x").collect()] == [None, None]
    assert {r.phase: r.rho for r in K.spearman(df, ["phase"], "x", "y").collect()} == {1: pytest.approx(1.0)}
    ind = spark.createDataFrame([(1, *([0.3] * 16)), (1, *([0.3] * 16))], ["phase", *I.INDICATORS])
    assert tuple(S.mean_within(ind, ["phase"]).first()) == (1, None, None)


def test_growth_of_a_single_year_is_zero(spark):
    from topicweave.operators import temporal as P

    df = spark.createDataFrame([(1, 1, 2010, 0.5), (1, 2, 2010, 0.2), (1, 2, 2010, 0.4)], "phase int, topic int, year int, share double")
    assert {r.topic: r.ols_growth for r in P.linear_growth(df).collect()} == {1: 0.0, 2: 0.0}
