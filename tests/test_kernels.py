import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.operators import candidates as C
from topicweave.operators import cluster as L
from topicweave.operators import kernels as K
from topicweave.operators import multivariate as N
from topicweave.operators import resample as S
from topicweave.operators import validation as V
from topicweave.operators.graph import connected_components


def test_components_against_union_find(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(200)] + [(7, 7), (None, 3)] + [(1000 + i, 1001 + i) for i in range(60)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        if a is not None and a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a int, b int"), "a", "b").collect()}
    assert got == {x: find(x) for x in root}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "a int, b int"), "a", "b").count() == 0


def test_gini_with_ties_and_zeros(spark):
    rows = [("a", x) for x in (0, 0, 1, 5, 5)] + [("b", 0), ("b", 0), ("c", 3)]
    got = {r.g: (r.n, r.gini) for r in K.gini(spark.createDataFrame(rows, "g string, x int"), ["g"], "x").collect()}
    xs = sorted(x for g, x in rows if g == "a")
    want = 2 * sum(i * x for i, x in enumerate(xs, 1)) / (5 * sum(xs)) - 6 / 5
    assert got["a"] == (5, pytest.approx(want)) and got["b"] == (2, 0.5) and got["c"] == (1, pytest.approx(0))


def test_average_rank(spark):
    got = K.avg_rank(spark.createDataFrame([(1, 10), (2, 20), (3, 20), (4, 30), (5, None)], "i int, v int"), [], "v").orderBy("i").collect()
    assert [r["rank"] for r in got] == [1, 2.5, 2.5, 4, None]


def test_ruzicka_empty_side(spark):
    df = spark.createDataFrame([("t", "a", "x", 2), ("t", "b", "x", 1), ("t", "b", "y", 1), ("u", "a", "x", 1)], "g string, s string, term string, n long")
    got = {r.g: r.distance for r in K.ruzicka(df, ["g"], "s", "a", "b", "term").collect()}
    assert got["t"] == pytest.approx(1 - 0.5 / 1.5) and got["u"] is None


def test_jaccard_of_empty_sets(spark):
    df = spark.createDataFrame([([], []), (["a"], ["a", "b"])], "a array<string>, b array<string>")
    assert [r[0] for r in df.select(K.jaccard(F.col("a"), F.col("b"), 1.0)).collect()] == [1.0, 0.5]


def test_pair_cosine_equals_pairs(spark):
    v = np.random.default_rng(1).normal(size=(12, 5))
    df = spark.createDataFrame([("t", [float(x) for x in r]) for r in v], "g string, v array<float>")
    want = np.mean([v[i] @ v[j] for i in range(12) for j in range(12) if i != j])
    assert K.pair_cosine(df, ["g"], "v").first().cosine == pytest.approx(want, abs=1e-5)


def test_dominant_tie_goes_to_first(spark):
    df = spark.createDataFrame([(0.5, 0.5), (0.1, 0.2)], "a double, b double")
    assert [r[0] for r in df.select(K.dominant({"first": "a", "second": "b"})).collect()] == ["first", "second"]


def test_reference_overlap_of_equal_sets(spark):
    edges = spark.createDataFrame([("a", "x"), ("b", "x"), ("c", "x"), ("c", "y"), ("d", None), ("a", "x")], "uid string, uid_ref string")
    docs = spark.createDataFrame([(u, 1) for u in "abcd"], "uid string, g int")
    r = V.reference_overlap(edges, docs, ["g"]).first()
    assert (r.n_refs, r.overlap) == (3, pytest.approx((1 + 0.5 + 0.5) / 3))


@pytest.mark.parametrize(("x", "a", "b", "want"), [(0.5, 2, 2, 0.5), (0.25, 1, 1, 0.25), (0.9, 2, 1, 0.81), (0, 2, 3, 0), (1, 2, 3, 1)])
def test_beta(x, a, b, want):
    assert C.beta_cdf(x, a, b) == pytest.approx(want)


def test_chi_square_tail():
    assert N.gamma_q(1, 2) == pytest.approx(math.exp(-2)) and N.gamma_q(0.5, 0.5) == pytest.approx(math.erfc(math.sqrt(0.5)))


def test_poisson_slope():
    t = np.arange(2010, 2020)
    assert C.poisson_slope(np.round(1e6 * np.exp(0.1 * (t - 2015))), np.full(10, 1e6), t) == pytest.approx(0.1, abs=1e-4)
    assert C.poisson_slope(np.zeros(5), np.ones(5), np.arange(5)) is None


def test_factor_identities():
    rng = np.random.default_rng(0)
    f = rng.normal(size=(400, 2))
    x = np.hstack([f[:, [0]] + 0.5 * rng.normal(size=(400, 3)), f[:, [1]] + 0.5 * rng.normal(size=(400, 3))])
    r = N.correlation(x)
    load = N.principal_axis(r, 2)
    pattern, phi = N.oblimin(load)
    assert np.allclose(((pattern @ phi) * pattern).sum(1), (load**2).sum(1), atol=1e-6)
    share, comp = N.pca(x)
    assert np.allclose(comp.T @ comp, np.eye(6)) and share.sum() == pytest.approx(1)
    assert N.parallel_analysis(x, 50)[2] == 2 and 0 < N.kmo(r) < 1 and N.bartlett(r, 400)[2] < 1e-6
    assert set(N.theory_coherence(pattern, list("abcdef"), {"A": list("abc"), "B": list("def")})["verdict"]) == {"coherent"}


def test_student_p():
    assert N.student_p(0.0, 10) == pytest.approx(1) and N.student_p(0.632, 10) == pytest.approx(0.05, abs=2e-3)


def test_hash_numbers_look_normal(spark):
    r = spark.range(20000).select(S.normal(F.lit(1), "id").alias("x")).agg(F.avg("x"), F.stddev("x")).first()
    assert abs(r[0]) < 0.03 and abs(r[1] - 1) < 0.03


def test_density_clusters(spark):
    rng = np.random.default_rng(5)
    pts = np.vstack([rng.normal(0, 0.1, (60, 3)), rng.normal(4, 0.1, (60, 3)), rng.uniform(-20, 20, (20, 3))])
    df = spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(pts)], "id long, v array<double>")
    got = {r.id: r.cluster for r in L.density_clusters(df, "id", "v", k=5, radius=0.5, least=20).collect()}
    assert len({got[i] for i in range(60)}) == 1 and len({got[i] for i in range(60, 120)}) == 1 and got[0] != got[60]
    assert all(got[i] == -1 for i in range(125, 140) if min(np.linalg.norm(pts[i]), np.linalg.norm(pts[i] - 4)) > 2)


def test_control_cell_is_identical(spark):
    from topicweave.operators import indicators as I

    rng = np.random.default_rng(2)
    rows = [(1, t, *[float(x) for x in rng.uniform(size=16)]) for t in range(30)]
    ind = spark.createDataFrame(rows, ["phase", "topic", *I.INDICATORS])
    base = I.dimension_scores(ind)
    grid = S.compare(S.k_lambda_grid(base, spark), I.memberships(base), ["phase", "k", "lam"])
    control = grid.filter("k = 1.0 AND lam = 0.5").first()
    assert control.changed == 0 and all(control[f"rho_{m}"] == pytest.approx(1) for m in S.MEMBERSHIPS)
