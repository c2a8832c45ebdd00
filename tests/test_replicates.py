import inspect

import numpy as np

from topicweave.operators import indicators as I
from topicweave.operators import multivariate as N
from topicweave.operators import resample as S
from topicweave.plans import queries as core
from topicweave.plans import resample_queries as Q


def test_replicates_are_those_of_the_survey():
    of = lambda f: inspect.signature(f).parameters["reps"].default
    assert [of(f) for f in (S.null_model, S.perturbed, S.bootstrap_rho, S.random_weights, S.time_permutation_ses, S.split_halves, S.rarefied, N.parallel_analysis)] == [1000, 1000, 2000, 1000, 50, 50, 30, 200]


def test_queries_ask_for_all(monkeypatch, spark, data):
    asked = {}

    def spy(module, name):
        f = getattr(module, name)
        monkeypatch.setattr(module, name, lambda *a, **k: (b := inspect.signature(f).bind(*a, **k), b.apply_defaults(), asked.update({name: b.arguments["reps"]}), f(*a, **k))[-1])

    for m, n in ((S, "split_halves"), (S, "rarefied"), (S, "time_permutation_ses"), (S, "random_weights"), (N, "parallel_analysis")):
        spy(m, n)
    rng = np.random.default_rng(1)
    ind = spark.createDataFrame([(1, t, *[float(x) for x in rng.uniform(size=16)]) for t in range(30)], ["phase", "topic", *I.INDICATORS])
    monkeypatch.setattr(Q, "indicators16", lambda spark, d: ind)
    monkeypatch.setattr(Q, "_base", lambda spark, d: I.dimension_scores(ind))
    shares = None
    for name in ("resample_split_half", "resample_rarefaction", "resample_time_permutation", "resample_random_weights", "multi_factor_adequacy"):
        out = core.queries()[name](spark, data)
        shares = out if name == "resample_random_weights" else shares
    assert asked == {"split_halves": 50, "rarefied": 30, "time_permutation_ses": 50, "random_weights": 1000, "parallel_analysis": 200}
    assert all(abs(r.s - 1) < 1e-4 for r in shares.groupBy("phase", "topic").sum("share").toDF("phase", "topic", "s").collect())
    assert {r.reps for r in core.queries()["resample_null_model"](spark, data).collect()} == {1000}
