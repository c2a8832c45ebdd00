import pytest
from pyspark.sql import functions as F

from topicweave.llm import mixture as M

TARGETS = [("big", 0.5, 1), ("small", 0.3, 3), ("none", 0.2, 2), ("off", 0.0, 2)]


def docs(spark):
    rows = [(i, "big", 50 + i % 37) for i in range(2000)] + [(5000 + i, "small", 80 + i % 11) for i in range(90)] + [(9000, "big", 0), (9001, None, 5), (9002, "other", 5), (9003, "off", 5), (9004, "big", None)]
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def targets(spark, rows=TARGETS):
    return spark.createDataFrame(rows, "source string, target_share double, max_repeats int")


def rep_tokens(d, source):
    return d.filter(F.col("source") == source).agg(F.sum("n_tokens")).first()[0]


def brute_plan(tokens, targets, total):
    """Raise the common level until the total is met or all are full, by halving."""
    cap = {s: m * tokens[s] for s, w, m in targets if w > 0 and tokens.get(s)}
    want = {s: w for s, w, m in targets if s in cap}
    if sum(cap.values()) <= total:
        return cap
    lo, hi = 0.0, max(cap[s] / want[s] for s in cap)
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(mid * want[s], cap[s]) for s in cap) < total else (lo, mid)
    return {s: min(hi * want[s], cap[s]) for s in cap}


@pytest.mark.parametrize("total", [None, 100.0, 3000.0, 20000.0, 10.0**7])
def test_plan_fills_like_water(spark, total):
    tokens = {"one": 40, "few": 900, "many": 9000, "most": 30000}
    t = [("one", 0.3, 6), ("few", 0.2, 2), ("many", 0.2, 1), ("most", 0.1, 1), ("absent", 0.2, 3)]
    sized = spark.createDataFrame(list(tokens.items()), "source string, n_tokens long")
    got = {r.source: r.copies * r.tokens for r in M.source_plan(sized, targets(spark, t), "source", total).collect() if r.tokens}
    assert got == pytest.approx(brute_plan(tokens, t, total or sum(tokens.values())))


def test_a_source_of_one_document_does_not_size_the_mixture(spark):
    d = docs(spark).unionByName(spark.createDataFrame([(7000, "tiny", 40)], "doc_id long, source string, n_tokens long"))
    t = targets(spark, [("big", 0.5, 1), ("small", 0.2, 3), ("tiny", 0.3, 6)])
    rep = {r.source: r for r in M.mixture_report(M.mix_sources(d, "doc_id", "source", t), d, "source", t).collect()}
    assert rep["tiny"].taken == 6 == rep["tiny"].most_copies and rep["tiny"].full and rep["tiny"].share_reached < 0.01
    assert rep["big"].taken + rep["small"].taken > 2000


def test_shares_and_repeats(spark):
    d, t = docs(spark), targets(spark)
    mix = M.mix_sources(d, "doc_id", "source", t).cache()
    rep = {r.source: r for r in M.mixture_report(mix, d, "source", t).collect()}
    # 'small' has too little for its share: it gives all it has three times, 'big' gives the rest, which is all it has
    assert rep["small"].full and rep["small"].tokens == 3 * rep_tokens(d, "small") and rep["big"].most_copies == 1
    assert rep["big"].share_reached == pytest.approx(rep["big"].planned_share, abs=0.01) and rep["small"].share_reached == pytest.approx(rep["small"].planned_share, abs=0.01)
    assert rep["none"].tokens == 0 and rep["off"].taken == 0 and rep["small"].most_copies <= 3 and rep["big"].most_copies == 1
    assert mix.groupBy("doc_id", "copy").count().filter("count > 1").count() == 0


def test_each_document_is_taken_its_expected_number_of_times(spark):
    d, t = docs(spark), targets(spark)
    plan = {r.source: r.copies for r in M.source_plan(d.filter("n_tokens > 0"), t, "source").collect()}
    got = M.mix_sources(d, "doc_id", "source", t).groupBy("source", "doc_id").count().groupBy("source").agg(F.min("count").alias("lo"), F.max("count").alias("hi"), F.sum("count").alias("n")).collect()
    sizes = {"big": 2000, "small": 90}
    for r in got:
        assert r.hi <= int(plan[r.source]) + 1 and abs(r.n - plan[r.source] * sizes[r.source]) <= 1


def test_slices_give_the_same_counts(spark, monkeypatch):
    d, t = docs(spark).withColumn("n_tokens", F.lit(60).cast("long")).filter("source IN ('big', 'small')"), targets(spark)
    a = M.mix_sources(d, "doc_id", "source", t).groupBy("source").count().collect()
    monkeypatch.setattr(M, "SLICE", 50)
    assert sorted(map(tuple, a)) == sorted(map(tuple, M.mix_sources(d, "doc_id", "source", t).groupBy("source").count().collect()))


def test_given_total(spark):
    d, t = docs(spark), targets(spark)
    assert M.mix_sources(d, "doc_id", "source", t, total_tokens=20000).agg(F.sum("n_tokens")).first()[0] == pytest.approx(20000, rel=0.02)


def test_extra_columns_and_empty(spark):
    d = docs(spark).withColumns({"copies": F.lit("x"), "text": F.lit("t"), "max_repeats": F.lit(1)})
    out = M.mix_sources(d, "doc_id", "source", targets(spark))
    assert {"copies", "text", "max_repeats", "copy"} <= set(out.columns) and out.count() > 0
    assert M.mix_sources(docs(spark).limit(0), "doc_id", "source", targets(spark)).count() == 0


def test_tokens(spark):
    got = spark.createDataFrame([("hello world",), ("",), (None,), ("a " * 30000,)], "t string").select(M.token_counter()(F.col("t")).alias("n")).collect()
    assert [r.n for r in got][:3] == [2, 0, None] and got[3].n >= 30000
