import numpy as np
from pyspark.sql import functions as F

from topicweave.functions import text as T
from topicweave.operators import permuted_texts as P
from topicweave.operators import resample as S
from topicweave.plans import fixtures as X
from topicweave.plans import queries as core
from topicweave.plans.prepare_queries import STOP, phrases_of


def _written(spark) -> int:
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    found = sc.statusStore().executorList(False)
    return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))


def test_draws_are_those_of_spark(spark):
    df = spark.range(50).select(F.xxhash64(F.col("id").cast("string")).alias("u"))
    for rep in (1, 7):
        got = df.withColumn("h", F.pmod(F.xxhash64(F.lit(42), F.lit(rep), "u"), F.lit(P.TOP))).toPandas()
        assert (P.draws(got.u.to_numpy(np.int64), rep, 42) == got.h).all()


def test_phrases_are_those_of_the_columns(spark):
    texts = ["The qubit-array of a trap; don't (re)use x trapped ions, ions", "", "of a b", "ÄB İon KelvinK a| |b c2 d'e\n- -- x1\ty1", "same same same", "it's new\x0bline\x1cions"]
    df = spark.createDataFrame(list(enumerate(texts)), "row long, t string")
    got = df.select("row", T.marked(F.col("t")).alias("m"), F.size(F.array_distinct(T.phrases(F.col("t"), STOP))).alias("n")).orderBy("row").collect()
    terms, text = P.phrase_postings([r.m for r in got], STOP)
    assert np.bincount(text, minlength=len(texts)).tolist() == [r.n for r in got]
    assert len(np.unique(terms)) == df.select(F.explode(T.phrases(F.col("t"), STOP)).alias("p")).distinct().count()


def _corpus(spark):
    """Two topics of several slices, one with a year without phrases, one of two years and one of many records with few words."""
    rng, rows = np.random.default_rng(3), []
    for topic, n, years in ((0, 90, 5), (1, 40, 4), (2, 12, 2), (-1, 9, 4)):
        for k in range(n):
            year = 2000 + int(rng.integers(years))
            words = " ".join(f"w{int(x)}" for x in rng.zipf(1.5, 9) % 60)
            text = None if topic == 1 and year == 2001 else words + " of " + words[:5]
            rows.append((f"u{topic}_{k}", 1, topic, None if k % 17 == 5 else year, "Trap, the ions" if k % 3 else None, text))
    df = spark.createDataFrame(rows, "uid string, phase int, topic int, year int, title string, abstract string")
    return df.withColumn("row", F.xxhash64("uid", F.lit(1)))


def test_permuted_texts_equal_rows_by_replicate(spark, monkeypatch):
    monkeypatch.setattr(P, "SLICE", 20)
    monkeypatch.setattr(P, "FEW", 2)
    p = _corpus(spark).persist()
    want = S.time_permutation_ses(p, phrases_of(p.select("uid", "phase", "topic", "year", "title", "abstract")), 12, mode="years", out="x").toPandas()
    texts = p.select("phase", "topic", "row", T.marked(F.concat_ws(" | ", "title", "abstract")).alias("text"))
    spare = texts.withColumn("row", F.col("row") + 1).withColumn("text", F.lit("an older delivery"))
    got = S.phrase_permutation_ses(p, texts.unionByName(spare), STOP, 12, out="x").toPandas()
    a, b = (x.sort_values(["phase", "topic"]).reset_index(drop=True) for x in (want, got))
    assert a.topic.tolist() == b.topic.tolist() == [0, 1]
    np.testing.assert_allclose(a[["observed", "x"]], b[["observed", "x"]], rtol=1e-9)


def test_phrases_are_not_moved_once_per_replicate(spark, data):
    phrases = phrases_of(X.pub(spark, data).filter("topic >= 0").select("uid", "title", "abstract")).count()
    before = _written(spark)
    assert core.queries()["resample_time_permutation_phrases"](spark, data).count() > 0
    assert _written(spark) - before < 51 * 8 * phrases, "a number for each phrase and replicate is more than the query may move"
