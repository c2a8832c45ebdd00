import numpy as np
import pytest
from pyspark.sql import functions as F

from topicweave.llm import reading as R


def test_isotonic_pools():
    at, value = R.isotonic(np.array([1.0, 2, 3, 4]), np.array([0.0, 2, 1, 3]))
    assert at.tolist() == [1, 2, 4] and value.tolist() == [0, 1.5, 3]


def test_held_out_accuracy(spark, data):
    s = spark.read.parquet(f"{data}/reading_samples.parquet").orderBy("sample_id").select("text", "band").collect()
    train, held = [r for i, r in enumerate(s) if i % 4], s[::4]
    m = R.fit([r.text for r in train], [r.band for r in train])
    got = m.level(m.full.score(np.array([R.features(r.text, m.words()) for r in held])))
    assert np.mean(got == np.array([r.band for r in held])) >= 0.95


def test_single_foreign_sentences_change_nothing(spark, data):
    s = spark.read.parquet(f"{data}/reading_samples.parquet").orderBy("sample_id").select("text", "band").collect()
    m = R.fit([r.text for r in s], [r.band for r in s])
    easy, hard = next(r.text for r in s if r.band == 1), next(r.text for r in s if r.band == 4)
    mixed = easy + " " + hard[:250]
    assert m.level(m.full.score(np.array([R.features(mixed, m.words())])))[0] == 1


def test_edge_texts(spark, data):
    m = R.fit_graded(spark.read.parquet(f"{data}/reading_samples.parquet"), "text", "band")
    rows = [(1, None), (2, ""), (3, "12 34 ..."), (4, "A cat sat."), (5, "Can you push a lamp? " * 30000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("band", F.lit("clash"))
    got = {r.doc_id: r.band for r in R.reading_levels(df, "doc_id", "text", m).collect()}
    assert set(got) == {4, 5} and got[5] == 1
    assert R.reading_levels(df.limit(0), "doc_id", "text", m).count() == 0
    with pytest.raises(ValueError):
        R.fit(["a b", "c d"], [1, 1])


def test_other_languages_are_rated_by_form(spark, data):
    m = R.fit_graded(spark.read.parquet(f"{data}/reading_samples.parquet"), "text", "band")
    s = spark.read.parquet(f"{data}/reading_samples.parquet").select("text", "band").collect()
    strange = str.maketrans("aeioubdfgklmnpt", "eioaudbgflknmtp")  # other words of the same lengths
    rows = [(i, r.text, "en") for i, r in enumerate(s)] + [(1000 + i, r.text.lower().translate(strange), "xx") for i, r in enumerate(s)] + [(5000, "One word.", None), (5001, None, "en")]
    got = {r.doc_id: r for r in R.levels_by_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"), "doc_id", "text", "lang", "en", m).collect()}
    assert len(got) == 2 * len(s) + 1 and got[0].basis == "words" and got[1000].basis == "form" and got[5000].basis == "form"
    assert np.mean([got[i].band == r.band for i, r in enumerate(s)]) > 0.95
    assert np.corrcoef([got[1000 + i].band for i in range(len(s))], [r.band for r in s])[0, 1] > 0.8


def test_sentences_count(spark):
    words = R._Words({}, 2)
    short, long = "We go. You run. It is. " * 20, "We go and you run and it is so " * 20
    a, b = R.features(short, words), R.features(long, words)
    assert a[-4] < b[-4] and a[-3] < b[-3] and R.features("...", words) is None
