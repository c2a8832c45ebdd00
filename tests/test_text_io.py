import pytest
from pyspark.sql import functions as F

from topicweave.functions import lexicon as L
from topicweave.functions import text as T
from topicweave.plans import prepare as R
from topicweave.sources import io
from topicweave.streaming import yearly


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        ("A $x^2$ b", "A b"),
        ("A \\textbf{x} b \\alpha", "A b"),
        ("\\(\\lambda\\) low <sub>2</sub> end", "low 2 end"),
        ("Text. © 2015 Press. All rights reserved.", "Text."),
        ("a b\u001cc", "a b c"),
        ("", ""),
        (None, ""),
        ("ﬁne １ ² ; end .", "fine 1 2; end."),
        ("Two lines .\n\u00a9 2015 Press", "Two lines."),
    ],
)
def test_clean(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(T.cleaned(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [("early access article|review", "review"), ("early access article", "early access article"), ("", None), (None, None)])
def test_doctype(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(T.clean_doctype(F.col("t"))).first()[0] == want


@pytest.mark.parametrize(("raw", "want"), [("U.K.", "U.K"), ("United Kingdom", "UK"), ("Peoples R China", "CHN"), (" germany. ", "GERMANY"), ("X", None), (None, None)])
def test_country(spark, raw, want):
    assert spark.createDataFrame([(raw,)], "t string").select(T.normalise_country(F.col("t"))).first()[0] == want


def test_sentences_keep_abbreviations(spark):
    t = "We found it (e.g. Fig. 4). Two more. 3 results follow! done"
    assert spark.createDataFrame([(t,)], "t string").select(T.sentences(F.col("t"))).first()[0] == ["We found it (e.g. Fig. 4).", "Two more.", "3 results follow! done"]


def test_phrases(spark):
    got = spark.createDataFrame([("The quantum gate array, of cold atoms",)], "t string").select(T.phrases(F.col("t"), ["the", "of"])).first()[0]
    assert set(got) == {"quantum", "gate", "array", "quantum gate", "gate array", "cold", "atoms", "cold atoms"}


def test_delivery_and_edges(spark, tmp_path):
    (tmp_path / "d.csv").write_text('UID , title,Unnamed: 0\n u1 , nan,0\nu2,"a, b",1\n')
    rows = io.read_delivery(spark, str(tmp_path / "d.csv"), ["UID", "title", "missing"]).orderBy("UID").collect()
    assert [tuple(r) for r in rows] == [("u1", "", None), ("u2", "a, b", None)]
    (tmp_path / "e.csv").write_text('UID,UID_ref\n"u1",r1\nu1,r1\nu2,\n')
    assert [tuple(r) for r in io.read_edges(spark, str(tmp_path / "e.csv")).collect()] == [("u1", "r1")]


def test_ratings(spark, tmp_path):
    (tmp_path / "r.csv").write_text("nr;satz;rating\n1;no nr here;3\n2;y;4,5\n3;z;\n4;w;9\n;;\n5;v;x\n6;u;6,0\n")
    got = io.read_ratings(spark, str(tmp_path / "r.csv")).orderBy("nr").collect()
    assert [tuple(r) for r in got] == [(1, 3, "valid"), (2, None, "invalid"), (3, None, "empty"), (4, None, "invalid"), (5, None, "invalid"), (6, 6, "valid")]
    with pytest.raises(ValueError):
        io.read_ratings(spark, str(tmp_path / "r.csv"), rating="absent")


def test_sentence_lines_and_lexicon(spark, tmp_path):
    (tmp_path / "s.jsonl").write_text('{"doc": "a", "parts": ["One.", "Two."]}\n{"doc": "b", "parts": []}\n')
    assert [tuple(r) for r in io.read_sentences(spark, str(tmp_path / "s.jsonl"), "parts").collect()] == [("a", 0, "One."), ("a", 1, "Two.")]
    (tmp_path / "l.json").write_text('{"hedges": ["may", "in general"],\n "boosters": ["must"]}')
    lex = io.read_lexicon(spark, str(tmp_path / "l.json")).collect()
    by = {k: [r.phrase for r in lex if r.kind == k] for k in ("hedges", "boosters")}
    df = spark.createDataFrame([("In general, it may be so. It must not, in general may.",), ("",), (None,)], "t string")
    got = df.select(L.hedge_counts(F.col("t"), by["hedges"], by["boosters"]).alias("c")).collect()
    assert tuple(got[0].c) == (4, 1, 12) and tuple(got[1].c) == (0, 0, 0) and got[2].c is None


def test_phrase_words_do_not_count_twice(spark):
    df = spark.createDataFrame([("To a certain extent it is certain. Of course, without doubt.",)], "t string")
    assert tuple(df.select(L.hedge_counts(F.col("t")).alias("c")).first().c) == (1, 3, 11)


def test_digest_ignores_order(spark):
    a = spark.createDataFrame([(1, "x"), (2, None), (2, None)], "n int, s string")
    same, other = a.orderBy("n", ascending=False).select("s", "n"), a.distinct()
    d = lambda df: io.table_digest(df).first().digest
    assert d(a) == d(same) != d(other) and io.table_digest(a.limit(0)).first().rows == 0


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "phase int, x string")
    io.write_table(df, str(tmp_path / "t"), "phase")
    assert spark.read.parquet(str(tmp_path / "t")).filter("phase = 2").first().x == "b"
    io.append_log(spark, str(tmp_path / "log"), {"step": 1})
    io.append_log(spark, str(tmp_path / "log"), {"step": 2})
    assert spark.read.parquet(str(tmp_path / "log")).count() == 2


def test_synthetic(spark):
    df = io.synthetic_corpus(spark, 500, 5)
    assert df.count() == 500 and df.select("topic").distinct().count() == 5 and 2014 <= df.agg(F.min("year")).first()[0]


def test_rename_and_alias(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    assert io.rename_present(df, {"a": "x", "zz": "y"}).columns == ["x", "b"] and io.add_aliases(df, {"a": "b", "b": "c"}).columns == ["a", "b", "c"]


def test_corpus_drops_short_and_undated(spark):
    rows = [("u1", 1, 2010, "A title here", "one two three four five six seven eight"), ("u2", 1, None, "t", "word " * 20), ("u3", 1, 2010, "t", ""), ("u4", 1, 2010, "t", "short")]
    df = spark.createDataFrame(rows, "uid string, phase int, year int, title string, abstract string")
    assert [r.uid for r in R.corpus(df, 2000, 2025).collect()] == ["u1"]


def test_late_deliveries_in_stream(spark, tmp_path):
    import datetime as dt

    t = dt.datetime(2025, 1, 1, tzinfo=dt.UTC)
    rows = [("u1", 1, 3, 2010, t), ("u1", 1, 3, 2010, t + dt.timedelta(days=1)), ("u2", 1, 3, 2010, t), ("u3", 1, -1, 2010, t)]
    spark.createDataFrame(rows, "uid string, phase int, topic int, year int, loaded_at timestamp").coalesce(1).write.parquet(str(tmp_path / "s"))
    s = spark.readStream.schema(spark.read.parquet(str(tmp_path / "s")).schema).parquet(str(tmp_path / "s"))
    q = yearly.yearly_counts(s).writeStream.outputMode("complete").format("memory").queryName("late").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [tuple(r) for r in spark.table("late").collect()] == [(1, 3, 2010, 2)]


def test_packed_entries_lose_blanks_and_keep_digits(spark):
    df = spark.createDataFrame([(" 0 zero | 1 one|2 two |",)], "t string")
    assert tuple(df.select(T.packed_list(F.col("t")), T.clean_doctype(F.col("t"))).first()) == ("0 zero; 1 one; 2 two", "0 zero")
    refs = spark.createDataFrame([("Kay A, 2010 , J Phys, V1, DOI 10.1/AB",), ("1 Kay , 2011, 2 Two , x",), (None,)], "t string")
    assert [r[0] for r in refs.select(T.reference_key(F.col("t"))).collect()] == ["10.1/ab", "1 KAY, 2011, 2 TWO", None]
