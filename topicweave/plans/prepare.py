"""Corpus preparation: deliveries to one canonical table, and the documents that the topic steps read (IO2, IO5, J1, P3-P8)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.functions import text as T
from topicweave.operators.indicators import author_key  # noqa: F401 (re-exported for the pipelines)


def pivot_levels(topics: DataFrame) -> DataFrame:
    """S25f: (uid, ct_macro, ct_meso, ct_micro): the first line of each level, levels in any letter case."""
    level = F.lower(F.trim("topic_type"))
    first = topics.filter(T.present(F.col("ctopiclabel")).isNotNull()).withColumn("level", level)
    agg = [F.min_by(F.trim("ctopiclabel"), F.when(F.col("level") == x, F.col("line_nr"))).alias(f"ct_{x}") for x in ("macro", "meso", "micro")]
    return first.groupBy("uid").agg(*agg)


def packed_authors(authors: DataFrame) -> DataFrame:
    """S26f: (uid, authors, orcid_pairs): names in author order, and name/ORCID pairs with empty slots kept."""
    one = authors.groupBy("uid", "seq").agg(F.min(F.struct("mention_id", "author", "orcid")).alias("m"))
    rows = one.groupBy("uid").agg(F.sort_array(F.collect_list(F.struct("seq", "m.author", "m.orcid"))).alias("a"))
    pair = lambda x: F.when(F.length(x["orcid"]) > 0, F.concat_ws("/", x["author"], x["orcid"])).otherwise("")
    return rows.select("uid", F.array_join(F.transform("a", lambda x: F.coalesce(x["author"], F.lit(""))), "; ").alias("authors"), F.array_join(F.transform("a", pair), "; ").alias("orcid_pairs"))


def canonical(pub: DataFrame, topics: DataFrame, authors: DataFrame) -> DataFrame:
    """IO2: one row per record: typed columns, normalised lists, citation levels and authors joined by uid (side tables have one row a uid)."""
    base = pub.select(
        "uid", "phase", F.trim("title").alias("title"), F.trim("abstract").alias("abstract"), F.col("pub_year").alias("year"), T.clean_doctype(F.col("doc_type")).alias("doc_type"),
        F.trim("source_title").alias("source_title"), T.packed_list(F.col("author_keywords")).alias("author_keywords"), T.packed_list(F.col("country_list")).alias("countries"),
        F.coalesce("times_cited", F.lit(0)).alias("times_cited"), "rtw", "ctw", "doi", "country_count",
    )
    return base.join(pivot_levels(topics), "uid", "left").join(packed_authors(authors), "uid", "left")


def corpus(pub: DataFrame, first: int, last: int, least_words: int = 10) -> DataFrame:
    """IO5, P3-P5: (uid, phase, year, text): records with an abstract, a year in range and at least ``least_words`` cleaned words."""
    d = pub.filter(F.col("year").between(first, last) & (F.length(F.trim("abstract")) > 0))
    d = d.select("uid", "phase", "year", T.topic_text(F.col("title"), F.col("abstract")).alias("text"))
    return d.filter(T.word_count(F.col("text")) >= least_words)


def artefacts(texts: DataFrame, column: str) -> DataFrame:
    """How many texts hold LaTeX commands, formulas, HTML tags, copyright tails, or any of them."""
    c = F.col(column)
    math = c.rlike(T.LATEX[0]) | c.rlike(T.LATEX[1])
    cmd, tag, tail = c.rlike(T.LATEX[3]), c.rlike(T.HTML), c.rlike(T.COPYRIGHT)
    return texts.filter(F.length(c) > 0).agg(F.count(F.lit(1)).alias("n_total"), F.count_if(cmd).alias("latex_cmd"), F.count_if(math).alias("inline_math"), F.count_if(tag).alias("html_tag"), F.count_if(tail).alias("copyright_tail"), F.count_if(cmd | math | tag | tail).alias("n_with_any"))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """(column, filled, share): non-blank values of each column, one pass."""
    filled = lambda c: F.count_if(F.col(c).isNotNull() & (F.trim(F.col(c).cast("string")) != ""))
    one = df.agg(F.count(F.lit(1)).alias("n"), *[filled(c).alias(c) for c in columns])
    return one.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("filled"), (F.col(c) / F.col("n")).alias("share")) for c in columns])))


def coverage(pub: DataFrame, columns: list[str], least: int = 10, share: float = 0.9) -> DataFrame:
    """(phase, column, topics_ok, passed): share of topics with at least ``least`` records that have the field."""
    per = pub.filter("topic >= 0").groupBy("phase", "topic").agg(*[F.count_if(F.length(F.trim(F.col(c).cast("string"))) > 0).alias(c) for c in columns])
    one = per.groupBy("phase").agg(*[F.avg((F.col(c) >= least).cast("double")).alias(c) for c in columns])
    long = one.unpivot(["phase"], columns, "column", "topics_ok")
    return long.withColumn("passed", F.col("topics_ok") >= share)
