"""The queries of this package by name, and SQL for those that SQL can express on whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.llm import clusters, leakage, mixture, names, reading, site_lines, textform
from topicweave.operators.graph import reliable


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _clusters(spark: SparkSession, d: str) -> DataFrame:
    return clusters.RecordClusters(_table(spark, d, "publications"), "uid", ["title", "abstract"], "abstract").assign()


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 1: records that treat the same narrow subject."""
    return clusters.cluster_pairs(_clusters(spark, d), "uid")


def p1_members(spark: SparkSession, d: str) -> DataFrame:
    """Problem 1: every record's cluster."""
    return _clusters(spark, d).select("uid", "cluster", F.round("flow", 6).alias("flow"))


def p1_clusters(spark: SparkSession, d: str) -> DataFrame:
    """Problem 1: each cluster's size and most typical records."""
    return clusters.cluster_report(reliable(_clusters(spark, d)), "uid")


_SITE = ("row_id", "uid", "abstract", "source_title")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 2: the lines of abstracts that belong to the journal."""
    return site_lines.SiteLines(_table(spark, d, "publications"), *_SITE).found().select("row_id", "line_no")


def p2_lines(spark: SparkSession, d: str) -> DataFrame:
    """Problem 2: the repeated lines of each journal."""
    return site_lines.SiteLines(_table(spark, d, "publications"), *_SITE).report()


def p2_clean(spark: SparkSession, d: str) -> DataFrame:
    """Problem 2: each abstract without them."""
    return site_lines.SiteLines(_table(spark, d, "publications"), *_SITE).without()


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 4: rows whose title or abstract looks the same and is written differently."""
    return textform.look_alike_pairs(_table(spark, d, "publications"), "row_id", ["title", "abstract"])


def p4_texts(spark: SparkSession, d: str) -> DataFrame:
    """Problem 4: both fields of every row in one form."""
    return textform.canonical_texts(_table(spark, d, "publications"), "row_id", ["title", "abstract"])


def _organisations(spark: SparkSession, d: str) -> DataFrame:
    return names.organisations(_table(spark, d, "author_orcid"), "affiliation")


def _persons(spark: SparkSession, d: str, organisations: DataFrame) -> DataFrame:
    rows = _table(spark, d, "author_orcid").select("author", "orcid", F.col("affiliation").alias("name"))
    rows = rows.join(organisations.withColumnRenamed("entity", "organisation"), "name", "left")
    orcid = F.when(F.col("orcid").rlike(r"^\d{4}-\d{4}-\d{4}-\d{3}[\dX]$"), F.col("orcid"))
    return names.persons(rows, "author", [(orcid, "orcid"), (F.col("organisation"), "organisation")], _table(spark, d, "given_short"), "given_name", "short_form")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: pairs of spellings that mean the same person or organisation."""
    organisations = reliable(_organisations(spark, d))
    org = names.same_entity_pairs(organisations).select(F.lit("org").alias("kind"), "name_a", "name_b")
    return names.same_entity_pairs(_persons(spark, d, organisations)).select(F.lit("author").alias("kind"), "name_a", "name_b").unionByName(org)


def p5_entities(spark: SparkSession, d: str) -> DataFrame:
    """Problem 5: every spelling with the person or organisation it means and the score of the rewriting."""
    organisations = reliable(_organisations(spark, d))
    org = organisations.select(F.lit("org").alias("kind"), "name", "entity", F.lit(1.0).alias("score"))
    return _persons(spark, d, organisations).select(F.lit("author").alias("kind"), "name", "entity", F.round("score", 6).alias("score")).unionByName(org)


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 6: documents and the test items they leak."""
    return leakage.leaks(_table(spark, d, "documents"), "doc_id", "text", _table(spark, d, "eval_items"), "item_id", "passage")


def p6_items(spark: SparkSession, d: str) -> DataFrame:
    """Problem 6: every test item with the number of documents that leak it."""
    return leakage.leak_report(p6_found(spark, d), "doc_id", "item_id", _table(spark, d, "eval_items"))


def _sized(spark: SparkSession, d: str) -> DataFrame:
    docs = _table(spark, d, "documents").select("doc_id", "source", mixture.token_counter()(F.col("text")).alias("n_tokens"))
    return reliable(docs)


def p7_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Problem 7: the mixture, one row per copy taken."""
    return mixture.mix_sources(_sized(spark, d), "doc_id", "source", _table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    """Problem 7: the shares planned and reached, and which sources are full."""
    sized, targets = _sized(spark, d), _table(spark, d, "mix_targets")
    return mixture.mixture_report(mixture.mix_sources(sized, "doc_id", "source", targets), sized, "source", targets)


def _model(spark: SparkSession, d: str) -> reading.ReadingModel:
    return reading.fit_graded(_table(spark, d, "reading_samples"), "text", "band")


def _all_levels(spark: SparkSession, d: str) -> DataFrame:
    return reading.levels_by_language(_table(spark, d, "documents"), "doc_id", "text", "lang", "en", _model(spark, d))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: the band of every English document of at least 100 pieces."""
    return reading.reading_levels(_table(spark, d, "documents").filter("lang = 'en'"), "doc_id", "text", _model(spark, d), 100).select("doc_id", "band")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: a level for every document that has words, with its score and what it rests on."""
    return _all_levels(spark, d).select("doc_id", "band", F.round("score", 6).alias("score"), "basis")


def p8_sources(spark: SparkSession, d: str) -> DataFrame:
    """Problem 8: documents of each level by source."""
    levels = _all_levels(spark, d).select("doc_id", "band", "basis")
    return _table(spark, d, "documents").select("doc_id", "source").join(levels, "doc_id").groupBy("source", "band", "basis").agg(F.count(F.lit(1)).alias("documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_members, p1_clusters, p2_found, p2_lines, p2_clean, p4_found, p4_texts, p5_found, p5_entities, p6_found, p6_items, p7_mixture, p7_shares, p8_found, p8_levels, p8_sources)}


def oracle_sql() -> dict[str, str]:
    return {}
