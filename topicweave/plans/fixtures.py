"""Inputs of the core queries over the test tables, and the same as SQL for DuckDB.

A *publication* is the newest delivery of a ``uid`` (by ``loaded_at``, then ``row_id``). Its topic is the number of its macro
citation topic, -1 (noise) where that is missing; its vector is the embedding whose number its ``row_id`` falls on.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def newest(df: DataFrame, key: str, order: list) -> DataFrame:
    """One row per key, the first in ``order`` (a total order): the distinct that keeps a declared row."""
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")


def topic_of(p: DataFrame) -> DataFrame:
    topic = F.coalesce(F.nullif(F.regexp_extract("ct_macro", r"^([0-9]+) ", 1), F.lit("")), F.lit("-1")).cast("int")
    return p.withColumn("topic", topic)


def pub(spark: SparkSession, d: str) -> DataFrame:
    p = newest(table(spark, d, "publications"), "uid", [F.desc("loaded_at"), F.desc("row_id")])
    return topic_of(p).withColumn("year", F.col("pub_year"))


PUB = """pub AS (SELECT * EXCLUDE (k), CAST(coalesce(nullif(regexp_extract(ct_macro, '^([0-9]+) ', 1), ''), '-1') AS INT) AS topic, pub_year AS year
 FROM (SELECT *, row_number() OVER (PARTITION BY uid ORDER BY loaded_at DESC, row_id DESC) AS k FROM publications) WHERE k = 1)"""

#: List fields: column, pattern of the separators, whether values are lower-cased.
LISTS = {
    "kw": ("author_keywords", r"[|]", True),
    "kwp": ("keywords_plus", r"[;|,·\t]", True),
    "cat": ("wos_categories", r"[;|]", False),
    "inst": ("affiliations", r"[;|]", False),
    "ctry": ("country_list", r"[|]", True),
}


def terms(p: DataFrame, kind: str, keep: list[str] = ("uid", "phase", "topic", "year")) -> DataFrame:
    """(keep…, term): the non-empty entries of a list field of publications, repeats kept."""
    column, sep, low = LISTS[kind]
    t = F.trim(F.col("term"))
    out = p.select(*keep, F.explode(F.split(F.col(column), sep)).alias("term"))
    return out.withColumn("term", F.lower(t) if low else t).filter("term <> ''")


def terms_sql(kind: str) -> str:
    column, sep, low = LISTS[kind]
    t = "lower(trim(x))" if low else "trim(x)"
    sep = sep.replace("\\t", "\t")
    return f"{kind} AS (SELECT uid, phase, topic, year, {t} AS term FROM (SELECT uid, phase, topic, year, unnest(string_split_regex({column}, '{sep}')) AS x FROM pub) WHERE trim(x) <> '')"


def vectors(spark: SparkSession, d: str, p: DataFrame | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """(uid, phase, topic, year, embedding, size, keep…) of every publication."""
    e = table(spark, d, "embeddings")
    n = e.count()
    p = pub(spark, d) if p is None else p
    return p.withColumn("vec_id", F.pmod("row_id", F.lit(n))).join(e.select("vec_id", "embedding"), "vec_id").select("uid", "phase", "topic", "year", "embedding", F.col("size") if "size" in p.columns else F.length("abstract").alias("size"), *keep)


VEC = "vec AS (SELECT uid, phase, topic, year, embedding, length(abstract) AS size FROM pub JOIN embeddings ON vec_id = row_id % (SELECT count(*) FROM embeddings))"


def authors(spark: SparkSession, d: str, p: DataFrame | None = None) -> DataFrame:
    """(uid, phase, topic, year, seq, author, orcid): author mentions of publications, one per place."""
    a = table(spark, d, "author_orcid").groupBy("uid", "seq").agg(F.min(F.struct("mention_id", "author", "orcid")).alias("m"))
    p = pub(spark, d) if p is None else p
    return a.select("uid", "seq", "m.author", "m.orcid").join(p.select("uid", "phase", "topic", "year"), "uid")


AUTHORS = """au AS (SELECT a.uid, seq, author, orcid, phase, topic, year FROM (SELECT uid, seq, author, orcid,
 row_number() OVER (PARTITION BY uid, seq ORDER BY mention_id) AS k FROM author_orcid) a JOIN pub USING (uid) WHERE k = 1)"""


def with_sql(*parts: str) -> str:
    return "WITH " + ",\n".join((PUB, *parts)) + "\n"
