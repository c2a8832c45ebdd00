"""Queries for readers and sinks: what the test tables hold is written below the shared folder, in the form a reader expects, and read back."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.operators import validation as V
from topicweave.operators.graph import shared_folder
from topicweave.plans import fixtures as X
from topicweave.plans.indicator_queries import W, query, rounded
from topicweave.sources import io


def place(spark: SparkSession) -> str:
    """A new folder below the shared checkpoint folder."""
    return f"{shared_folder(spark)}/io-{uuid.uuid4().hex}"


_NAMED = {"uid": "UID", "title": "Article Title", "source_title": "Source Title", "doc_type": "Document Type"}


@query("io_delivery", "SELECT CAST(row_id AS VARCHAR) AS row_id, " + ", ".join(f"CASE WHEN trim({c}) IN ('nan', 'None') OR {c} IS NULL THEN '' ELSE trim({c}) END AS {c}" for c in ("uid", "source_title", "doi")) + ", CAST(NULL AS VARCHAR) AS absent FROM publications")
def _io1(spark, d):
    """IO1, IO4: a delivered CSV file, its columns by name, an absent one null."""
    at = place(spark)
    p = X.table(spark, d, "publications").select(F.col("row_id").alias(" row_id "), "uid", F.col("source_title").alias("source_title "), "doi", F.lit(0).alias("Unnamed: 0"))
    p.write.csv(at, header=True, escape='"', emptyValue="")
    out = io.read_delivery(spark, at, ["row_id", "uid", "source_title", "doi", "absent"])
    return out.withColumns({c: F.coalesce(c, F.lit("")) for c in ("uid", "source_title", "doi")})


@query("io_renamed", "SELECT uid AS UID, source_title AS \"Source Title\", source_title AS journal FROM publications")
def _p1(spark, d):
    """Columns renamed where they are, a second name beside one."""
    p = X.table(spark, d, "publications").select("uid", "source_title")
    return io.add_aliases(io.rename_present(p, _NAMED), {"Source Title": "journal", "Absent": "none", "UID": "Source Title"})


@query("io_edges", "SELECT DISTINCT trim(uid) AS uid, trim(uid_ref) AS uid_ref FROM reference_edges WHERE trim(uid) <> '' AND trim(uid_ref) <> ''")
def _io6(spark, d):
    """IO6, IO7 from a CSV file of quoted ids."""
    at = place(spark)
    X.table(spark, d, "reference_edges").select(F.col("uid").alias("UID"), F.col("uid_ref").alias("UID_ref")).write.csv(at, header=True, quoteAll=True)
    return io.read_edges(spark, at)


@query("io_topic_keywords", W(X.terms_sql("kw")) + "SELECT topic, keyword, score, CAST(k AS INT) AS rank FROM (SELECT topic, term AS keyword, count(*) AS score, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, term) AS k FROM kw WHERE topic >= 0 GROUP BY 1, 2) WHERE k <= 5")
def _io8(spark, d):
    """IO8: a table of topic keywords, checked, without noise, the best of each topic."""
    kw = X.terms(X.pub(spark, d), "kw").groupBy("topic", F.col("term").alias("keyword")).agg(F.count(F.lit(1)).alias("score"))
    return io.read_topic_keywords(kw, 5)


@query("io_partitioned", "WITH " + X.PUB + " SELECT phase, uid, topic FROM pub WHERE phase = 2")
def _io9(spark, d):
    """IO9, IO10, IO14, IO16: a table written by phase; the reader opens one partition only."""
    at = place(spark)
    io.write_table(X.pub(spark, d).select("phase", "uid", "topic"), at, "phase")
    return spark.read.parquet(at).filter("phase = 2").select("phase", "uid", "topic")


@query("io_sentences", "WITH " + X.PUB + " SELECT uid AS doc, CAST(generate_subscripts(l, 1) - 1 AS INT) AS nr, unnest(l) AS sentence FROM (SELECT uid, string_split(title, ' ') AS l FROM pub WHERE title <> '')")
def _io11(spark, d):
    """IO11: JSON lines of a document's pieces."""
    at = place(spark)
    X.pub(spark, d).filter("title <> ''").select(F.col("uid").alias("doc"), F.split("title", " ").alias("pieces")).write.json(at)
    return io.read_sentences(spark, at, "pieces")


@query("io_ratings", "SELECT CAST(row_id AS INT) AS nr, CASE WHEN times_cited BETWEEN 1 AND 6 THEN CAST(times_cited AS INT) END AS rating, CASE WHEN times_cited IS NULL THEN 'empty' WHEN times_cited BETWEEN 1 AND 6 THEN 'valid' ELSE 'invalid' END AS state FROM publications")
def _io12(spark, d):
    """IO12: a rating sheet with semicolons, the number of citations standing for the rating."""
    at = place(spark)
    X.table(spark, d, "publications").select(F.col("row_id").alias("Nr"), F.lit("any text").alias("text"), F.col("times_cited").alias("Rating")).write.csv(at, header=True, sep=";")
    return io.read_ratings(spark, at)


@query("io_lexicon", "SELECT 'categories' AS kind, lower(category) AS phrase, CAST(len(string_split(category, ' ')) AS INT) AS words FROM category_list UNION ALL SELECT 'names', lower(given_name), CAST(len(string_split(given_name, ' ')) AS INT) FROM given_short")
def _io13(spark, d):
    """IO13: a lexicon of kinds and phrases in one JSON object."""
    at = place(spark)
    c = X.table(spark, d, "category_list").agg(F.collect_list("category").alias("categories"))
    n = X.table(spark, d, "given_short").agg(F.collect_list("given_name").alias("names"))
    c.join(n).coalesce(1).write.json(at)  # two tables of one row
    return io.read_lexicon(spark, at)


@query("io_report", "WITH " + X.PUB + " SELECT phase, topic, count(*) AS n FROM pub GROUP BY 1, 2")
def _io15(spark, d):
    """IO15: a report as JSON lines and back."""
    at = place(spark)
    io.write_report(X.pub(spark, d).groupBy("phase", "topic").agg(F.count(F.lit(1)).alias("n")), at)
    return spark.read.schema("phase int, topic int, n long").json(at)


@query("io_register", "SELECT 'publications' AS name, count(*) AS rows FROM publications UNION ALL SELECT 'documents', count(*) FROM documents")
def _io17(spark, d):
    """IO17, S27f: the register of a run with the digests of its inputs; a digest is the same whatever the order of the rows."""
    at = place(spark)
    for name in ("publications", "documents"):
        r = io.table_digest(X.table(spark, d, name)).first()
        io.append_log(spark, at, {"name": name, "rows": r.rows, "inputs": r.digest})
    log = spark.read.parquet(at)
    return log.select(F.regexp_extract("entry", r"name=(\w+)", 1).alias("name"), F.regexp_extract("entry", r"rows=(\d+)", 1).cast("long").alias("rows"))


@query("io_replicates", "WITH " + X.PUB + " SELECT 'phase_' || phase AS replicate, topic, count(*) AS n FROM pub GROUP BY 1, 2")
def _io18(spark, d):
    """IO18, U2: one file per replicate, read as one table with the file's name as key."""
    at = place(spark)
    n = X.pub(spark, d).groupBy("phase", "topic").agg(F.count(F.lit(1)).alias("n"))
    for r in (1, 2):
        n.filter(F.col("phase") == r).select("topic", "n").coalesce(1).write.csv(f"{at}/phase_{r}.csv", header=True)
    return io.read_replicates(spark, f"{at}/*.csv/part-*", "topic int, n long", folder=True)


@query("io_synthetic", "SELECT CAST(2000 AS BIGINT) AS rows, true AS unit, true AS rising, CAST(5 AS BIGINT) AS topics")
def _io19(spark, d):
    """IO19: the synthetic corpus: rows, unit vectors, more records in later years, topics."""
    c = io.synthetic_corpus(spark, 2000, 5)
    norm = F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    a = c.agg(F.count(F.lit(1)).alias("rows"), F.max(F.abs(norm - 1.0)).alias("off"), F.count_if(F.col("year") >= 2019).alias("late"), F.countDistinct("topic").alias("topics"))
    return a.select("rows", (F.col("off") < 1e-5).alias("unit"), (F.col("late") > 0.6 * F.col("rows")).alias("rising"), "topics")


@query("join_key_at_run_time", "WITH " + X.PUB + " SELECT p.uid, count(d.doc_id) AS documents FROM pub p LEFT JOIN documents d ON p.uid = d.uid GROUP BY 1")
def _j3(spark, d):
    """Publications joined with their documents by the first key that both tables have."""
    docs = X.table(spark, d, "documents").select("doc_id", "uid")
    j = V.join_first_key(X.pub(spark, d).select("uid", "doi", "title"), docs, ["doi", "uid", "title"])
    return j.groupBy("uid").agg(F.count("doc_id").alias("documents"))
