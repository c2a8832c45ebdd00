"""Readers and sinks with declared schemas (IO1-IO18)."""

from __future__ import annotations

from collections.abc import Iterable
from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The canonical publication record (IO2, §1.3); list fields are packed strings here, arrays after ``topicweave.plans.prepare``.
PUBLICATION = T.StructType(
    [T.StructField(c, T.StringType()) for c in ("uid", "title", "abstract")] + [T.StructField("year", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("doc_type", "source_title", "author_keywords", "keywords_plus", "wos_categories")]
    + [T.StructField("times_cited", T.LongType()), T.StructField("rtw", T.DoubleType()), T.StructField("ctw", T.DoubleType())]
    + [T.StructField(c, T.StringType()) for c in ("doi", "affiliations", "addresses", "country_list")] + [T.StructField("country_count", T.IntegerType())]
    + [T.StructField(c, T.StringType()) for c in ("ct_macro", "ct_meso", "ct_micro", "author_full_names", "orcids", "cited_references")]
)


def trimmed(c: Column) -> Column:
    """IO1: trimmed; '' for 'nan', 'None' and ''; null stays null."""
    t = F.trim(c)
    return F.when(t.isin("nan", "None"), "").otherwise(t)


def read_delivery(spark: SparkSession, path: str, columns: Iterable[str]) -> DataFrame:
    """IO1: a delivered CSV file, all strings, names and values trimmed, nameless index columns dropped. Column order is the header's."""
    raw = spark.read.csv(path, header=True, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True, multiLine=True, escape='"')
    names = {c: c.strip() for c in raw.columns}
    have = [c for c, n in names.items() if not n.startswith(("Unnamed", "_c"))]
    out = raw.select(*[trimmed(F.col(f"`{c}`")).alias(names[c]) for c in have])
    return with_columns(out, columns)


def with_columns(df: DataFrame, columns: Iterable[str], kind: str = "string") -> DataFrame:
    """IO4: exactly these columns; absent ones are null."""
    return df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast(kind).alias(c) for c in columns])


def rename_present(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename the columns that are there."""
    return df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})


def add_aliases(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """A second name beside a column, where the source is there and the target is not."""
    return df.withColumns({b: F.col(a) for a, b in names.items() if a in df.columns and b not in df.columns})


def read_edges(spark: SparkSession, path: str, source: str = "UID", target: str = "UID_ref") -> DataFrame:
    """IO6, IO7: an edge list of quoted ids, both trimmed; edges without a target are dropped, repeated ones kept once."""
    clean = lambda c: F.trim(F.regexp_replace(F.col(c), '^"+|"+$', ""))
    e = spark.read.csv(path, header=True).select(clean(source).alias("uid"), clean(target).alias("uid_ref"))
    return e.filter("uid <> '' AND uid_ref <> ''").distinct()


def read_topic_keywords(df: DataFrame, k: int) -> DataFrame:
    """IO8: (topic, keyword, score): without noise and nulls, the k best of each topic; missing columns are an error."""
    from topicweave.operators.validation import top_k

    missing = {"topic", "keyword", "score"} - set(df.columns)
    if missing:
        raise ValueError(f"columns missing: {sorted(missing)}")
    return top_k(df.filter("topic >= 0 AND keyword IS NOT NULL"), ["topic"], "score", ["keyword"], k)


def read_sentences(spark: SparkSession, path: str, key: str = "sentences") -> DataFrame:
    """IO11: JSON lines {doc, <key>: [sentences]} as (doc, nr, sentence), ``nr`` from 0; a document given twice is an error."""
    raw = spark.read.schema(f"doc string, `{key}` array<string>").json(path)
    if raw.filter("doc IS NOT NULL").groupBy("doc").count().filter("count > 1").limit(1).count():
        raise ValueError("a document is given twice")
    return raw.select("doc", F.posexplode(key).alias("nr", "sentence"))


def read_ratings(spark: SparkSession, path: str, number: str = "nr", rating: str = "rating", encoding: str = "UTF-8") -> DataFrame:
    """IO12: (nr, rating, state): a rating sheet whose delimiter its header tells. ``state`` is 'valid' for whole ratings from 1 to 6,
    'empty', or 'invalid', and ``rating`` null unless valid; decimal commas are read, blank lines are not rows."""
    head = spark.read.option("encoding", encoding).text(path).first()[0].lstrip("\ufeff")
    sep = ";" if head.count(";") >= 2 else "\t" if head.count("\t") >= 2 else ","
    raw = spark.read.csv(path, header=True, sep=sep, encoding=encoding, ignoreLeadingWhiteSpace=True, ignoreTrailingWhiteSpace=True)
    names = {c.lstrip("\ufeff").strip().lower(): c for c in raw.columns}
    if not {number, rating} <= set(names):
        raise ValueError(f"columns {number} and {rating} are needed, the sheet has {sorted(names)}")
    as_number = lambda c: F.replace(F.trim(F.col(f"`{names[c]}`")), F.lit(","), F.lit(".")).try_cast("double")
    value, text = as_number(rating), F.coalesce(F.trim(F.col(f"`{names[rating]}`")), F.lit(""))
    fits = F.coalesce(value.between(1, 6) & (value == F.floor(value)), F.lit(False))
    state = F.when(text == "", "empty").when(fits, "valid").otherwise("invalid")
    out = raw.filter(F.length(F.trim(F.concat_ws("", *[F.col(f"`{c}`") for c in raw.columns]))) > 0)
    return out.select(as_number(number).cast("int").alias("nr"), F.when(fits, value.cast("int")).alias("rating"), state.alias("state"))


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    """IO13: (kind, phrase, words) of a JSON object {kind: [phrases]}."""
    raw = spark.read.option("multiLine", True).json(path)
    kinds = [raw.select(F.lit(c).alias("kind"), F.explode(c).alias("phrase")) for c in raw.columns]
    out = kinds[0]
    for k in kinds[1:]:
        out = out.unionByName(k)
    return out.withColumn("phrase", F.lower("phrase")).withColumn("words", F.size(F.split("phrase", " ")))


def read_replicates(spark: SparkSession, pattern: str, schema: str, folder: bool = False) -> DataFrame:
    """IO18, U2: files of replicates as one table with the file's stem, or that of its folder, as ``replicate``."""
    name = F.element_at(F.split(F.input_file_name(), "/"), -2 if folder else -1)
    return spark.read.schema(schema).csv(pattern, header=True).withColumn("replicate", F.regexp_replace(name, r"\.[^.]*$", ""))


def write_table(df: DataFrame, path: str, partition: str | None = None, mode: str = "overwrite") -> None:
    """IO9, IO10, IO14, IO16: Parquet, optionally partitioned; the committer makes it appear whole."""
    w = df.write.mode(mode)
    (w.partitionBy(partition) if partition else w).parquet(str(PurePosixPath(path)))


def write_report(df: DataFrame, path: str) -> None:
    """IO15: one JSON object a line."""
    df.write.mode("overwrite").json(path)


def append_log(spark: SparkSession, path: str, entry: dict) -> None:
    """IO17, S27f: one row of the run register, with a digest of its content.

    ``inputs`` in an entry may hold the digest of a table (``table_digest``)."""
    text = "|".join(f"{k}={entry[k]}" for k in sorted(entry))
    row = spark.range(1).select(F.current_timestamp().alias("at"), F.lit(text).alias("entry"), F.sha2(F.lit(text), 256).alias("digest"))
    row.write.mode("append").parquet(path)


def table_digest(df: DataFrame) -> DataFrame:
    """S27f: (rows, digest): a digest of a table that no order of its rows or files changes."""
    row = F.sha2(F.concat_ws("\u0001", *[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("\u0002")) for c in sorted(df.columns)]), 256)
    parts = [F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)")) for i in range(8)]
    return df.agg(F.count(F.lit(1)).alias("rows"), F.sha2(F.concat_ws(",", *[p.cast("string") for p in parts]), 256).alias("digest"))


def synthetic_corpus(spark: SparkSession, n: int, topics: int, dims: int = 16, seed: int = 42) -> DataFrame:
    """IO19: (id, topic, year, embedding): years with linearly rising weights, unit vectors around a centre per topic."""
    from topicweave.operators.resample import normal, uniform

    base = spark.range(n).withColumn("topic", F.pmod(F.xxhash64(F.lit(seed), "id"), F.lit(topics)).cast("int"))
    year = (2014 + F.floor(10 * F.sqrt(uniform(F.lit(seed), F.lit("y"), "id")))).cast("int")
    v = F.transform(F.sequence(F.lit(1), F.lit(dims)), lambda i: normal(F.lit(seed), "topic", i) + 0.3 * normal(F.lit(seed), "id", i))
    base = base.withColumn("year", year).withColumn("v", v)
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return base.select("id", "topic", "year", F.transform("v", lambda x: (x / norm).cast("float")).alias("embedding"))
