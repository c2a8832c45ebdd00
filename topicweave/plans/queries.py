"""The core queries by name: (spark, folder of the tables) -> DataFrame."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.operators import split_values as sv
from topicweave.plans import candidate_queries, indicator_queries, io_queries, prepare_queries, resample_queries, stability_queries, validation_queries  # noqa: F401 (they fill the tables of queries)


def _table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Problem 3: every value of the four packed fields with its position.

    Dictionaries: the category list; author keywords and affiliations that hold a delimiter (others need no protection).
    """
    pubs = _table(spark, d, "publications")
    keywords = pubs.select(F.explode(F.split("author_keywords", r"\|")).alias("v"))
    organisations = _table(spark, d, "author_orcid").select(F.col("affiliation").alias("v"))
    specs = [
        sv.with_known(sv.CATEGORIES, _table(spark, d, "category_list").select("category")),
        sv.with_known(sv.KEYWORDS, sv.with_delimiters(keywords, sv.KEYWORDS)),
        sv.with_known(sv.ORGANISATIONS, sv.with_delimiters(organisations, sv.ORGANISATIONS)),
        sv.NAMES,
    ]
    return sv.explode_packed(pubs, "row_id", specs)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"p3_found": p3_found} | indicator_queries.Q


def oracle_sql() -> dict[str, str]:
    return dict(indicator_queries.SQL)
