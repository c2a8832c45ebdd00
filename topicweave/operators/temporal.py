"""Operators on yearly series in long form."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicweave.operators.indicators import KEYS


def proportions_with_noise(pub: DataFrame) -> DataFrame:
    """B2: (phase, topic, year, share) with noise in the denominator, dense over each phase's years; noise is dropped after."""
    c = pub.filter("year IS NOT NULL").groupBy(*KEYS, "year").agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy("phase", "year").agg(F.sum("n").alias("total"))
    spine = c.filter("topic >= 0").select(*KEYS).distinct().join(total, "phase")
    return spine.join(c, [*KEYS, "year"], "left").select(*KEYS, "year", (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def linear_growth(shares: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """Slope of the share on the year over the mean share; 0 where that is undefined."""
    a = shares.groupBy(*keys).agg(F.regr_slope("share", "year").alias("b"), F.avg("share").alias("m"), F.count(F.lit(1)).alias("n"), F.max("share").alias("top"))
    return a.select(*keys, F.col("n").alias("years"), "m", "top", F.when((F.col("n") > 1) & (F.col("m") > 0), F.coalesce(F.col("b") / F.col("m"), F.lit(0.0))).otherwise(0.0).alias("ols_growth"))


def half_split_growth(shares: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """(median of the second half - median of the first) / median of the first, the middle year of an odd number left out."""
    w = Window.partitionBy(*keys)
    s = shares.withColumn("i", F.row_number().over(w.orderBy("year"))).withColumn("n", F.count(F.lit(1)).over(w))
    h = F.floor(F.col("n") / 2)
    a = s.groupBy(*keys, "n").agg(F.percentile(F.when(F.col("i") <= h, F.col("share")), 0.5).alias("a"), F.percentile(F.when(F.col("i") > F.col("n") - h, F.col("share")), 0.5).alias("b"))
    return a.select(*keys, F.when((F.col("n") >= 4) & (F.col("a") > 0), (F.col("b") - F.col("a")) / F.col("a")).otherwise(0.0).alias("half_growth"))


def partial_years(yearly: DataFrame, keys: list[str], threshold: float = 0.6) -> DataFrame:
    """Of the last four years (from the fourth on) those below ``threshold`` of the median of the three years before."""
    w = Window.partitionBy(*keys).orderBy("year")
    y = yearly.withColumn("i", F.row_number().over(w)).withColumn("before", F.percentile("n", 0.5).over(w.rowsBetween(-3, -1))).withColumn("years", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    return y.filter((F.col("i") > 3) & (F.col("i") > F.col("years") - 4) & (F.col("n") < threshold * F.col("before"))).select(*keys, "year", "n", "before")


def phase_splits(pub: DataFrame, splits: list[int]) -> DataFrame:
    """Records up to and after each alternative split year; one aggregation, a row per split."""
    parts = [F.count_if(F.col("year") <= s).alias(f"a{s}") for s in splits] + [F.count_if(F.col("year") > s).alias(f"b{s}") for s in splits]
    one = pub.filter("year IS NOT NULL").agg(*parts)
    return one.select(F.inline(F.array(*[F.struct(F.lit(s).alias("split_year"), F.col(f"a{s}").alias("until"), F.col(f"b{s}").alias("after")) for s in splits])))
