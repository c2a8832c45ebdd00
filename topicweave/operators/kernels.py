"""Grouped kernels on long tables ``(keys…, term, n)``; group columns are parameters, so replicates or variants are just keys.

Null instead of NaN everywhere. Every kernel is a composition of built-in aggregates and windows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def counts(long: DataFrame, keys: list[str], term: str) -> DataFrame:
    """(keys, term, n): the multiset of a long table."""
    return long.filter(F.col(term).isNotNull() & (F.col(term) != "")).groupBy(*keys, term).agg(F.count(F.lit(1)).alias("n"))


def gini(df: DataFrame, keys: list[str], value: str, out: str = "gini") -> DataFrame:
    """2·Σ i·x_i / (n·Σx) - (n+1)/n over ascending values; 0.5 for a zero sum. Equal values need no tie order."""
    # a rank by distinct value: rows of one value share their mean rank, so only distinct values are sorted
    v = df.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("double").alias("x")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(*keys).orderBy("x").rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn("i", F.coalesce(F.sum("k").over(w), F.lit(0)) + (F.col("k") + 1) / 2.0)
    a = v.groupBy(*keys).agg(F.sum("k").alias("n"), F.sum(F.col("x") * F.col("k")).alias("s"), F.sum(F.col("i") * F.col("x") * F.col("k")).alias("ix"))
    g = F.when(F.col("s") == 0, F.lit(0.5)).otherwise(2.0 * F.col("ix") / (F.col("n") * F.col("s")) - (F.col("n") + 1.0) / F.col("n"))
    return a.select(*keys, "n", g.alias(out))


def shares(c: DataFrame, keys: list[str], n: str = "n") -> DataFrame:
    total = c.groupBy(*keys).agg(F.sum(n).alias("total"))
    return c.join(total, keys).withColumn("p", F.col(n) / F.col("total"))


def hhi(c: DataFrame, keys: list[str], out: str = "hhi") -> DataFrame:
    """Σp² from sums alone: Σn² / (Σn)²."""
    a = c.groupBy(*keys).agg(F.sum("n").alias("total"), F.sum(F.col("n").cast("double") * F.col("n")).alias("sq"))
    return a.select(*keys, "total", (F.col("sq") / (F.col("total").cast("double") * F.col("total"))).alias(out))


def entropy(c: DataFrame, keys: list[str], out: str = "entropy") -> DataFrame:
    """(keys, total, kinds, out): Shannon entropy in bits, log2 N - Σ n·log2 n / N, in one aggregation."""
    a = c.groupBy(*keys).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"), F.sum(F.col("n") * F.log2("n")).alias("nl"))
    return a.select(*keys, "total", "kinds", (F.log2("total") - F.col("nl") / F.col("total")).alias(out))


def ruzicka(c: DataFrame, keys: list[str], side: str, a: str, b: str, term: str, out: str = "distance") -> DataFrame:
    """Weighted Jaccard distance 1 - Σmin/Σmax of the relative frequencies of two sides; null if a side is empty.

    Σmin + Σmax of two distributions is 2, so only Σmin is needed.
    """
    t = c.filter(F.col(side).isin(a, b)).groupBy(*keys, term).agg(F.sum(F.when(F.col(side) == a, F.col("n"))).alias("na"), F.sum(F.when(F.col(side) == b, F.col("n"))).alias("nb"))
    total = t.groupBy(*keys).agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"))
    m = t.filter("na IS NOT NULL AND nb IS NOT NULL").join(total, keys).groupBy(*keys).agg(F.sum(F.least(F.col("na") / F.col("ta"), F.col("nb") / F.col("tb"))).alias("m"))
    d = F.when(F.col("ta").isNull() | F.col("tb").isNull(), None).otherwise(1.0 - F.coalesce("m", F.lit(0.0)) / (2.0 - F.coalesce("m", F.lit(0.0))))
    return total.join(m, keys, "left").select(*keys, d.alias(out))


def jaccard(a: Column, b: Column, empty_value: float = 0.0) -> Column:
    """Set Jaccard of two arrays; two empty sets give ``empty_value``."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(empty_value)).otherwise(F.size(F.array_intersect(a, b)) / union)


def simpson(c: DataFrame, keys: list[str], doc: str, term: str, out: str = "lam") -> DataFrame:
    """Chance that a term of one record equals a term of another record of the group: (Σn_k² - Σx_dk²) / (N² - ΣL_d²)."""
    k = c.groupBy(*keys, term).agg(F.sum("n").alias("nk")).groupBy(*keys).agg(F.sum(F.col("nk") * F.col("nk")).alias("a"), F.sum("nk").alias("total"))
    x = c.groupBy(*keys).agg(F.sum(F.col("n") * F.col("n")).alias("b"))
    d = c.groupBy(*keys, doc).agg(F.sum("n").alias("ld")).groupBy(*keys).agg(F.sum(F.col("ld") * F.col("ld")).alias("l2"))
    t = k.join(x, keys).join(d, keys)
    den = F.col("total") * F.col("total") - F.col("l2")
    return t.select(*keys, F.when(den > 0, (F.col("a") - F.col("b")) / den).alias(out))


def pair_cosine(vectors: DataFrame, keys: list[str], vec: str, out: str = "cosine") -> DataFrame:
    """(keys, n, out): mean dot product over all pairs without pairs, (‖Σv‖² - Σ‖v‖²) / (n(n-1)); null for n < 2."""
    long = vectors.select(*keys, F.posexplode(vec).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    per = long.groupBy(*keys, "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("n"))
    a = per.groupBy(*keys).agg(F.sum(F.col("s") * F.col("s")).alias("s2"), F.sum("q").alias("q"), F.max("n").alias("n"))
    return a.select(*keys, "n", F.when(F.col("n") > 1, (F.col("s2") - F.col("q")) / (F.col("n") * (F.col("n") - 1.0))).alias(out))


def avg_rank(df: DataFrame, keys: list[str], value: str, out: str = "rank") -> DataFrame:
    """``df`` with the ascending rank of ``value`` within keys, ties averaged; null values get none.

    Ranks are computed on the distinct values of a group with their counts and joined back, so a value that a third of all
    rows have is one row of the window.
    """
    v = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_k"))
    w = Window.partitionBy(*keys or [F.lit(1)]).orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    v = v.withColumn(out, F.coalesce(F.sum("_k").over(w), F.lit(0)) + (F.col("_k") + 1) / 2.0).drop("_k")
    return df.join(v, [*keys, value], "left")


def zscore(value: str, keys: list[str]) -> Column:
    """Population z-score within a group; null if the group does not vary."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd)


def robust_z(value: str, keys: list[str], eps: float = 1e-9) -> Column:
    """(x - median) / max(IQR/2, eps) with exact interpolated quantiles."""
    w = Window.partitionBy(*keys)
    q = F.percentile(value, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).over(w)
    return (F.col(value) - q[1]) / F.greatest((q[2] - q[0]) / 2.0, F.lit(eps))


def pearson(x: str, y: str) -> Column:
    """Pearson correlation of two columns without nulls as an aggregate; null if one does not vary (the built-in one fails under ANSI)."""
    sx, sy = F.stddev_pop(x), F.stddev_pop(y)
    return F.when((sx > 1e-12) & (sy > 1e-12), F.covar_pop(x, y) / (sx * sy))


def spearman(df: DataFrame, keys: list[str], x: str, y: str, least: int = 3, out: str = "rho") -> DataFrame:
    """(keys, n, out): Spearman correlation over rows with both values; null below ``least`` rows or without variation."""
    d = df.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    d = avg_rank(avg_rank(d, keys, x, "_rx"), keys, y, "_ry")
    a = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), pearson("_rx", "_ry").alias("r"))
    return a.select(*keys, "n", F.when(F.col("n") >= least, F.col("r")).alias(out))


def dominant(scores: dict[str, str]) -> Column:
    """The name of the largest of several columns; a tie goes to the first."""
    top = F.greatest(*scores.values())
    return reduce(lambda acc, kv: F.when(F.col(kv[1]) >= top, F.lit(kv[0])).otherwise(acc), reversed(list(scores.items())), F.lit(None).cast("string"))


def unpivot(df: DataFrame, keys: list[str], columns: list[str], name: str = "name", value: str = "value") -> DataFrame:
    return df.unpivot(keys, columns, name, value)
