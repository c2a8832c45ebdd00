"""Topic matching within and across phases or labelings."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicweave.operators import kernels as K


def centroids(vectors: DataFrame, keys: list[str]) -> DataFrame:
    """S23f: (keys, centroid, n): mean vector, summed by dimension so that no group is gathered in one task."""
    per = vectors.select(*keys, F.posexplode("embedding").alias("dim", "x")).groupBy(*keys, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    return per.groupBy(*keys).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("n"))


def cosine(a, b):
    """S22f: cosine of two arrays; 0 if one is a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p * q), F.lit(0.0), lambda s, t: s + t)
    norm = F.sqrt(dot(a, a) * dot(b, b))
    return F.when(norm > 0, dot(a, b) / norm).otherwise(0.0)


#: Topics of the second phase meet those of the first in so many blocks, a task each.
BLOCKS = 64


def pair_scores(vectors: DataFrame, keywords: DataFrame) -> DataFrame:
    """(topic1, topic2, cosine, jaccard) of all topic pairs of two phases; ``keywords`` has (phase, topic, terms).

    One row per topic on either side, so the pairing is of topics, never of records. Topics of the second phase are spread over
    blocks by hash and each topic of the first visits all of them, so the pairs are spread too.
    """
    t = centroids(vectors.filter("topic >= 0"), ["phase", "topic"]).join(keywords, ["phase", "topic"], "left")
    none = F.array().cast("array<string>")
    a = t.filter("phase = 1").select(F.col("topic").alias("topic1"), F.col("centroid").alias("c1"), F.coalesce("terms", none).alias("k1"), F.explode(F.sequence(F.lit(0), F.lit(BLOCKS - 1))).alias("block"))
    b = t.filter("phase = 2").select(F.col("topic").alias("topic2"), F.col("centroid").alias("c2"), F.coalesce("terms", none).alias("k2"), F.pmod(F.xxhash64("topic"), F.lit(BLOCKS)).cast("int").alias("block"))
    return a.join(b, "block").select("topic1", "topic2", cosine(F.col("c1"), F.col("c2")).alias("cosine"), K.jaccard(F.col("k1"), F.col("k2")).alias("jaccard"))


def best_matches(scores: DataFrame, alpha: float = 0.6) -> DataFrame:
    """Hybrid score, ranks both ways (ties by topic) and whether the pair is best for both sides."""
    s = scores.withColumn("hybrid", F.round(alpha * F.col("cosine") + (1.0 - alpha) * F.col("jaccard"), 9))
    s = s.withColumn("rank12", F.row_number().over(Window.partitionBy("topic1").orderBy(F.desc("hybrid"), "topic2")))
    s = s.withColumn("rank21", F.row_number().over(Window.partitionBy("topic2").orderBy(F.desc("hybrid"), "topic1")))
    return s.withColumn("mutual_best", (F.col("rank12") == 1) & (F.col("rank21") == 1))


def overlap_matches(labels: DataFrame, doc: str, old: str, new: str, least: float = 0.05) -> DataFrame:
    """For each new label the old one with the largest Jaccard of members, at least ``least``; ties to the lower one.

    Intersections are counted by an aggregation over the records, not by pairing sets.
    """
    both = labels.groupBy(old, new).agg(F.count(F.lit(1)).alias("c"))
    a = labels.groupBy(old).agg(F.count(F.lit(1)).alias("na"))
    b = labels.groupBy(new).agg(F.count(F.lit(1)).alias("nb"))
    j = both.filter((F.col(old) >= 0) & (F.col(new) >= 0)).join(a, old).join(b, new).withColumn("jaccard", F.col("c") / (F.col("na") + F.col("nb") - F.col("c")))
    w = Window.partitionBy(new).orderBy(F.desc("jaccard"), old)
    return j.withColumn("k", F.row_number().over(w)).filter((F.col("k") == 1) & (F.col("jaccard") >= least)).select(new, old, "jaccard")


def overlap_report(labels: DataFrame, old: str, new: str) -> DataFrame:
    """(new, members, noise, kinds, best_share): members of each new label, those that were noise, the old labels met, and the
    share of the best one, null if there is none."""
    c = labels.filter(F.col(new) >= 0).groupBy(old, new).agg(F.count(F.lit(1)).alias("c"))
    known = F.col(old) >= 0
    a = c.groupBy(new).agg(F.sum("c").alias("members"), F.coalesce(F.sum(F.when(F.col(old) == -1, F.col("c"))), F.lit(0)).alias("noise"), F.count_if(known).alias("kinds"), F.max(F.when(known, F.col("c"))).alias("most"))
    return a.select(new, "members", "noise", "kinds", (F.col("most") / F.col("members")).alias("best_share"))


def close_matches(labels: DataFrame, old: str, new: str, least: float = 0.75) -> DataFrame:
    """(new, old, jaccard, unique_match): pairs of labels with a Jaccard of at least ``least``, and whether neither is in another."""
    both = labels.groupBy(old, new).agg(F.count(F.lit(1)).alias("c"))
    a, b = labels.groupBy(old).agg(F.count(F.lit(1)).alias("na")), labels.groupBy(new).agg(F.count(F.lit(1)).alias("nb"))
    j = both.filter((F.col(old) >= 0) & (F.col(new) >= 0)).join(a, old).join(b, new).withColumn("jaccard", F.col("c") / (F.col("na") + F.col("nb") - F.col("c")))
    j = j.filter(F.col("jaccard") >= least).select(new, old, "jaccard")
    one = lambda c: F.count(F.lit(1)).over(Window.partitionBy(c)) == 1
    return j.withColumn("unique_match", one(new) & one(old))


def clusterwise_stability(runs: DataFrame, doc: str, old: str, new: str, run: str) -> DataFrame:
    """Per old label the best Jaccard of each run, averaged over runs."""
    both = runs.groupBy(run, old, new).agg(F.count(F.lit(1)).alias("c"))
    a, b = both.groupBy(run, old).agg(F.sum("c").alias("na")), both.groupBy(run, new).agg(F.sum("c").alias("nb"))
    j = both.join(a, [run, old]).join(b, [run, new]).withColumn("jaccard", F.col("c") / (F.col("na") + F.col("nb") - F.col("c")))
    return j.groupBy(run, old).agg(F.max("jaccard").alias("best")).groupBy(old).agg(F.avg("best").alias("stability"))


def label_agreement(labels: DataFrame, a: str, b: str) -> DataFrame:
    """Adjusted Rand index, homogeneity, completeness and V-measure of two labelings, from their contingency counts."""
    c = labels.groupBy(a, b).agg(F.count(F.lit(1)).alias("n"))
    pairs = lambda n: n * (n - 1.0) / 2.0
    nl = lambda n: n * F.log(n)
    cell = c.agg(F.sum(pairs(F.col("n"))).alias("ij"), F.sum(nl(F.col("n"))).alias("hij"), F.sum("n").alias("total"))
    ra = c.groupBy(a).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("i"), F.sum(nl(F.col("n"))).alias("hi"))
    rb = c.groupBy(b).agg(F.sum("n").alias("n")).agg(F.sum(pairs(F.col("n"))).alias("j"), F.sum(nl(F.col("n"))).alias("hj"))
    t = cell.join(ra).join(rb)  # three tables of one row
    expected = F.col("i") * F.col("j") / pairs(F.col("total"))
    n = F.col("total")
    ha, hb = F.log(n) - F.col("hi") / n, F.log(n) - F.col("hj") / n
    hab, hba = (F.col("hj") - F.col("hij")) / n, (F.col("hi") - F.col("hij")) / n
    t = t.select(((F.col("ij") - expected) / ((F.col("i") + F.col("j")) / 2.0 - expected)).alias("ari"), F.when(ha > 0, 1.0 - hab / ha).otherwise(1.0).alias("homogeneity"), F.when(hb > 0, 1.0 - hba / hb).otherwise(1.0).alias("completeness"))
    return t.withColumn("v_measure", 2.0 * F.col("homogeneity") * F.col("completeness") / (F.col("homogeneity") + F.col("completeness")))
