"""Queries for how the classes of topics hold when the corpus is cut otherwise: boundaries of the phases, labelings, fields.

A variant is a phase number of its own, variant * 10 + phase: every operator groups by phase, so all variants are one plan.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from topicweave.operators import indicators as I
from topicweave.operators import kernels as K
from topicweave.operators import resample as S
from topicweave.operators.graph import reliable
from topicweave.plans import fixtures as X
from topicweave.plans.indicator_queries import W, Parts, entropy_sql, query, rounded

SPLITS, BASE = [2012, 2013, 2014, 2015, 2016, 2017, 2018], 2015


def _classes(spark, d, pub):
    p = Parts(spark, d, kept=True, pub=pub)
    return reliable(I.memberships(I.dimension_scores(I.all_indicators([p.make(n) for n in I.INDICATORS]))))


@query("grid_phase_boundary")
def _m21(spark, d):
    """Memberships for seven years at which the phases may part, against those of the base year: rank correlations, the smallest
    of them, and changed classes by boundary and phase. The base year is the control and gives 1."""
    p = X.pub(spark, d).filter("year IS NOT NULL").withColumn("split", F.explode(F.array(*[F.lit(s) for s in SPLITS])))
    p = p.withColumn("phase", (F.col("split") * 10 + F.when(F.col("year") <= F.col("split"), 1).otherwise(2)).cast("int")).drop("split")
    m = _classes(spark, d, p).withColumn("split", F.floor(F.col("phase") / 10).cast("int")).withColumn("phase", (F.col("phase") % 10).cast("int"))
    out = S.compare(m, m.filter(F.col("split") == BASE).drop("split"), ["split", "phase"])
    return rounded(out.withColumn("rho_min", F.least(*[f"rho_{c}" for c in S.MEMBERSHIPS])))


@query("grid_topic_parameters")
def _m11(spark, d):
    """Topics of the macro, meso and micro labels, each with five smallest sizes below which a topic is noise: topics, share of noise,
    shares of the classes and mean margin of the fifteen cells. The labels are given; they stand for a clustering anew."""
    number = lambda c: F.coalesce(F.nullif(F.regexp_extract(c, r"^([0-9.]+) ", 1), F.lit("")), F.lit("-1"))
    labels = F.explode(F.array(*[F.struct(F.lit(i).alias("level"), number(c).alias("label")) for i, c in enumerate(LEVELS)]))
    p = X.pub(spark, d).withColumn("_c", labels).select("uid", "row_id", "phase", "year", "doc_type", "source_title", "times_cited", *[c for c, _, _ in X.LISTS.values()], F.length("abstract").alias("size"), "_c.*")
    sizes = p.filter("label <> '-1'").groupBy("level", "phase", "label").agg(F.count(F.lit(1)).alias("n"))
    p = p.join(sizes, ["level", "phase", "label"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    topic = F.when(F.col("n") >= LEAST[0], F.pmod(F.xxhash64("label"), F.lit(2**31 - 1)).cast("int")).otherwise(-1)
    p = reliable(p.select(*[c for c in p.columns if c not in ("phase", "level", "label")], topic.alias("topic"), (F.col("level") * 10 + F.col("phase")).cast("int").alias("phase"), F.col("phase").alias("of"), F.col("level").alias("labels")))
    cells = F.posexplode(F.array(*[F.lit(x) for x in LEAST])).alias("cell", "least")
    about = p.groupBy("phase", F.col("labels").alias("level"), "of", "n").agg(F.count(F.lit(1)).alias("records")).select("*", cells)
    about = about.groupBy("phase", "level", "of", "cell", "least").agg((F.sum(F.when(F.col("n") < F.col("least"), F.col("records")).otherwise(0)) / F.sum("records")).alias("noise"))
    own, new = reliable(_of_cells(spark, d, p)), (F.col("phase") * 10 + F.col("cell"))
    m = I.memberships(I.dimension_scores(own))
    share = lambda c: F.avg((F.col("dominant") == c).cast("double")).alias(c)
    a = m.groupBy("phase").agg(F.count(F.lit(1)).alias("topics"), *[share(c) for c in ("ws", "trend", "ec", "latent")], F.avg("margin").alias("margin"))
    level = F.element_at(F.array(*[F.lit(c) for c in LEVELS]), F.col("level") + 1)
    about = about.select(new.alias("phase"), F.col("of"), level.alias("level"), "least", "noise")
    return rounded(about.join(a, "phase", "left").drop("phase").withColumnRenamed("of", "phase"))


LEVELS, LEAST = ("ct_macro", "ct_meso", "ct_micro"), (4, 8, 12, 16, 25)


def _of_cells(spark, d, p):
    """The indicators of the cells, a phase (phase of ``p`` * 10 + cell) for each smallest size; ``p`` has the topics of the least one.

    A topic's records are the same in each cell that has it, so its own indicators, its centroid and what is nearest to it are computed
    once. What the other topics of a cell decide comes from counts: shares by year, the share of reviews, which records are noise.
    """
    sizes = I.topics(p).groupBy(*I.KEYS).agg(F.max("n").alias("records"))
    cells = F.posexplode(F.array(*[F.lit(x) for x in LEAST])).alias("cell", "least")
    kept = reliable(sizes.select(*I.KEYS, "records", cells).filter("records >= least").select(*I.KEYS, "cell"))
    spread = lambda t: t.join(kept, I.KEYS).select((F.col("phase") * 10 + F.col("cell")).alias("phase"), *[c for c in t.columns if c != "phase"])
    years = I.topics(p).filter("year IS NOT NULL").groupBy(*I.KEYS, "year").agg(F.count(F.lit(1)).alias("n"))
    tem = reliable(I.tem_metrics(I.shares_of_years(spread(years))))
    # in so many of the cells a record is noise: the first of them have the smaller sizes
    level = sum((F.col("n") < x).cast("int") for x in LEAST)
    near = I.nearest_levels(X.vectors(spark, d, p.withColumn("level", level), ("level",)), lambda n, corpus: F.least(2 * n, corpus))
    near = near.join(kept, I.KEYS).groupBy((F.col("phase") * 10 + F.col("cell")).alias("phase"), "topic", F.col("n").alias("of"))
    noise = near.agg((F.sum(F.when(F.col("level") >= len(LEAST) - F.col("cell"), F.col("near")).otherwise(0)) / F.sum("near")).alias("noise"))
    noise = noise.select(*I.KEYS, F.when(F.col("of") < 3, F.lit(0.5)).otherwise(F.col("noise")).alias("pe2"))
    of = {"pe1": lambda: I.relative_proportion(tem), "pe2": lambda: noise, "ds3": lambda: I.absence_of_reviews(spread(I.review_counts(p))), "ip1": lambda: I.growth_rate(tem)}
    parts = Parts(spark, d, pub=p)
    return I.all_indicators([of[n]() if n in of else spread(parts.make(n)) for n in I.INDICATORS])


_RANK = lambda x: f"rank() OVER (PARTITION BY indicator, phase ORDER BY {x}) + (count(*) OVER (PARTITION BY indicator, phase, {x}) - 1) / 2.0"


@query("grid_field_alternatives", W(*entropy_sql("eo2", "cat", 2, 0.0), *entropy_sql("eo2b", "kwp", 2, 0.0)[1:], entropy_sql("ip3", "kwp", 5, 0.5)[-1], *entropy_sql("ip3b", "kw", 5, 0.5)[1:],
         "fa AS (SELECT 'eo2' AS indicator, phase, topic, round(eo2, 9) AS x, round(eo2b, 9) AS y FROM eo2 JOIN eo2b USING (phase, topic) UNION ALL SELECT 'ip3', phase, topic, round(ip3, 9), round(ip3b, 9) FROM ip3 JOIN ip3b USING (phase, topic))", f"fr AS (SELECT indicator, phase, {_RANK('x')} AS rx, {_RANK('y')} AS ry FROM fa)")
       + "SELECT indicator, phase, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN corr(rx, ry) END, 6) AS rho FROM fr GROUP BY 1, 2")
def _m13(spark, d):
    """Rank correlation over topics of an indicator from its field and from another one: disciplinary entropy from categories and
    from keywords of the index, field breadth from these and from author keywords."""
    p = X.pub(spark, d)
    of = lambda kind, out, least, below: I.normalised_entropy(X.terms(p, kind), p, out, least, below)
    both = lambda name, a, b, least, below: of(a, "x", least, below).join(of(b, "y", least, below), I.KEYS).withColumn("indicator", F.lit(name))
    j = both("eo2", "cat", "kwp", 2, 0.0).unionByName(both("ip3", "kwp", "kw", 5, 0.5)).withColumns({"x": F.round("x", 9), "y": F.round("y", 9)})
    return rounded(K.spearman(j, ["indicator", "phase"], "x", "y", 5))
