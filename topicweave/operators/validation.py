"""Reference overlap, citation profiles, external validation, term weights, coherence and transitions."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicweave.operators import kernels as K


#: A reference that so many different sets of a group hold is paired by counts.
HOT_REFERENCE = 1000


def reference_overlap(edges: DataFrame, docs: DataFrame, keys: list[str], hot: int = HOT_REFERENCE) -> DataFrame:
    """(keys, n_refs, overlap): mean Jaccard of the reference sets of all pairs of records with references.

    Exact over all pairs without forming those that share nothing: pairs come from an equi-join on the shared reference, pairs
    without one count 0 in the denominator, and records with the same set are joined once, weighted by their number. References of
    at least ``hot`` sets of a group are not joined: of two sets that share hot references only, the Jaccard depends on
    the hot ones they hold and on their sizes, so such pairs are products of counts by (hot references, size); pairs
    that also share another reference come from the join, where the part counted before is taken off.
    """
    sets = edges.filter("uid_ref IS NOT NULL").select("uid", "uid_ref").distinct().groupBy("uid").agg(F.sort_array(F.collect_list("uid_ref")).alias("refs"))
    kinds = sets.join(docs, "uid").groupBy(*keys, "refs").agg(F.count(F.lit(1)).alias("m")).withColumn("id", F.xxhash64("refs")).withColumn("size", F.size("refs"))
    total = kinds.groupBy(*keys).agg(F.sum("m").alias("n"), F.sum(F.col("m") * (F.col("m") - 1) / 2.0).alias("same"))
    post = kinds.select(*keys, "id", "size", "m", F.explode("refs").alias("ref"))
    of_many = post.groupBy(*keys, "ref").agg(F.count(F.lit(1)).alias("k")).filter(F.col("k") >= hot).select(*keys, "ref", F.lit(True).alias("is_hot"))
    post = post.join(of_many, [*keys, "ref"], "left")
    held = post.filter("is_hot").groupBy(*keys, "id", "size", "m").agg(F.sort_array(F.collect_list("ref")).alias("hot"))
    none = F.array().cast("array<string>")
    cold = post.filter("is_hot IS NULL").join(held.select(*keys, "id", "hot"), [*keys, "id"], "left").withColumn("hot", F.coalesce("hot", none))
    a = cold.select(*keys, "ref", *[F.col(c).alias(f"{c}_a") for c in ("id", "size", "m", "hot")])
    b = cold.select(*keys, "ref", *[F.col(c).alias(f"{c}_b") for c in ("id", "size", "m", "hot")])
    pairs = a.join(b, [*keys, "ref"]).filter("id_a < id_b").groupBy(*keys, "id_a", "id_b", "size_a", "size_b", "m_a", "m_b", "hot_a", "hot_b").agg(F.count(F.lit(1)).alias("cold"))
    jaccard = lambda c, x, y: c / (x + y - c)
    both = F.size(F.array_intersect("hot_a", "hot_b"))
    gain = jaccard(F.col("cold") + both, F.col("size_a"), F.col("size_b")) - jaccard(both, F.col("size_a"), F.col("size_b"))
    s = pairs.groupBy(*keys).agg(F.sum(F.col("m_a") * F.col("m_b") * gain).alias("s"))
    g = held.groupBy(*keys, "hot", "size").agg(F.sum("m").cast("double").alias("m"), F.sum(F.col("m") * F.col("m")).cast("double").alias("sq")).withColumn("id", F.xxhash64("hot", "size"))
    within = g.groupBy(*keys).agg(F.sum((F.col("m") * F.col("m") - F.col("sq")) / 2.0 * jaccard(F.size("hot"), F.col("size"), F.col("size"))).alias("s"))
    x = g.select(*keys, F.explode("hot").alias("ref"), *[F.col(c).alias(f"{c}_a") for c in ("id", "size", "m", "hot")])
    y = g.select(*keys, F.explode("hot").alias("ref"), *[F.col(c).alias(f"{c}_b") for c in ("id", "size", "m", "hot")])
    met = x.join(y, [*keys, "ref"]).filter("id_a < id_b").filter(F.array_intersect("hot_a", "hot_b")[0] == F.col("ref"))  # each pair of groups once
    across = met.groupBy(*keys).agg(F.sum(F.col("m_a") * F.col("m_b") * jaccard(both, F.col("size_a"), F.col("size_b"))).alias("s"))
    s = s.unionByName(within).unionByName(across).groupBy(*keys).agg(F.sum("s").alias("s"))
    v = F.when(F.col("n") < 2, F.lit(0.0)).otherwise((F.col("same") + F.coalesce("s", F.lit(0.0))) / (F.col("n") * (F.col("n") - 1) / 2.0))
    return total.join(s, keys, "left").select(*keys, F.col("n").alias("n_refs"), v.alias("overlap"))


def level_profile(labels: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, dominant, modal_share, kinds, covered): mode by count then label, of the non-missing values."""
    c = labels.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"))
    a = c.groupBy(*keys).agg(F.sum("n").alias("covered"), F.count(F.lit(1)).alias("kinds"), F.min(F.struct((-F.col("n")).alias("k"), F.col(value).alias("v"))).alias("top"))
    return a.select(*keys, F.col("top.v").alias("dominant"), (-F.col("top.k") / F.col("covered")).alias("modal_share"), "kinds", "covered")


def correlation_verdict(rho: Column, expected: Column, convergent_min: float = 0.3, discriminant_max: float = 0.3) -> Column:
    """P12."""
    conv = F.when(rho >= convergent_min, "OK").otherwise("FAIL_CONVERGENT")
    disc = F.when(F.abs(rho) <= discriminant_max, "OK").otherwise("FAIL_DISCRIMINANT")
    return F.when(rho.isNull(), "NA").when(expected == "convergent", conv).when(expected == "discriminant", disc).otherwise("INFO")


def external_correlations(ind: DataFrame, external: DataFrame, indicators: list[str], criteria: list[str]) -> DataFrame:
    """Spearman of every criterion with every indicator over topics; null below 5 topics."""
    j = ind.join(external, ["phase", "topic"])
    long = K.unpivot(K.unpivot(j.select("phase", "topic", *indicators, *criteria), ["phase", "topic", *criteria], indicators, "indicator", "x"), ["phase", "topic", "indicator", "x"], criteria, "external", "y")
    return K.spearman(long, ["phase", "external", "indicator"], "x", "y", 5)


def mtmm(corr: DataFrame) -> DataFrame:
    """Per criterion the mean convergent rho, mean absolute discriminant rho, violations and the verdict."""
    conv, disc = F.col("expected") == "convergent", F.col("expected") == "discriminant"
    ok = F.col("verdict") == "OK"
    a = corr.groupBy("phase", "external").agg(
        F.avg(F.when(conv, F.col("rho"))).alias("mean_convergent"), F.avg(F.when(disc, F.abs("rho"))).alias("mean_discriminant"), F.count_if(F.col("verdict").startswith("FAIL")).alias("violations"),
        F.count_if(conv & ok).alias("c_ok"), F.count_if(conv).alias("c"), F.count_if(F.col("verdict") == "FAIL_DISCRIMINANT").alias("d_fail"))
    v = F.when((F.col("c_ok") == F.col("c")) & (F.col("d_fail") == 0), "supported").when(F.col("c_ok") > 0, "partial").otherwise("rejected")
    return a.select("phase", "external", "mean_convergent", "mean_discriminant", "violations", v.alias("validity"))


def top_k(df: DataFrame, keys: list[str], score: str, tie: list[str], k: int) -> DataFrame:
    """The k best rows of each group by score, ties by ``tie``; column rank from 1."""
    w = Window.partitionBy(*keys).orderBy(F.desc(score), *tie)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def tfidf_terms(tokens: DataFrame, keys: list[str], doc: str, term: str, n: int = 15, min_df: int = 3, max_df: float = 0.85, max_terms: int = 10_000) -> DataFrame:
    """Best terms of each group by TF-IDF of its joined records: sublinear tf, idf = ln((1+N)/(1+df)) + 1 of records,
    length-normalised. ``tokens`` has a row per occurrence; the vocabulary is the ``max_terms`` most frequent in range."""
    total = tokens.select(doc).distinct().count()
    df = tokens.groupBy(term).agg(F.countDistinct(doc).alias("df"), F.count(F.lit(1)).alias("tf"))
    return tfidf_of_counts(tokens.groupBy(*keys, term).agg(F.count(F.lit(1)).alias("n")), df, total, keys, term, n, min_df, max_df, max_terms)


def term_counts(docs: DataFrame, keys: list[str], words: str, term: str = "term") -> DataFrame:
    """(keys, term, n, df): occurrences and records of each term of the arrays ``words``, a row of ``docs`` per record; combined before
    the shuffle, so no row per occurrence is moved."""
    one = lambda c, n, df: docs.select(*keys, F.explode(c).alias(term), F.lit(n).alias("n"), F.lit(df).alias("df"))
    both = one(F.col(words), 1, 0).unionByName(one(F.array_distinct(words), 0, 1))
    return both.groupBy(*keys, term).agg(F.sum("n").alias("n"), F.sum("df").alias("df"))


def tfidf_of_counts(counts: DataFrame, df: DataFrame, total: int, keys: list[str], term: str, n: int = 15, min_df: int = 3, max_df: float = 0.85, max_terms: int = 10_000) -> DataFrame:
    """B14 from the occurrences (keys, term, n) and the records and occurrences (term, df, tf) of each term."""
    vocab = df.filter((F.col("df") >= min_df) & (F.col("df") <= max_df * total)).orderBy(F.desc("tf"), term).limit(max_terms)
    vocab = vocab.select(term, (F.log((1.0 + total) / (1.0 + F.col("df"))) + 1.0).alias("idf"))
    w = counts.select(*keys, term, "n").join(vocab, term).withColumn("w", (1.0 + F.log("n")) * F.col("idf"))
    norm = w.groupBy(*keys).agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    scored = w.join(norm, keys).select(*keys, term, F.round(F.col("w") / F.col("norm"), 9).alias("score")).filter("score > 0")
    return top_k(scored, keys, "score", [term], n)


def class_tfidf(tokens: DataFrame, keys: list[str], doc: str, term: str, n: int = 10, min_df: int = 2) -> DataFrame:
    """Class-based TF-IDF: share of the term in the class times ln(1 + mean class length / frequency of the term)."""
    df = tokens.groupBy(term).agg(F.countDistinct(doc).alias("df")).filter(F.col("df") >= min_df)
    return class_tfidf_of_counts(tokens.filter("topic >= 0").join(df, term).groupBy(*keys, term).agg(F.count(F.lit(1)).alias("n")), keys, term, n)


def class_tfidf_of_counts(c: DataFrame, keys: list[str], term: str, n: int = 10) -> DataFrame:
    """B15 from the occurrences (keys, term, n) of the terms of the vocabulary in the classes."""
    size = c.groupBy(*keys).agg(F.sum("n").alias("size"))
    freq = c.groupBy(term).agg(F.sum("n").alias("f"))
    mean = size.agg((F.sum("size") / F.count(F.lit(1))).alias("mean"))
    s = c.join(size, keys).join(freq, term).join(mean).withColumn("score", F.round(F.col("n") / F.col("size") * F.log(1.0 + F.col("mean") / F.col("f")), 9))
    return top_k(s, keys, "score", [term], n).select(*keys, term, "score", "rank")


def cooccurrence_coherence(tokens: DataFrame, tops: DataFrame, keys: list[str], doc: str, term: str, total: int | None = None) -> DataFrame:
    """U_mass and document NPMI of each group's top terms over all records.

    Only the occurrences of top terms are joined with each other, within a record; each record has at most as many distinct
    top terms as there are. ``total`` is the number of all records where ``tokens`` holds only some of them.
    """
    total = tokens.select(doc).distinct().count() if total is None else total
    terms = tops.select(term).distinct()
    occ = tokens.select(doc, term).distinct().join(terms, term)
    df = occ.groupBy(term).agg(F.count(F.lit(1)).alias("df"))
    ranked = tops.select(*keys, term, "rank")
    a = occ.join(ranked, term).select(*keys, doc, F.col(term).alias("ta"), F.col("rank").alias("ra"))
    b = occ.join(ranked, term).select(*keys, doc, F.col(term).alias("tb"), F.col("rank").alias("rb"))
    co = a.join(b, [*keys, doc]).filter("ra < rb").groupBy(*keys, "ta", "tb").agg(F.count(F.lit(1)).alias("c"))
    x = ranked.select(*keys, F.col(term).alias("ta"), F.col("rank").alias("ra"))
    y = ranked.select(*keys, F.col(term).alias("tb"), F.col("rank").alias("rb"))
    p = x.join(y, keys).filter("ra < rb").join(co, [*keys, "ta", "tb"], "left").withColumn("c", F.coalesce("c", F.lit(0)))
    p = p.join(df.select(F.col(term).alias("ta"), F.col("df").alias("da")), "ta").join(df.select(F.col(term).alias("tb"), F.col("df").alias("db")), "tb")
    pab = F.col("c") / total
    npmi = F.when(F.col("c") == 0, -1.0).when(F.col("c") == total, 1.0).otherwise(F.log(pab / ((F.col("da") / total) * (F.col("db") / total))) / -F.log(pab))
    return p.groupBy(*keys).agg(F.avg(F.log((F.col("c") + 1.0) / F.col("da"))).alias("u_mass"), F.avg(npmi).alias("npmi"))


def transition_matrix(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """Counts of class pairs with totals: the cube of both classes, 'all' for a total."""
    c = pairs.cube(a, b).agg(F.count(F.lit(1)).alias("n"))
    return c.select(F.coalesce(a, F.lit("all")).alias(a), F.coalesce(b, F.lit("all")).alias(b), "n")


def with_p_value(corr: DataFrame) -> DataFrame:
    """``corr`` with the two-sided p-value of ``rho`` over ``n`` rows by Student's t; null for a null rho."""
    from topicweave.operators.multivariate import student_p

    @F.pandas_udf(T.DoubleType())
    def p(rho: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([None if r is None or r != r else student_p(r, int(k)) for r, k in zip(rho, n, strict=True)], dtype=float)

    return corr.withColumn("p", F.when(F.col("rho").isNotNull(), p("rho", "n")))


def match_evalues(scores: DataFrame) -> DataFrame:
    """(topic1, h, p, e): best score of each topic, the share of all pairs above it, and candidates times that share.

    Pairs above a score are counted from running sums over the distinct scores, not by comparing scores with scores.
    """
    c = scores.groupBy("hybrid").agg(F.count(F.lit(1)).alias("c"))
    above = F.coalesce(F.sum("c").over(Window.partitionBy(F.lit(1)).orderBy(F.desc("hybrid")).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    c = c.withColumn("above", above)  # a row per distinct score of two topics
    total = scores.agg(F.count(F.lit(1)).alias("pairs"), F.countDistinct("topic2").alias("candidates"))
    best = scores.groupBy("topic1").agg(F.max("hybrid").alias("h"))
    out = best.join(c.select(F.col("hybrid").alias("h"), "above"), "h").join(total)  # a table of one row
    return out.select("topic1", "h", (F.col("above") / F.col("pairs")).alias("p"), (F.col("candidates") * F.col("above") / F.col("pairs")).alias("e"))


def effective_candidates(scores: DataFrame) -> DataFrame:
    """(n_all, n_lower, ties): maximum likelihood of n in Beta(n, 1) from the ranks of the best scores, -m / Σ ln r, the same
    truncated at the median rank, k / (k ln c - Σ ln r), and the share of pairs with score 0."""
    r = match_evalues(scores).select(F.least(F.greatest(1.0 - F.col("p"), F.lit(1e-12)), F.lit(1 - 1e-12)).alias("r"))
    c = r.agg(F.percentile("r", 0.5).alias("c"))
    low = F.col("r") <= F.col("c")
    a = r.join(c).agg((-F.count(F.lit(1)) / F.sum(F.log("r"))).alias("n_all"), (F.count_if(low) / (F.count_if(low) * F.log(F.first("c")) - F.sum(F.when(low, F.log("r"))))).alias("n_lower"))
    return a.join(scores.agg(F.avg((F.col("hybrid") == 0).cast("double")).alias("ties")))


def flag_overlap(scores: DataFrame, scales: list[str]) -> DataFrame:
    """(flag, a, b, common, jaccard): sizes and overlap of the topics that two scales mark."""
    long = K.unpivot(scores, ["topic1", "topic2"], scales, "scale", "v")
    q99 = long.groupBy("scale").agg(F.percentile("v", 0.99).alias("q"))
    first = long.groupBy("scale", F.col("topic1").alias("topic")).agg(F.max("v").alias("h")).join(q99, "scale").filter("h < q").select(F.lit("below_q99").alias("flag"), "scale", "topic")
    best = long.groupBy("scale", F.col("topic2").alias("topic")).agg(F.max("v").alias("h"))
    q25 = best.groupBy("scale").agg(F.percentile("h", 0.25).alias("q"))
    second = best.join(q25, "scale").filter("h < q").select(F.lit("below_q25").alias("flag"), "scale", "topic")
    in_scale = lambda s: F.max((F.col("scale") == s).cast("int"))
    per = first.unionByName(second).groupBy("flag", "topic").agg(in_scale(scales[0]).alias("a"), in_scale(scales[1]).alias("b"))
    every = scores.sparkSession.createDataFrame([("below_q99",), ("below_q25",)], "flag string")
    n = every.join(per.groupBy("flag").agg(F.sum("a").alias("a"), F.sum("b").alias("b"), F.sum(F.col("a") * F.col("b")).alias("common")), "flag", "left").na.fill(0)
    union = F.col("a") + F.col("b") - F.col("common")
    return n.select("flag", "a", "b", "common", F.when(union > 0, F.col("common") / union).alias("jaccard"))


def ratio_box(values: DataFrame, floor: float = 0.1) -> DataFrame:
    """V8: of (phase, topic, o) over the phase's median: whiskers at 5 and 95 %, quartiles (values lifted to ``floor``), the median and how many are below 1."""
    r = values.withColumn("base", F.percentile("o", 0.5).over(Window.partitionBy("phase"))).withColumn("ratio", F.when(F.col("base") > 0, F.col("o") / F.col("base"))).filter("ratio IS NOT NULL")
    lifted = F.greatest(F.col("ratio"), F.lit(floor))
    a = r.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.percentile(lifted, F.array(*[F.lit(x) for x in (0.05, 0.25, 0.75, 0.95)])).alias("q"), F.percentile("ratio", 0.5).alias("median"), F.count_if(F.col("ratio") < 1.0).alias("below"))
    return a.select("phase", "n", F.col("q")[0].alias("low"), F.col("q")[1].alias("q25"), "median", F.col("q")[2].alias("q75"), F.col("q")[3].alias("high"), "below")


def join_first_key(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """``left`` with the columns of ``right`` by the first of ``keys`` that both have; other columns of ``right`` that ``left`` has too are
    left out. No common key is an error; null keys meet nothing."""
    key = next((k for k in keys if k in left.columns and k in right.columns), None)
    if key is None:
        raise ValueError(f"none of {keys} is in both tables")
    return left.join(right.select(key, *[c for c in right.columns if c not in left.columns]), key, "left")
