"""Candidate indicators of the second generation (C1-C21) on long tables; (phase, topic, value) each."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicweave.functions.lexicon import hedge_counts
from topicweave.operators import kernels as K
from topicweave.operators.indicators import KEYS, LAST_YEAR, citation_rate, is_review, topics


def renyi(terms: DataFrame, out: str, log_kinds: bool = False) -> DataFrame:
    """-ln of Simpson's λ over pairs of different records, over ln K of all kinds if ``log_kinds``."""
    lam = K.simpson(K.counts(topics(terms), [*KEYS, "uid"], "term"), KEYS, "uid", "term")
    v = F.when(F.col("lam") > 0, -F.log("lam"))
    if not log_kinds:
        return lam.select(*KEYS, v.alias(out))
    kinds = terms.groupBy("phase").agg(F.countDistinct("term").alias("kinds"))
    return lam.join(kinds, "phase").select(*KEYS, (v / F.log("kinds")).alias(out))


def chao_shen(terms: DataFrame, out: str = "eo2_a2") -> DataFrame:
    """Coverage-adjusted entropy (natural) over ln of the number of all kinds."""
    c = K.counts(topics(terms), KEYS, "term")
    a = c.groupBy(*KEYS).agg(F.sum("n").alias("total"), F.count_if(F.col("n") == 1).alias("f1"))
    a = a.withColumn("cov", 1.0 - F.when(F.col("f1") == F.col("total"), F.col("f1") - 1).otherwise(F.col("f1")) / F.col("total"))
    p = c.join(a, KEYS).withColumn("pa", F.col("cov") * F.col("n") / F.col("total"))
    h = p.groupBy(*KEYS, "total").agg((-F.sum(F.col("pa") * F.log("pa") / (1.0 - F.pow(1.0 - F.col("pa"), F.col("total"))))).alias("h"))
    kinds = terms.groupBy("phase").agg(F.countDistinct("term").alias("kinds"))
    return h.join(kinds, "phase").select(*KEYS, F.when(F.col("total") >= 2, F.col("h") / F.log("kinds")).alias(out))


def single_country(ctry: DataFrame, out: str = "di3_a2") -> DataFrame:
    """C4: share of records with countries that have just one; null below 2 such records."""
    d = topics(ctry).select(*KEYS, "uid", "term").distinct().groupBy(*KEYS, "uid").agg(F.count(F.lit(1)).alias("k"))
    a = d.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg((F.col("k") >= 2).cast("double")).alias("s"))
    return a.select(*KEYS, F.when(F.col("n") >= 2, 1.0 - F.col("s")).alias(out))


def length_adjusted_incoherence(vectors: DataFrame, deciles: int = 10) -> DataFrame:
    """Expected minus observed mean cosine, expected from the length deciles of the topic's records.

    The mean similarity of two deciles is a product of their vector sums; vectors are of unit length.
    """
    cuts = vectors.groupBy("phase").agg(F.percentile("size", F.array(*[F.lit(i / deciles) for i in range(1, deciles)])).alias("cuts"))
    v = vectors.filter("size IS NOT NULL").join(cuts, "phase").withColumn("bin", F.size(F.filter("cuts", lambda c: c <= F.col("size"))))
    dims = v.select("phase", "bin", F.posexplode("embedding").alias("dim", "x")).groupBy("phase", "bin", "dim").agg(F.sum(F.col("x").cast("double")).alias("s"), F.sum(F.pow(F.col("x").cast("double"), 2)).alias("q"), F.count(F.lit(1)).alias("k"))
    a, b = dims, dims.select("phase", "dim", F.col("bin").alias("bin2"), F.col("s").alias("s2"), F.col("k").alias("k2"))
    g = a.join(b, ["phase", "dim"]).groupBy("phase", "bin", "bin2").agg(F.sum(F.col("s") * F.col("s2")).alias("dot"), F.sum("q").alias("q"), F.max("k").alias("k"), F.max("k2").alias("k2"))
    same = F.col("bin") == F.col("bin2")
    g = g.select("phase", "bin", "bin2", F.when(same, (F.col("dot") - F.col("q")) / (F.col("k") * (F.col("k") - 1.0))).otherwise(F.col("dot") / (F.col("k") * F.col("k2"))).alias("g"))
    c = topics(v).groupBy(*KEYS, "bin").agg(F.count(F.lit(1)).alias("c"))
    c2 = c.select(*KEYS, F.col("bin").alias("bin2"), F.col("c").alias("c2"))
    n = c.groupBy(*KEYS).agg(F.sum("c").alias("n"))
    w = F.when(F.col("bin") == F.col("bin2"), F.col("c") * (F.col("c2") - 1.0)).otherwise(F.col("c") * F.col("c2"))
    e = c.join(c2, KEYS).join(g, ["phase", "bin", "bin2"]).groupBy(*KEYS).agg(F.sum(w * F.col("g")).alias("e")).join(n, KEYS)
    o = K.pair_cosine(topics(v), KEYS, "embedding", "o").drop("n")
    return e.join(o, KEYS).select(*KEYS, (F.col("e") / (F.col("n") * (F.col("n") - 1.0)) - F.col("o")).alias("eo3_a1"))


def hedge_density(pub: DataFrame, text: str = "abstract", hedges: list[str] | None = None, boosters: list[str] | None = None, least_words: int = 20) -> DataFrame:
    """(phase, topic, eo4_a2, booster): means of 1000 · hedges / words and of 1000 · boosters / words over texts of at least
    ``least_words`` words. The lists default to the published ones; ``io.read_lexicon`` reads others."""
    c = topics(pub).select(*KEYS, hedge_counts(F.col(text), hedges, boosters).alias("c")).select(*KEYS, "c.*").filter(F.col("words") >= least_words)
    return c.groupBy(*KEYS).agg(F.avg(1000.0 * F.col("hedges") / F.col("words")).alias("eo4_a2"), F.avg(1000.0 * F.col("boosters") / F.col("words")).alias("booster"))


def finding_scores(sents: DataFrame) -> DataFrame:
    """(phase, topic, eo4_a1, eo4_a1r, eo4_a1b, eo4_a1rb) from scored sentences (keys, uid, nr, finding, score, notice).

    ``score`` is the certainty that a model gave a sentence, an input here. A1: minus the mean score of a record's finding sentences,
    of its last sentence if it has none; A1R: minus the mean of all its sentences; A1B and A1RB: the same without
    sentences marked as publisher's ``notice``. Topics are means over records.
    """
    own = ~F.col("notice")
    mean = lambda cond: F.avg(F.when(cond, F.col("score")))
    last = lambda cond: F.max_by(F.when(cond, F.col("score")), F.when(cond, F.col("nr")))
    d = sents.groupBy(*KEYS, "uid").agg(
        F.coalesce(mean(F.col("finding")), last(F.lit(True))).alias("a1"), F.avg("score").alias("a1r"), F.coalesce(mean(F.col("finding") & own), last(own)).alias("a1b"), mean(own).alias("a1rb"))
    return d.groupBy(*KEYS).agg(*[(-F.avg(c)).alias(f"eo4_{c}") for c in ("a1", "a1r", "a1b", "a1rb")])


def combined_certainty(a1: DataFrame, a2: DataFrame) -> DataFrame:
    """C8 EO4_R3: mean of the z-scores (population, within the phase) of EO4_A1 and EO4_A2 over topics that have both."""
    j = a1.join(a2, KEYS).filter("eo4_a1 IS NOT NULL AND eo4_a2 IS NOT NULL")
    return j.select(*KEYS, ((K.zscore("eo4_a1", ["phase"]) + K.zscore("eo4_a2", ["phase"])) / 2.0).alias("eo4_r3"))


def semantic_diversity(words: DataFrame, vectors: DataFrame, least_docs: int = 20, floor: float = 0.001, least_words: int = 5) -> DataFrame:
    """Per word and topic -ln of the mean cosine of the word's records outside the topic; mean over a record's words, then
    over records. Sums per word are formed once, the topic's own part is subtracted."""
    dims = words.select("phase", "topic", "uid", "term").distinct().join(vectors.select("uid", F.posexplode("embedding").alias("dim", "x")), "uid").withColumn("x", F.col("x").cast("double"))
    own = dims.groupBy("phase", "term", "topic", "dim").agg(F.sum("x").alias("s"), F.sum(F.col("x") * F.col("x")).alias("q"), F.count(F.lit(1)).alias("m"))
    word = own.groupBy("phase", "term", "dim").agg(F.sum("s").alias("all_s"), F.sum("q").alias("all_q"), F.sum("m").alias("all_m"))
    out = topics(own).join(word, ["phase", "term", "dim"])
    d = out.groupBy(*KEYS, "term").agg(F.sum(F.pow(F.col("all_s") - F.col("s"), 2)).alias("s2"), F.sum(F.col("all_q") - F.col("q")).alias("q"), F.max(F.col("all_m") - F.col("m")).alias("m"))
    d = d.filter(F.col("m") >= least_docs).withColumn("semd", -F.log(F.greatest((F.col("s2") - F.col("q")) / (F.col("m") * (F.col("m") - 1.0)), F.lit(floor))))
    per = topics(words).select(*KEYS, "uid", "term").distinct().join(d.select(*KEYS, "term", "semd"), [*KEYS, "term"]).groupBy(*KEYS, "uid").agg(F.avg("semd").alias("v"), F.count(F.lit(1)).alias("k"))
    return per.filter(F.col("k") >= least_words).groupBy(*KEYS).agg(F.avg("v").alias("eo5_a1"))


def visibility(shares: DataFrame, decay: float = 0.05, floor: float = 0.1) -> DataFrame:
    """Σ share·(1 - decay·age), at least its 10 % quantile over topics; 1 - average rank / topics."""
    d = shares.groupBy(*KEYS).agg(F.sum(F.col("share") * (1.0 - decay * (LAST_YEAR - F.col("year")))).alias("v"))
    d = d.withColumn("v", F.greatest("v", F.percentile("v", floor).over(Window.partitionBy("phase"))))
    n = d.groupBy("phase").agg(F.count(F.lit(1)).alias("k"))
    return K.avg_rank(d, ["phase"], "v").join(n, "phase").select(*KEYS, (1.0 - F.col("rank") / F.col("k")).alias("pe1_a1"))


def inverse_prestige(pub: DataFrame, cat: DataFrame) -> DataFrame:
    """C11 PE3_A1: 1 - mid-rank percentile of a journal's mean citation rate within its main category; mean over records."""
    j = pub.filter("source_title <> '' AND year IS NOT NULL").withColumn("r", citation_rate(F.col("times_cited"), F.col("year")))
    pres = j.groupBy("phase", "source_title").agg(F.round(F.avg("r"), 9).alias("p"))
    first = cat.groupBy("phase", "source_title", "term").agg(F.count(F.lit(1)).alias("n"))
    main = first.groupBy("phase", "source_title").agg(F.min(F.struct((-F.col("n")).alias("k"), F.col("term").alias("t"))).alias("m")).select("phase", "source_title", F.col("m.t").alias("cat"))
    m = main.join(pres, ["phase", "source_title"])
    size = m.groupBy("phase", "cat").agg(F.count(F.lit(1)).alias("k"))
    m = K.avg_rank(m, ["phase", "cat"], "p").join(size, ["phase", "cat"]).withColumn("pct", (F.col("rank") - 0.5) / F.col("k"))
    a = topics(pub).join(m.select("phase", "source_title", "pct"), ["phase", "source_title"]).groupBy(*KEYS).agg(F.avg(1.0 - F.col("pct")).alias("v"), F.count("pct").alias("n"))
    return a.select(*KEYS, F.when(F.col("n") >= 2, F.col("v")).alias("pe3_a1"))


def niche_ses(pub: DataFrame) -> DataFrame:
    """C11 PE3_A2: standardised number of records in niche journals under the hypergeometric distribution."""
    j = pub.filter("source_title <> ''")
    size = j.groupBy("phase", "source_title").agg(F.count(F.lit(1)).alias("size"))
    med = size.groupBy("phase").agg(F.percentile("size", 0.5).alias("med"))
    j = j.join(size, ["phase", "source_title"]).join(med, "phase").withColumn("niche", (F.col("size") <= F.col("med")).cast("double"))
    g = j.groupBy("phase").agg(F.avg("niche").alias("q"), F.count(F.lit(1)).alias("all_n"))
    a = topics(j).groupBy(*KEYS).agg(F.sum("niche").alias("x"), F.count(F.lit(1)).alias("n")).join(g, "phase")
    var = F.col("n") * F.col("q") * (1.0 - F.col("q")) * (F.col("all_n") - F.col("n")) / (F.col("all_n") - 1.0)
    return a.select(*KEYS, F.when(var > 0, (F.col("x") - F.col("n") * F.col("q")) / F.sqrt(var)).alias("pe3_a2"))


def vitality(pub: DataFrame, recent: int = 3) -> DataFrame:
    """Mean of 1 / age, and share of the last ``recent`` years."""
    return topics(pub).filter("year IS NOT NULL").groupBy(*KEYS).agg(F.avg(1.0 / (LAST_YEAR - F.col("year") + 1)).alias("ds1_a1"), F.avg((F.col("year") > LAST_YEAR - recent).cast("double")).alias("ds1_a2"))


def term_novelty(terms: DataFrame, window: int = 2) -> DataFrame:
    """Share of a record's terms that first appear at most ``window`` years before it, minus its year's mean."""
    t = terms.filter("year IS NOT NULL").select(*KEYS, "uid", "year", "term").distinct()
    first = t.groupBy("phase", "term").agg(F.min("year").alias("first"))
    d = t.join(first, ["phase", "term"]).groupBy(*KEYS, "uid", "year").agg(F.avg((F.col("first") >= F.col("year") - window).cast("double")).alias("new"))
    mean = d.groupBy("phase", "year").agg(F.avg("new").alias("mean"))
    return topics(d.join(mean, ["phase", "year"])).groupBy(*KEYS).agg(F.avg(F.col("new") - F.col("mean")).alias("ds2_a3"))


def beta_cdf(x: float, a: float, b: float) -> float:
    """Regularised incomplete beta function by its continued fraction."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_cdf(1 - x, b, a)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d or 1e-300)
    f = d
    for m in range(1, 400):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + num * d or 1e-300)
            c = 1 + num / c or 1e-300
            f *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * f


def review_tail(pub: DataFrame, alpha: float = 5.0) -> DataFrame:
    """C15 DS3_A1: Beta(2αp0 + r, 2α(1 - p0) + n - r) below p0, the phase's share of reviews in topics."""
    p = topics(pub).filter("doc_type IS NOT NULL").withColumn("r", is_review(F.col("doc_type")).cast("double"))
    m = p.groupBy("phase").agg(F.avg("r").alias("p0"))
    a = p.groupBy(*KEYS).agg(F.sum("r").alias("r"), F.count(F.lit(1)).cast("double").alias("n")).join(m, "phase")

    @F.pandas_udf(T.DoubleType())
    def tail(p0: pd.Series, r: pd.Series, n: pd.Series) -> pd.Series:
        return pd.Series([beta_cdf(x, 2 * alpha * x + k, 2 * alpha * (1 - x) + m - k) for x, k, m in zip(p0, r, n, strict=True)], dtype=float)

    return a.select(*KEYS, tail("p0", "r", "n").alias("ds3_a1"))


def author_groups(authors: DataFrame, key: Column, draws: int = 20, most: int = 25) -> DataFrame:
    """1 - (groups - 1) / (m - 1) of m drawn records joined by shared authors, mean over draws.

    m is the smallest number of records with authors of the phase's topics, at most ``most``. Draws are the m records of
    smallest hash per draw, so only m records of a topic and draw ever meet in a task.
    """
    a = topics(authors).select(*KEYS, "uid", key.alias("a")).filter("a IS NOT NULL").distinct()
    n = a.groupBy(*KEYS).agg(F.countDistinct("uid").alias("n"))
    m = n.groupBy("phase").agg(F.least(F.lit(most), F.min("n")).alias("m"))
    docs = a.select(*KEYS, "uid").distinct().withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(draws)))).join(m, "phase")
    docs = docs.withColumn("h", F.xxhash64("draw", "uid"))
    kept = docs.withColumn("part", F.pmod(F.xxhash64("uid"), F.lit(16)))
    kept = kept.withColumn("k", F.row_number().over(Window.partitionBy(*KEYS, "draw", "part").orderBy("h", "uid"))).filter("k <= m")
    kept = kept.withColumn("k", F.row_number().over(Window.partitionBy(*KEYS, "draw").orderBy("h", "uid"))).filter("k <= m").drop("k", "part", "h")

    def groups(pdf: pd.DataFrame) -> pd.DataFrame:
        root: dict = {}

        def find(x):
            while root.setdefault(x, x) != x:
                root[x] = root[root[x]]
                x = root[x]
            return x

        for u, x in zip(pdf["uid"], pdf["a"], strict=True):
            root[find(("u", u))] = find(("a", x))
        k, size = len({find(("u", u)) for u in pdf["uid"]}), int(pdf["m"].iloc[0])
        v = 1 - (k - 1) / (size - 1) if size > 1 else None
        return pd.DataFrame({"phase": pdf["phase"].iloc[:1], "topic": pdf["topic"].iloc[:1], "draw": pdf["draw"].iloc[:1], "v": [v]})

    drawn = kept.join(a, [*KEYS, "uid"]).groupBy(*KEYS, "draw").applyInPandas(groups, "phase int, topic int, draw int, v double")
    return drawn.groupBy(*KEYS).agg(F.avg("v").alias("di1_a1"))


def citation_spread(pub: DataFrame) -> DataFrame:
    """C17: Gini · n/(n-1) of citations over the year's mean, and erf(sd(ln(1+x))/2) of the same."""
    p = pub.filter("year IS NOT NULL").withColumn("c", F.coalesce("times_cited", F.lit(0)))
    mean = p.groupBy("phase", "year").agg(F.avg("c").alias("mean"))
    x = topics(p.join(mean, ["phase", "year"])).withColumn("x", F.when(F.col("mean") > 0, F.col("c") / F.col("mean")).otherwise(0.0))
    g = K.gini(x, KEYS, "x", "g")
    s = x.groupBy(*KEYS).agg(F.stddev_samp(F.log1p("x")).alias("sd"), F.sum("x").alias("total"))
    ok = (F.col("n") >= 3) & (F.col("total") > 0)

    @F.pandas_udf(T.DoubleType())
    def erf(v: pd.Series) -> pd.Series:
        return v.map(lambda t: None if t is None or math.isnan(t) else math.erf(t / 2.0))

    return g.join(s, KEYS).select(*KEYS, F.when(ok, F.col("g") * F.col("n") / (F.col("n") - 1.0)).alias("di4_a3"), erf(F.when(ok, F.col("sd"))).alias("di4_a4"))


def poisson_slope(y: np.ndarray, a: np.ndarray, t: np.ndarray) -> float | None:
    """Slope of a Poisson regression of counts on years with exposure, by Newton steps that are halved until the likelihood rises."""
    y, a, t = (v[a > 0].astype(float) for v in (y, a, t))
    if y.sum() == 0 or len(y) < 3:
        return None
    t = t - t.mean()
    beta = np.array([math.log(y.sum() / a.sum()), 0.0])
    design = np.stack([np.ones_like(t), t], axis=1)
    loglik = lambda b: float(y @ (design @ b) - (a * np.exp(design @ b)).sum())
    for _ in range(200):
        mu = a * np.exp(design @ beta)
        info = design.T @ (design * mu[:, None])
        if abs(np.linalg.det(info)) < 1e-300:
            return None
        step, scale = np.linalg.solve(info, design.T @ (y - mu)), 1.0
        while scale > 1e-4 and loglik(beta + scale * step) < loglik(beta) - 1e-12:
            scale /= 2
        beta = beta + scale * step
        if np.abs(scale * step).max() < 1e-10:
            return float(beta[1]) if abs(beta[1]) < 5 else None
    return None


def poisson_growth(shares: DataFrame) -> DataFrame:
    """C18 IP1_A1: a group is the years of one topic."""
    total = shares.groupBy("phase", "year").agg(F.sum("n").alias("a"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("year")
        v = poisson_slope(pdf["n"].to_numpy(), pdf["a"].to_numpy(), pdf["year"].to_numpy())
        return pd.DataFrame({"phase": pdf["phase"].iloc[:1], "topic": pdf["topic"].iloc[:1], "ip1_a1": [v]})

    return shares.join(total, ["phase", "year"]).groupBy(*KEYS).applyInPandas(fit, "phase int, topic int, ip1_a1 double")


def rate_ratios(pub: DataFrame, pseudo: float = 0.5) -> DataFrame:
    """Log ratio of late and early mean rates with pseudo counts, and of pooled rates."""
    from topicweave.operators.indicators import halves

    h = halves(topics(pub)).withColumn("c", F.coalesce("times_cited", F.lit(0)).cast("double")).withColumn("age", F.greatest(F.lit(LAST_YEAR + 1) - F.col("year"), F.lit(1)))
    e, late = F.col("half") == "early", F.col("half") == "late"
    r = F.col("c") / F.col("age")
    a = h.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(e, r)).alias("re"), F.avg(F.when(late, r)).alias("rl"), F.sum(F.when(e, F.col("c"))).alias("ce"), F.sum(F.when(late, F.col("c"))).alias("cl"), F.sum(F.when(e, F.col("age"))).alias("ae"), F.sum(F.when(late, F.col("age"))).alias("al"))
    ok = F.col("n") >= 4
    return a.select(*KEYS, F.when(ok, F.log((F.col("rl") + pseudo) / (F.col("re") + pseudo))).alias("ip2_a1"), F.when(ok & (F.col("cl") > 0) & (F.col("ce") > 0), F.log((F.col("cl") / F.col("al")) / (F.col("ce") / F.col("ae")))).alias("ip2_a2"))


def yearly_percentiles(pub: DataFrame) -> DataFrame:
    """``pub`` with pct, the average rank of citations within phase and year over the year's records."""
    p = pub.filter("year IS NOT NULL").withColumn("c", F.coalesce("times_cited", F.lit(0)))
    n = p.groupBy("phase", "year").agg(F.count(F.lit(1)).alias("in_year"))
    return K.avg_rank(p, ["phase", "year"], "c").join(n, ["phase", "year"]).withColumn("pct", F.col("rank") / F.col("in_year"))


def percentile_momentum(pub: DataFrame, cohort_from: int = 2020) -> DataFrame:
    """C20 IP2_A3, A5, IP3_A2: late minus early mean percentile, mean of recent records, share above the 90th percentile."""
    p = topics(yearly_percentiles(pub))
    med = p.groupBy(*KEYS).agg(F.percentile("year", 0.5).alias("m"))
    p = p.join(med, KEYS)
    a = p.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("year") <= F.col("m"), F.col("pct"))).alias("e"), F.avg(F.when(F.col("year") > F.col("m"), F.col("pct"))).alias("l"), F.avg(F.when(F.col("year") >= cohort_from, F.col("pct"))).alias("ip2_a5"), F.avg((F.col("pct") > 0.9).cast("double")).alias("ip3_a2"))
    return a.select(*KEYS, F.when(F.col("n") >= 4, F.col("l") - F.col("e")).alias("ip2_a3"), "ip2_a5", "ip3_a2")


def kendall(pub: DataFrame) -> DataFrame:
    """C20 IP2_A4: Kendall's τ_b of year and percentile.

    Never from pairs of records: records are counted by (year, percentile), and for every pair of years, a few hundred at most, a
    window over the percentiles of both gives the concordant and discordant pairs from running sums, so the work grows with the
    number of cells times years and not with its square.
    """
    p = topics(yearly_percentiles(pub)).withColumn("pct", F.round("pct", 9))
    c = p.groupBy(*KEYS, "year", "pct").agg(F.count(F.lit(1)).alias("k"))
    years = c.select(*KEYS, "year").distinct()
    pairs = years.join(years.select(*KEYS, F.col("year").alias("y2")), KEYS).filter("year < y2").select(*KEYS, "year", "y2")
    early = pairs.join(c, [*KEYS, "year"]).select(*KEYS, "year", "y2", "pct", F.col("k").alias("a"), F.lit(0).alias("b"))
    late = pairs.join(c.withColumnRenamed("year", "y2"), [*KEYS, "y2"]).select(*KEYS, "year", "y2", "pct", F.lit(0).alias("a"), F.col("k").alias("b"))
    both = early.unionByName(late).groupBy(*KEYS, "year", "y2", "pct").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*KEYS, "year", "y2").orderBy("pct").rowsBetween(Window.unboundedPreceding, -1)
    below = both.select(*KEYS, (F.col("b") * F.coalesce(F.sum("a").over(w), F.lit(0))).alias("up"), (F.col("a") * F.coalesce(F.sum("b").over(w), F.lit(0))).alias("down"))
    s = below.groupBy(*KEYS).agg(F.sum(F.col("up") - F.col("down")).cast("double").alias("s"))
    tie = lambda col: c.groupBy(*KEYS, col).agg(F.sum("k").alias("k")).groupBy(*KEYS).agg(F.sum(F.col("k") * (F.col("k") - 1) / 2.0).alias(f"t_{col}"), F.sum("k").alias("n"))
    t = tie("year").join(tie("pct").drop("n"), KEYS).join(s, KEYS, "left")
    all_pairs = F.col("n") * (F.col("n") - 1) / 2.0
    den = F.sqrt((all_pairs - F.col("t_year")) * (all_pairs - F.col("t_pct")))
    return t.select(*KEYS, F.when((F.col("n") >= 4) & (den > 0), F.coalesce("s", F.lit(0.0)) / den).alias("ip2_a4"))


def outside_neighbours(vectors: DataFrame, tau: float = 0.35, least: int = 10, block: int = 512) -> DataFrame:
    """Share of a topic's records that have at least ``least`` records of other topics (noise too) within cosine ``tau``.

    A similarity join over all records of a phase: rows are packed into blocks of ``block`` vectors, blocks meet, and a pair of
    blocks is one matrix product. Records with the same vector and topic are one row with a count, so copies are not paired.
    """
    v = vectors.groupBy("phase", "topic", "embedding").agg(F.count(F.lit(1)).alias("k")).withColumn("id", F.xxhash64("topic", "embedding"))
    total = v.count()
    parts = max(1, -(-total // block))
    v = v.withColumn("blk", F.pmod("id", F.lit(parts)))
    packed = v.groupBy("phase", "blk").agg(F.collect_list(F.struct("id", "topic", "k", F.col("embedding").cast("array<double>").alias("v"))).alias("rows"))
    a = packed.filter(F.exists("rows", lambda r: r["topic"] >= 0)).select("phase", F.col("blk").alias("ba"), F.col("rows").alias("ra"))
    b = packed.select("phase", F.col("rows").alias("rb"))
    met = a.join(b, "phase").repartition("phase", "ba") if parts > 1 else a.join(b, "phase")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for phase, ra, rb in zip(pdf["phase"], pdf["ra"], pdf["rb"], strict=True):
                ta, tb = np.array([r["topic"] for r in ra]), np.array([r["topic"] for r in rb])
                near = np.array([r["v"] for r in ra]) @ np.array([r["v"] for r in rb]).T >= tau
                near &= ta[:, None] != tb[None, :]
                hits = near @ np.array([r["k"] for r in rb])
                yield pd.DataFrame({"phase": phase, "topic": ta, "id": [r["id"] for r in ra], "k": [r["k"] for r in ra], "hits": hits})

    hits = met.mapInPandas(count, "phase int, topic int, id long, k long, hits long").filter("topic >= 0")
    per = hits.groupBy(*KEYS, "id", "k").agg(F.sum("hits").alias("hits"))
    return per.groupBy(*KEYS).agg((F.sum(F.when(F.col("hits") >= least, F.col("k")).otherwise(0)) / F.sum("k")).alias("diag_a1"))
