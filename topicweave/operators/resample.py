"""Resampling frames: replicates, variants and permutations as ordinary columns.

Random order comes from hashes of (seed, replicate, id), so a plan gives the same rows wherever and however often it runs. A frame
of topics has a row per topic and phase, so frames are small; frames of records keep replicates apart by their key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicweave.operators import indicators as I
from topicweave.operators import kernels as K
from topicweave.operators.permuted_texts import phrase_time_distances

MEMBERSHIPS = ["m_ws", "m_trend", "m_ec", "m_latent"]


def uniform(*parts) -> Column:
    """A number in (0, 1) from the hash of the parts."""
    return (F.pmod(F.xxhash64(*parts), F.lit(2**53 - 111)) + 0.5) / float(2**53 - 111)


def draw_key(*parts) -> Column:
    """A text that orders rows at random, the same in any engine that has MD5."""
    return F.md5(F.concat_ws("|", *[p.cast("string") if isinstance(p, Column) else F.col(p).cast("string") for p in parts]))


def normal(*parts) -> Column:
    """A standard normal number from the hash of the parts (Box-Muller)."""
    return F.sqrt(-2.0 * F.log(uniform(F.lit("r"), *parts))) * F.cos(2.0 * math.pi * uniform(F.lit("a"), *parts))


def replicates(df: DataFrame, n: int, name: str = "rep") -> DataFrame:
    return df.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(n))))


def variants(df: DataFrame, rows: list[dict], spark) -> DataFrame:
    """Every row of ``df`` once per variant, a short list of parameter settings."""
    keys = list(rows[0])
    return df.withColumn("_v", F.explode(F.array(*[F.struct(*[F.lit(r[k]).alias(k) for k in keys]) for r in rows]))).select("*", "_v.*").drop("_v")


def compare(new: DataFrame, base: DataFrame, keys: list[str]) -> DataFrame:
    """Spearman of each membership with the base, share of topics that change class, mean shift of the margin."""
    b = base.select(*I.KEYS, *[F.col(m).alias(f"b_{m}") for m in MEMBERSHIPS], F.col("margin").alias("b_margin"), F.col("dominant").alias("b_dominant"))
    j = new.join(b, I.KEYS)
    out = j.groupBy(*keys).agg(F.avg((F.col("dominant") != F.col("b_dominant")).cast("double")).alias("changed"), F.avg(F.col("margin") - F.col("b_margin")).alias("margin_shift"))
    for m in MEMBERSHIPS:
        out = out.join(K.spearman(j, keys, m, f"b_{m}", 5, f"rho_{m}").drop("n"), keys)
    return out


def k_lambda_grid(scored: DataFrame, spark, ks=(0.5, 1.0, 2.0), lams=(0.3, 0.5, 0.7)) -> DataFrame:
    """M9: memberships over a grid of slopes and impact weights, one plan."""
    g = variants(scored, [{"k": float(k), "lam": float(x)} for k in ks for x in lams], spark)
    return I.memberships(g, F.col("k"), F.col("lam"), ["phase", "k", "lam"])


def alpha_grid(pub: DataFrame, spark, alphas=(2.0, 5.0, 10.0)) -> DataFrame:
    """Review absence for several prior strengths, from one pass over the counts."""
    p = I.topics(pub).withColumn("r", F.when(F.col("doc_type").isNotNull(), I.is_review(F.col("doc_type")).cast("double")))
    m = p.groupBy("phase").agg(F.avg("r").alias("m"))
    a = p.groupBy(*I.KEYS).agg(F.sum("r").alias("r"), F.count("r").alias("n")).join(m, "phase")
    v = variants(a, [{"alpha": float(x)} for x in alphas], spark)
    return v.select(*I.KEYS, "alpha", (1.0 - (F.col("r") + 2.0 * F.col("alpha") * F.col("m")) / (F.col("n") + 2.0 * F.col("alpha"))).alias("ds3"))


def leave_one_out(ind: DataFrame, spark) -> DataFrame:
    """Dimension scores and memberships without each indicator in turn; the left-out one is null in its variant."""
    v = variants(ind, [{"left_out": i} for i in ["none", *I.INDICATORS]], spark)
    v = v.withColumns({i: F.when(F.col("left_out") != i, F.col(i)) for i in I.INDICATORS})
    return I.memberships(I.dimension_scores(v, keys=["phase", "left_out"]).withColumns({c: F.coalesce(c, F.lit(0.0)) for c in I.EC}), keys=["phase", "left_out"])


def standardisations(ind: DataFrame, spark) -> DataFrame:
    """Memberships from values standardised classically, robustly, or by rank."""
    w = Window.partitionBy("phase", "variant")
    v = variants(ind, [{"variant": x} for x in ("classic", "robust", "rank")], spark)
    for i in I.INDICATORS:
        n = F.count(i).over(w)
        rank = (F.rank().over(w.orderBy(i)) + (F.count(i).over(Window.partitionBy("phase", "variant", i)) - 1) / 2.0) / n
        v = v.withColumn(f"s_{i}", F.when(F.col("variant") == "classic", F.col(i)).when(F.col("variant") == "robust", K.robust_z(i, ["phase", "variant"])).otherwise(rank))
    v = v.select(*[c for c in ind.columns if c not in I.INDICATORS], "variant", *[F.col(f"s_{i}").alias(i) for i in I.INDICATORS])
    return I.memberships(I.dimension_scores(v, keys=["phase", "variant"]), keys=["phase", "variant"])


def perturbed(ind: DataFrame, levels=(0.05, 0.1, 0.2, 0.3), reps: int = 1000, seed: int = 42) -> DataFrame:
    """Memberships of indicators with Gaussian noise of ``level`` standard deviations, ``reps`` times each."""
    sd = ind.groupBy("phase").agg(*[F.stddev_pop(i).alias(f"sd_{i}") for i in I.INDICATORS])
    r = replicates(ind.join(sd, "phase"), reps).withColumn("level", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    noise = {i: F.col(i) + F.col("level") * F.col(f"sd_{i}") * normal(F.lit(seed), F.lit(i), "rep", "level", *I.KEYS) for i in I.INDICATORS}
    r = r.withColumns(noise).drop(*[f"sd_{i}" for i in I.INDICATORS])
    keys = ["phase", "level", "rep"]
    return I.memberships(I.dimension_scores(r, keys=keys), keys=keys)


def flip_rates(noisy: DataFrame, base: DataFrame) -> DataFrame:
    """Share of replicates in which a topic changes its class, by level."""
    b = base.select(*I.KEYS, F.col("dominant").alias("base"), F.col("margin").alias("base_margin"))
    return noisy.join(b, I.KEYS).groupBy("level", *I.KEYS, "base", "base_margin").agg(F.avg((F.col("dominant") != F.col("base")).cast("double")).alias("flip_rate"))


def permuted(ind: DataFrame, reps: int, blocks: dict[str, list[str]], seed: int = 42) -> DataFrame:
    """Indicators with the topics of each block of columns permuted within the phase, independently per block and replicate.

    A permutation joins two row numbers: topics by id and topics by hash.
    """
    base = replicates(ind.select(*I.KEYS), reps)
    w = Window.partitionBy("phase", "rep")
    out = base.withColumn("i", F.row_number().over(w.orderBy("topic")))
    for name, cols in blocks.items():
        other = replicates(ind.select(*I.KEYS, *cols), reps).withColumn("i", F.row_number().over(w.orderBy(F.xxhash64(F.lit(seed), F.lit(name), "rep", "topic"), "topic"))).drop("topic")
        out = out.join(other, ["phase", "rep", "i"])
    return out.drop("i")


def mean_within(ind: DataFrame, keys: list[str]) -> DataFrame:
    """The structure statistic of M18: mean Pearson correlation of indicators of one dimension minus that of different ones."""
    of = {i: d for d, m in I.DIMENSIONS.items() for i in m}
    pairs = [(a, b, of[a] == of[b]) for n, a in enumerate(I.INDICATORS) for b in I.INDICATORS[:n]]
    one = ind.groupBy(*keys).agg(*[K.pearson(a, b).alias(f"{a}_{b}") for a, b, _ in pairs])
    mean = lambda same: F.aggregate(F.array_compact(F.array(*[F.col(f"{a}_{b}") for a, b, s in pairs if s is same])), F.struct(F.lit(0.0).alias("s"), F.lit(0).alias("n")), lambda acc, x: F.struct((acc["s"] + x).alias("s"), (acc["n"] + 1).alias("n")), lambda acc: F.when(acc["n"] > 0, acc["s"] / acc["n"]))
    return one.select(*keys, mean(True).alias("within"), mean(False).alias("between"))


def null_model(ind: DataFrame, reps: int = 1000, seed: int = 42, blocks: dict[str, list[str]] | None = None) -> DataFrame:
    """Observed structure, mean and deviation under permutation, standardised effect and p-value (one-sided)."""
    blocks = blocks or {i: [i] for i in I.INDICATORS}
    obs = mean_within(ind, ["phase"]).select("phase", (F.col("within") - F.col("between")).alias("observed"))
    null = mean_within(permuted(ind, reps, blocks, seed), ["phase", "rep"]).withColumn("x", F.col("within") - F.col("between")).select("phase", "x")
    a = null.join(obs, "phase").groupBy("phase", "observed").agg(F.avg("x").alias("mean"), F.stddev_samp("x").alias("sd"), F.count_if(F.col("x") >= F.col("observed")).alias("above"), F.count(F.lit(1)).alias("reps"))
    return a.select("phase", "observed", "mean", "sd", F.when(F.col("sd") > 0, (F.col("observed") - F.col("mean")) / F.col("sd")).alias("ses"), ((F.col("above") + 1.0) / (F.col("reps") + 1.0)).alias("p"), "reps")


#: Records of a topic are ranked by hash in so many slices.
SLICES = 32


def permuted_years(docs: DataFrame, reps: int, seed: int) -> DataFrame:
    """(keys, uid, rep, year): the years of a topic's records in ``reps`` random orders, replicate 0 as they are.

    In a replicate the record of rank i by hash gets the i-th year of the topic. Ranks are counted in slices of the hash, and
    the slices' sizes summed up, so no topic is sorted in one task; the years by rank are a row per record, not per replicate.
    """
    top = 2**53 - 111
    # spread before each row becomes ``reps`` rows; small partitions would be merged into one task otherwise
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    r = docs.repartition(parts, "uid").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps)))).withColumn("h", F.pmod(F.xxhash64(F.lit(seed), "rep", "uid"), F.lit(top)))
    r = r.withColumn("slice", F.floor(F.col("h") / F.lit(top) * SLICES).cast("int"))
    sizes = r.groupBy(*I.KEYS, "rep", "slice").agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy(*I.KEYS, "rep").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sizes = sizes.select(*I.KEYS, "rep", "slice", before.alias("before"))
    r = r.withColumn("i", F.row_number().over(Window.partitionBy(*I.KEYS, "rep", "slice").orderBy("h", "uid"))).join(sizes, [*I.KEYS, "rep", "slice"])
    r = r.select(*I.KEYS, "uid", "rep", (F.col("i") + F.col("before")).alias("i"))
    years = docs.groupBy(*I.KEYS, "year").agg(F.count(F.lit(1)).alias("n"))
    start = F.coalesce(F.sum("n").over(Window.partitionBy(*I.KEYS).orderBy("year").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    places = years.withColumn("start", start).select(*I.KEYS, "year", F.explode(F.sequence(F.col("start") + 1, F.col("start") + F.col("n"))).alias("i"))
    return r.join(places, [*I.KEYS, "i"]).select(*I.KEYS, "uid", "rep", "year").unionByName(docs.select(*I.KEYS, "uid", F.lit(0).alias("rep"), "year"))


def _ses(d: DataFrame, out: str) -> DataFrame:
    """Replicate 0 against the others: (observed - mean) / sd, null below ten replicates with a value."""
    null = F.when(F.col("rep") > 0, F.col("d"))
    a = d.filter("d IS NOT NULL").groupBy(*I.KEYS).agg(F.max(F.when(F.col("rep") == 0, F.col("d"))).alias("observed"), F.avg(null).alias("mean"), F.stddev_samp(null).alias("sd"), F.count(null).alias("nulls"))
    return a.select(*I.KEYS, "observed", F.when((F.col("nulls") >= 10) & (F.col("sd") > 0), (F.col("observed") - F.col("mean")) / F.col("sd")).alias(out))


def time_permutation_ses(pub: DataFrame, terms: DataFrame, reps: int = 50, seed: int = 42, mode: str = "halves", out: str = "eo1_a2") -> DataFrame:
    """(phase, topic, observed, <out>): distance of a topic's vocabulary over time against permutations of the years of its records.

    ``mode`` 'halves' compares the records up to the median year with the later ones (EO1_A2, from four records on), 'years'
    takes the mean over neighbouring years that the topic has, both with terms (DS2_A1, DS2_A2, from three years on).
    """
    docs = I.topics(pub).filter("year IS NOT NULL").select(*I.KEYS, "uid", "year")
    size = docs.groupBy(*I.KEYS).agg(F.count(F.lit(1)).alias("n"), F.countDistinct("year").alias("years"), F.percentile("year", 0.5).alias("m"))
    least = "n >= 4" if mode == "halves" else "years >= 3"
    # records are moved once per replicate: by a number, not by their id
    number = F.xxhash64("uid").alias("uid")
    docs = docs.join(size.filter(least).select(*I.KEYS), I.KEYS, "left_semi").select(*I.KEYS, number, "year")
    t = K.counts(I.topics(terms), [*I.KEYS, "uid"], "term").select(*I.KEYS, number, F.xxhash64("term").alias("term"), "n")
    years = permuted_years(docs, reps, seed)
    if mode == "halves":
        half = F.when(F.col("year") <= F.col("m"), "early").otherwise("late")
        long = years.join(size.select(*I.KEYS, "m"), I.KEYS).select(*I.KEYS, "rep", "uid", half.alias("half")).join(t, [*I.KEYS, "uid"])
        return _ses(K.ruzicka(long, [*I.KEYS, "rep"], "half", "early", "late", "term", "d"), out)
    c = years.join(t, [*I.KEYS, "uid"]).groupBy(*I.KEYS, "rep", "year", "term").agg(F.sum("n").alias("n"))
    own = docs.select(*I.KEYS, "year").distinct()
    own = own.withColumn("before", F.lag("year").over(Window.partitionBy(*I.KEYS).orderBy("year")))
    # a count is the later side of one pair of years and the earlier side of the next
    sides = c.join(own, [*I.KEYS, "year"])
    later = sides.filter("before IS NOT NULL").select(*I.KEYS, "rep", F.col("year").alias("pair"), F.lit("b").alias("side"), "term", "n")
    after = own.filter("before IS NOT NULL").select(*I.KEYS, F.col("before").alias("year"), F.col("year").alias("pair"))
    earlier = c.join(after, [*I.KEYS, "year"]).select(*I.KEYS, "rep", "pair", F.lit("a").alias("side"), "term", "n")
    d = K.ruzicka(earlier.unionByName(later), [*I.KEYS, "rep", "pair"], "side", "a", "b", "term", "d").filter("d IS NOT NULL").groupBy(*I.KEYS, "rep").agg(F.avg("d").alias("d"))
    return _ses(d, out)


def phrase_permutation_ses(pub: DataFrame, texts: DataFrame, stop: list[str], reps: int = 50, seed: int = 42, out: str = "ds2_a2") -> DataFrame:
    """As ``time_permutation_ses`` in mode 'years' with the phrases of whole texts, of which there are too many to be counted row by row
    in every replicate. ``pub`` has (phase, topic, uid, row, year), ``texts`` (phase, topic, row, text), marked texts of rows that may be more."""
    docs = I.topics(pub).select(*I.KEYS, F.xxhash64("uid").alias("uid"), "row", "year")
    return _ses(phrase_time_distances(docs, I.topics(texts), stop, reps, seed), out)


def class_shares_against_null(ind: DataFrame, reps: int = 1000, seed: int = 42, blocks: dict[str, list[str]] | None = None) -> DataFrame:
    """(phase, dominant, real, null_mean, low, high, p, outside, reps): shares of the classes against permuted indicators, the
    two-sided p-value being the part of replicates at least as far from their mean, low and high their 2.5 and 97.5 percentiles."""
    share = lambda m, keys: m.groupBy(*keys).agg(*[F.avg((F.col("dominant") == c).cast("double")).alias(c) for c in ("ws", "trend", "ec", "latent")]).unpivot(keys, ["ws", "trend", "ec", "latent"], "dominant", "share")
    real = share(I.memberships(I.dimension_scores(ind)), ["phase"]).withColumnRenamed("share", "real")
    keys = ["phase", "rep"]
    null = share(I.memberships(I.dimension_scores(permuted(ind, reps, blocks or {i: [i] for i in I.INDICATORS}, seed), keys=keys), keys=keys), keys)
    w = Window.partitionBy("phase", "dominant")
    j = null.withColumn("mean", F.avg("share").over(w)).join(real, ["phase", "dominant"])
    far = F.abs(F.col("share") - F.col("mean")) >= F.abs(F.col("real") - F.col("mean"))
    a = j.groupBy("phase", "dominant", "real").agg(F.avg("share").alias("null_mean"), F.percentile("share", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.avg(far.cast("double")).alias("p"), F.count(F.lit(1)).alias("reps"))
    low, high = F.col("q")[0], F.col("q")[1]
    return a.select("phase", "dominant", "real", "null_mean", low.alias("low"), high.alias("high"), "p", ((F.col("real") < low) | (F.col("real") > high)).alias("outside"), "reps")


def criteria(values: DataFrame, sizes: DataFrame) -> DataFrame:
    """(phase, measure, k2, k4, k4_full, k4_rare, k5_r2, k5_ses, k6): quality of measures from their values on resamples.

    ``values`` has (phase, topic, measure, sample, rep, value), ``sample`` being 'ref', 'half_a', 'half_b', 'rare' or 'null'; ``sizes``
    (phase, topic, ln_n). k2: Spearman-Brown of the mean correlation of the halves; k4: Spearman of the measure with the size, and
    of its mean over rarefactions with itself and with the size; k5: squared Pearson correlation with its mean over permutations
    and the share of topics with |SES| above 2; k6: the largest |Spearman| with another measure. All on topics that have both values.
    """
    v = values.filter("value IS NOT NULL")
    by = ["phase", "measure"]
    pick = lambda s, c: v.filter(F.col("sample") == s).select(*by, "topic", "rep", F.col("value").alias(c))
    halves = K.spearman(pick("half_a", "x").join(pick("half_b", "y"), [*by, "topic", "rep"]), [*by, "rep"], "x", "y", 3)
    k2 = halves.groupBy(*by).agg(F.avg("rho").alias("r")).select(*by, F.when(F.col("r") > -1, 2 * F.col("r") / (1 + F.col("r"))).alias("k2"))
    ref = pick("ref", "ref").drop("rep").join(sizes, ["phase", "topic"])
    rare = pick("rare", "x").groupBy(*by, "topic").agg(F.avg("x").alias("rare")).join(ref, [*by, "topic"])
    null = pick("null", "x").groupBy(*by, "topic").agg(F.avg("x").alias("e0"), F.stddev_samp("x").alias("s0")).join(ref, [*by, "topic"])
    rho = lambda df, x, y, out: K.spearman(df, by, x, y, 3, out).drop("n")
    r2 = F.when(F.count(F.lit(1)) > 10, F.pow(K.pearson("ref", "e0"), 2))
    k5 = null.groupBy(*by).agg(r2.alias("k5_r2"), F.avg((F.abs((F.col("ref") - F.col("e0")) / F.when(F.col("s0") > 0, F.col("s0"))) > 2).cast("double")).alias("k5_ses"))
    other = ref.select("phase", "topic", F.col("measure").alias("other"), F.col("ref").alias("y"))
    pairs = ref.select(*by, "topic", F.col("ref").alias("x")).join(other, ["phase", "topic"]).filter("measure <> other")
    k6 = K.spearman(pairs, [*by, "other"], "x", "y", 11).groupBy(*by).agg(F.max(F.abs("rho")).alias("k6"))
    out = ref.select(*by).distinct()
    for part in (k2, rho(ref, "ref", "ln_n", "k4"), rho(rare, "rare", "ref", "k4_full"), rho(rare, "rare", "ln_n", "k4_rare"), k5, k6):
        out = out.join(part, by, "left")
    return out


def verdicts(crit: DataFrame) -> DataFrame:
    """The status of each criterion and of all; a correlation that is missing fails, but a missing K6 passes."""
    lift = lambda ok: F.when(F.coalesce(ok, F.lit(False)), "met").otherwise("missed")
    s2 = F.when(F.col("k2").isNull() | (F.col("k2") < 0.5), "missed").when(F.col("k2") < 0.75, "conditional").otherwise("good")
    out = crit.withColumns({"s2": s2, "s4": lift(F.abs("k4") < 0.2), "s5": lift(F.col("k5_r2") <= 0.5), "s6": lift(F.coalesce("k6", F.lit(0.0)) <= 0.9)})
    return out.withColumn("passed", ~F.array_contains(F.array("s2", "s4", "s5", "s6"), "missed"))


def replication(verdict: DataFrame) -> DataFrame:
    """(measure, first, second, k2_drop, outcome): a measure that passed in the first phase is replicated if it passes in the
    second, weakened if only its reliability became conditional, else lost; one that failed is untested."""
    side = lambda p, s: verdict.filter(F.col("phase") == p).select("measure", F.col("passed").alias(s), F.col("k2").alias(f"k2_{s}"), F.col("s2").alias(f"s2_{s}"))
    j = side(1, "first").join(side(2, "second"), "measure")
    outcome = F.when(~F.col("first"), "untested").when(~F.col("second"), "lost").when((F.col("s2_first") == "good") & (F.col("s2_second") == "conditional"), "weakened").otherwise("replicated")
    return j.select("measure", "first", "second", (F.col("k2_first") - F.col("k2_second")).alias("k2_drop"), outcome.alias("outcome"))


def split_halves(pub: DataFrame, reps: int = 50, seed: int = 42) -> DataFrame:
    """Every record in half 0 or 1 of each replicate, by hash; balanced in expectation, without sorting."""
    digit = F.conv(F.substring(draw_key(F.lit(seed), "rep", "uid"), 1, 1), 16, 10).cast("int")
    return replicates(pub, reps).withColumn("half", (digit % 2).cast("int"))


def split_half_reliability(values: DataFrame, value: str) -> DataFrame:
    """Spearman of the topics' values in both halves, stepped up by 2r / (1 + r), mean over replicates."""
    a = values.filter("half = 0").select("rep", *I.KEYS, F.col(value).alias("x"))
    b = values.filter("half = 1").select("rep", *I.KEYS, F.col(value).alias("y"))
    r = K.spearman(a.join(b, ["rep", *I.KEYS]), ["phase", "rep"], "x", "y", 5)
    return r.withColumn("sb", 2 * F.col("rho") / (1 + F.col("rho"))).groupBy("phase").agg(F.avg("sb").alias("reliability"), F.count("sb").alias("reps"))


def rarefied(pub: DataFrame, m: int = 25, reps: int = 30, seed: int = 42) -> DataFrame:
    """M records of each topic per replicate, those of smallest hash. Slices by hash are cut to m first, so no topic is sorted whole."""
    r = replicates(I.topics(pub), reps).withColumn("h", draw_key(F.lit(seed), "rep", "uid")).withColumn("part", F.substring("h", -2, 2))
    r = r.withColumn("k", F.row_number().over(Window.partitionBy(*I.KEYS, "rep", "part").orderBy("h", "uid"))).filter(F.col("k") <= m)
    return r.withColumn("k", F.row_number().over(Window.partitionBy(*I.KEYS, "rep").orderBy("h", "uid"))).filter(F.col("k") <= m).drop("k", "part", "h")


def bootstrap_rho(df: DataFrame, x: str, y: str, reps: int = 2000, seed: int = 42) -> DataFrame:
    """2.5 and 97.5 percentiles of Spearman's rho over resamples of topics with replacement."""
    n = df.groupBy("phase").agg(F.count(F.lit(1)).alias("n"))
    rows = df.withColumn("i", F.row_number().over(Window.partitionBy("phase").orderBy("topic"))).select("phase", "i", x, y)
    draws = replicates(df.select("phase", "topic").join(n, "phase"), reps).withColumn("i", (F.floor(uniform(F.lit(seed), "rep", "phase", "topic") * F.col("n")) + 1).cast("int"))
    r = K.spearman(draws.select("phase", "rep", "i").join(rows, ["phase", "i"]), ["phase", "rep"], x, y, 5)
    q = r.filter("rho IS NOT NULL").groupBy("phase").agg(F.percentile("rho", F.array(F.lit(0.025), F.lit(0.975))).alias("q"), F.count(F.lit(1)).alias("reps"))
    return q.select("phase", F.col("q")[0].alias("low"), F.col("q")[1].alias("high"), "reps")


def cross_validation_folds(df: DataFrame, size: str, folds: int = 5, repeats: int = 5, seed: int = 42) -> DataFrame:
    """A fold per topic and repeat, spread over terciles of ``size`` (by rank, ties by topic)."""
    w = Window.partitionBy("phase")
    t = df.withColumn("r", F.row_number().over(w.orderBy(size, "topic"))).withColumn("n", F.count(F.lit(1)).over(w))
    t = t.withColumn("tercile", F.when(F.col("r") <= F.col("n") / 3.0, 0).when(F.col("r") <= 2 * F.col("n") / 3.0, 1).otherwise(2)).drop("r", "n")
    return replicates(t, repeats, "repeat").withColumn("fold", F.pmod(F.row_number().over(Window.partitionBy("phase", "repeat", "tercile").orderBy(draw_key(F.lit(seed), "repeat", "topic"), "topic")), F.lit(folds)).cast("int"))


def random_weights(scored: DataFrame, reps: int = 1000, seed: int = 42) -> DataFrame:
    """Memberships with random weights of the dimensions (exponential, scaled to mean 1), class shares per replicate."""
    r = replicates(scored, reps)
    dims = list(I.DIMENSIONS)
    r = r.withColumns({f"w_{d}": -F.log(uniform(F.lit(seed), F.lit(d), "rep")) for d in dims})
    total = sum((F.col(f"w_{d}") for d in dims[1:]), F.col(f"w_{dims[0]}"))
    r = r.withColumns({d: F.col(d) * F.col(f"w_{d}") * len(dims) / total for d in dims})
    return I.memberships(r.drop(*[f"w_{d}" for d in dims]), keys=["phase", "rep"])


def residualised(df: DataFrame, x: str, size: str) -> DataFrame:
    """``x`` without what ln(size) explains, by least squares within the phase."""
    w = Window.partitionBy("phase")
    d = df.withColumn("_l", F.log(size))
    slope = F.covar_pop(x, "_l").over(w) / F.var_pop("_l").over(w)
    return d.withColumn(f"{x}_res", F.col(x) - F.avg(x).over(w) - slope * (F.col("_l") - F.avg("_l").over(w))).drop("_l")


def rank_sums(df: DataFrame, group: str, value: str, keys: list[str]) -> DataFrame:
    """Mann-Whitney U of group true against false and Cliff's delta, from average ranks."""
    a = K.avg_rank(df, keys, value).groupBy(*keys).agg(F.sum(F.when(F.col(group), F.col("rank"))).alias("rs"), F.count_if(F.col(group)).alias("n1"), F.count_if(~F.col(group)).alias("n0"))
    u = F.col("rs") - F.col("n1") * (F.col("n1") + 1) / 2.0
    return a.select(*keys, "n1", "n0", u.alias("u"), (2.0 * u / (F.col("n1") * F.col("n0")) - 1.0).alias("delta"))
