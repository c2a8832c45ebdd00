"""The sixteen topic indicators, their assembly, and dimension scores and memberships.

Groups are ``KEYS`` = (phase, topic). Each function takes the long table it needs and returns (phase, topic, value) with the documented
fallbacks; noise (topic -1) is left out where a topic is asked for and kept where the whole corpus counts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicweave.operators import kernels as K

KEYS = ["phase", "topic"]
FIRST_YEAR, LAST_YEAR = 2000, 2025
DIMENSIONS = {
    "EO": ["eo1", "eo2", "eo3"],
    "WN": ["pe1", "pe2", "pe3"],
    "EP": ["ds1", "ds2", "ds3"],
    "DI": ["di1", "di2", "di3", "di4"],
    "WP": ["ip1", "ip2", "ip3"],
}
CORE = ["EO", "WN", "EP", "DI"]
#: Indicators of an emerging concept.
EC = ("ds1", "ip1", "ip2", "ip3")
INDICATORS = [i for m in DIMENSIONS.values() for i in m]


def topics(df: DataFrame) -> DataFrame:
    return df.filter("topic >= 0")


def halves(df: DataFrame, keys: list[str] = KEYS) -> DataFrame:
    """``df`` with column half: 'early' up to the group's median year, 'late' after it. The median comes from counts by year."""
    median = df.filter("year IS NOT NULL").groupBy(*keys).agg(F.percentile("year", 0.5).alias("_m"))
    return df.filter("year IS NOT NULL").join(median, keys).withColumn("half", F.when(F.col("year") <= F.col("_m"), "early").otherwise("late")).drop("_m")


def keyword_volatility(pub: DataFrame, terms: DataFrame) -> DataFrame:
    """A1 EO1: Ruzicka distance of keyword frequencies, early against late half; null below 4 records or with an empty side."""
    n = topics(pub).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    median = topics(pub).filter("year IS NOT NULL").groupBy(*KEYS).agg(F.percentile("year", 0.5).alias("_m"))
    t = topics(terms).filter("year IS NOT NULL").join(median, KEYS).withColumn("half", F.when(F.col("year") <= F.col("_m"), "early").otherwise("late"))
    d = K.ruzicka(K.counts(t, [*KEYS, "half"], "term"), KEYS, "half", "early", "late", "term", "d")
    return n.join(d, KEYS, "left").select(*KEYS, F.when(F.col("n") >= 4, F.col("d")).alias("eo1"))


def normalised_entropy(terms: DataFrame, pub: DataFrame, out: str, least: int, below: float) -> DataFrame:
    """A2 EO2, A17 IP3: Shannon entropy over log2 of the number of terms; ``below`` under ``least`` entries, 0 for one term."""
    e = K.entropy(K.counts(topics(terms), KEYS, "term"), KEYS, "h")
    v = F.when(F.coalesce("total", F.lit(0)) < least, F.lit(below)).when(F.col("kinds") <= 1, F.lit(0.0)).otherwise(F.col("h") / F.log2("kinds"))
    return topics(pub).select(*KEYS).distinct().join(e, KEYS, "left").select(*KEYS, v.alias(out))


def semantic_incoherence(vectors: DataFrame) -> DataFrame:
    """A3 EO3 (kernel A14): 1 - mean pairwise cosine over all pairs, exact; 0.5 below 3 records."""
    c = K.pair_cosine(topics(vectors), KEYS, "embedding", "c")
    return c.select(*KEYS, F.when(F.col("n") < 3, F.lit(0.5)).otherwise(1.0 - F.col("c")).alias("eo3"))


def yearly_shares(pub: DataFrame) -> DataFrame:
    """B1 base: (phase, topic, year, n, share) over a dense year spine, shares of the topics' records of a year (noise out)."""
    return shares_of_years(topics(pub).filter("year IS NOT NULL").groupBy(*KEYS, "year").agg(F.count(F.lit(1)).alias("n")))


def shares_of_years(c: DataFrame) -> DataFrame:
    """The yearly shares from counts of records (phase, topic, year, n)."""
    total = c.groupBy("phase", "year").agg(F.sum("n").alias("total"))
    spine = c.select(*KEYS).distinct().join(total, "phase")
    return spine.join(c, [*KEYS, "year"], "left").select(*KEYS, "year", F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("total")).alias("share"))


def tem_metrics(shares: DataFrame) -> DataFrame:
    """B1: mean share over all years, growth between the first and last year with a share (compound, per year; 0 for one year)."""
    here = F.col("share") > 0
    a = shares.groupBy(*KEYS).agg(
        F.avg("share").alias("avg_share"),
        F.min(F.when(here, F.col("year"))).alias("y0"),
        F.max(F.when(here, F.col("year"))).alias("y1"),
        F.min_by(F.when(here, F.col("share")), F.when(here, F.col("year"))).alias("s0"),
        F.max_by(F.when(here, F.col("share")), F.when(here, F.col("year"))).alias("s1"),
    )
    span = F.col("y1") - F.col("y0")
    return a.select(*KEYS, "avg_share", F.when(span > 0, F.pow(F.col("s1") / F.col("s0"), 1.0 / span) - 1.0).otherwise(0.0).alias("growth"))


def relative_proportion(tem: DataFrame) -> DataFrame:
    """A4 PE1: 1 - average rank of the mean share / number of topics."""
    n = tem.groupBy("phase").agg(F.count(F.lit(1)).alias("topics"))
    return K.avg_rank(tem, ["phase"], "avg_share").join(n, "phase").select(*KEYS, (1.0 - F.col("rank") / F.col("topics")).alias("pe1"))


#: Topics whose centroids are sent to the tasks; more are refused. A distance falls into one of ``CELLS`` cells a unit.
MAX_TOPICS, CELLS = 100_000, 4096


def noise_ratio(vectors: DataFrame) -> DataFrame:
    """A5 PE2 (join J15): share of noise among the min(2n, N) records nearest to the topic's centroid; 0.5 below 3 records."""
    near = nearest_to_centroids(vectors, lambda n, corpus: F.least(2 * n, corpus))
    return near.select(*KEYS, F.when(F.col("n") < 3, F.lit(0.5)).otherwise(F.col("noise")).alias("pe2"))


def nearest_to_centroids(vectors: DataFrame, how_many) -> DataFrame:
    """(phase, topic, n, noise): the share of noise among the ``how_many(n, corpus)`` records nearest to the topic's centroid."""
    near = nearest_levels(vectors.withColumn("level", (F.col("topic") < 0).cast("int")), how_many)
    return near.groupBy(*KEYS, "n").agg((F.sum(F.col("level") * F.col("near")) / F.sum("near")).alias("noise"))


#: So many topics' distances are held at once.
TOPIC_BLOCK = 128


def nearest_levels(vectors: DataFrame, how_many) -> DataFrame:
    """(phase, topic, n, level, near): how many of the ``how_many(n, corpus)`` records nearest to the topic's centroid have each ``level``.

    Records meet centroids in the task that reads them, so distances, as many as records times topics, are never moved. A first
    pass sends counts by cell of distance, from which the cell that holds the k-th nearest is known; of a batch, cells behind
    its own k-th nearest cannot be that cell and are left out. A second pass sends the counts of nearer cells and, of that cell
    alone, the rows, which are ranked by distance and ``uid``. Products of matrices say which records can be that near; only
    their distances are computed. Centroids and cells are a row per topic, at most ``MAX_TOPICS``.
    """
    per = topics(vectors).select(*KEYS, F.posexplode("embedding").alias("dim", "x")).groupBy(*KEYS, "dim").agg(F.avg(F.col("x").cast("double")).alias("m"), F.count(F.lit(1)).alias("n"))
    cent = per.groupBy(*KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("dim", "m"))), lambda s: s["m"]).alias("centroid"), F.max("n").alias("n"))
    total = vectors.groupBy("phase").agg(F.count(F.lit(1)).alias("corpus"))
    rows = cent.join(total, "phase").withColumn("k", how_many(F.col("n"), F.col("corpus"))).limit(MAX_TOPICS + 1).collect()
    if len(rows) > MAX_TOPICS:
        raise ValueError(f"more than {MAX_TOPICS} topics")
    by_phase: dict[int, tuple] = {}
    for r in rows:
        by_phase.setdefault(r.phase, []).append((r.topic, r.k, r.centroid))
    by_phase = {p: (np.array([t for t, _, _ in x]), np.array([k for _, k, _ in x]), np.array([c for _, _, c in x])) for p, x in by_phase.items()}
    spark = vectors.sparkSession
    sizes = spark.createDataFrame([(r.phase, r.topic, r.n, r.k) for r in rows], "phase int, topic int, n long, k long")
    used = vectors.select("phase", "uid", "level", "embedding")

    def squares(pdf: pd.DataFrame) -> Iterator[tuple]:
        """(phase, rows, topic, k, squared distances about, their error, exact distances of chosen rows)."""
        for phase, rows in pdf.groupby("phase"):
            if phase not in by_phase:
                continue
            of, ks, cents = by_phase[phase]
            x = np.stack(rows["embedding"].to_numpy()).astype(float)
            xx = (x**2).sum(axis=1)
            for b in range(0, len(of), TOPIC_BLOCK):
                c = cents[b : b + TOPIC_BLOCK]
                cc = (c**2).sum(axis=1)
                about = cc[:, None] + xx[None, :] - 2.0 * (c @ x.T)
                error = 1e-9 * (1.0 + xx.max() + cc.max())
                for i in range(len(c)):
                    yield phase, rows, of[b + i], ks[b + i], about[i], error, lambda at, c=c[i], x=x: np.round(np.sqrt(((x[at] - c) ** 2).sum(axis=1)), 9)

    def frame(phase, parts: list[tuple], names: list[str]) -> pd.DataFrame:
        return pd.DataFrame({"phase": np.int32(phase), **{n: np.concatenate(x) for n, x in zip(names, zip(*parts, strict=True), strict=True)}})

    def in_frames(rows: Iterator[tuple], names: list[str]) -> Iterator[pd.DataFrame]:
        held, many, last = [], 0, None
        for phase, *part in rows:
            if held and (phase != last or many > 200_000):
                yield frame(last, held, names)
                held, many = [], 0
            last, many = phase, many + len(part[0])
            held.append(part)
        if held:
            yield frame(last, held, names)

    def counted(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for phase, _, topic, k, about, error, exact in squares(pdf):
                at = np.flatnonzero(about <= np.partition(about, k - 1)[k - 1] + error) if k < len(about) else np.arange(len(about))
                cells, c = np.unique(np.floor(exact(at) * CELLS).astype(np.int64), return_counts=True)
                yield phase, np.full(len(cells), topic, np.int32), cells, c

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_frames(counted(batches), ["topic", "cell", "c"])

    cells = used.mapInPandas(count, "phase int, topic int, cell long, c long").groupBy(*KEYS, "cell").agg(F.sum("c").alias("c"))
    upto = F.sum("c").over(Window.partitionBy(*KEYS).orderBy("cell").rowsBetween(Window.unboundedPreceding, 0))
    cells = cells.withColumn("upto", upto).join(sizes, KEYS)
    edges = cells.filter("upto >= k AND upto - c < k").select(*KEYS, "cell", (F.col("k") - F.col("upto") + F.col("c")).alias("missing")).collect()
    edge = {(r.phase, r.topic): r.cell for r in edges}

    def taken(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
        for pdf in batches:
            for phase, rows, topic, _, about, error, exact in squares(pdf):
                last = edge.get((phase, topic))
                if last is None:
                    continue
                at = np.flatnonzero(about <= ((last + 1) / CELLS + 1e-8) ** 2 + error)
                d = exact(at)
                cell = np.floor(d * CELLS).astype(np.int64)
                level = rows["level"].to_numpy()[at]
                sure, n = np.unique(level[cell < last], return_counts=True)
                here = cell == last
                m, e = len(sure), int(here.sum())
                if m + e:
                    uid = np.concatenate([np.full(m, None, object), rows["uid"].to_numpy()[at[here]]])
                    yield phase, np.full(m + e, topic, np.int32), np.concatenate([n, np.ones(e, np.int64)]), np.concatenate([sure, level[here]]), np.concatenate([np.full(m, np.nan), d[here]]), uid

    def take(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        yield from in_frames(taken(batches), ["topic", "near", "level", "d", "uid"])

    kept = used.mapInPandas(take, "phase int, topic int, near long, level int, d double, uid string")
    missing = spark.createDataFrame([(r.phase, r.topic, r.missing) for r in edges], "phase int, topic int, missing long")
    ranked = kept.filter("uid IS NOT NULL").join(missing, KEYS).withColumn("r", F.row_number().over(Window.partitionBy(*KEYS).orderBy("d", "uid"))).filter("r <= missing")
    near = kept.filter("uid IS NULL").select(*KEYS, "level", "near").unionByName(ranked.select(*KEYS, "level", "near"))
    return sizes.select(*KEYS, "n").join(near.groupBy(*KEYS, "level").agg(F.sum("near").alias("near")), KEYS)


def journal_specificity(pub: DataFrame) -> DataFrame:
    """A6 PE3: share of records in journals not larger than the median journal, sizes over the phase's whole corpus."""
    j = pub.filter("source_title IS NOT NULL AND source_title <> ''").groupBy("phase", "source_title").agg(F.count(F.lit(1)).alias("size"))
    m = j.groupBy("phase").agg(F.percentile("size", 0.5).alias("median"))
    j = j.join(m, "phase").withColumn("small", (F.col("size") <= F.col("median")).cast("double"))
    a = topics(pub).join(j, ["phase", "source_title"], "left").groupBy(*KEYS).agg(F.count("small").alias("n"), F.avg("small").alias("s"))
    return a.select(*KEYS, F.when(F.col("n") < 2, F.lit(0.5)).otherwise(F.col("s")).alias("pe3"))


def temporal_novelty(pub: DataFrame) -> DataFrame:
    """A7 DS1: (mean year - 2000) / 25 clipped; 0.5 without a year."""
    a = topics(pub).groupBy(*KEYS).agg(F.avg("year").alias("y"))
    return a.select(*KEYS, F.coalesce(F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("y") - FIRST_YEAR) / float(LAST_YEAR - FIRST_YEAR))), F.lit(0.5)).alias("ds1"))


def terminological_instability(pub: DataFrame, terms: DataFrame) -> DataFrame:
    """A8 DS2: mean Ruzicka distance of keywords over consecutive present years; null below 3 years or without a pair."""
    years = topics(pub).filter("year IS NOT NULL").select(*KEYS, "year").distinct()
    years = years.withColumn("next", F.lead("year").over(Window.partitionBy(*KEYS).orderBy("year")))
    n = years.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("years"))
    c = K.counts(topics(terms).filter("year IS NOT NULL"), [*KEYS, "year"], "term")
    pair = years.filter("next IS NOT NULL").select(*KEYS, F.col("year").alias("y0"), F.col("next").alias("y1"))
    a = c.withColumnRenamed("year", "y0").join(pair, [*KEYS, "y0"]).withColumn("side", F.lit("a"))
    b = c.withColumnRenamed("year", "y1").join(pair, [*KEYS, "y1"]).withColumn("side", F.lit("b"))
    d = K.ruzicka(a.unionByName(b), [*KEYS, "y0"], "side", "a", "b", "term", "d").filter("d IS NOT NULL").groupBy(*KEYS).agg(F.avg("d").alias("d"))
    return n.join(d, KEYS, "left").select(*KEYS, F.when(F.col("years") >= 3, F.col("d")).alias("ds2"))


def is_review(doc_type: Column) -> Column:
    """S10f: one of the packed types is 'review'."""
    return F.coalesce(F.exists(F.split(doc_type, r"[;|]"), lambda p: F.lower(F.trim(p)) == "review"), F.lit(False))


def review_absence(pub: DataFrame, alpha: float | Column = 5.0, prior: float | None = None) -> DataFrame:
    """A9 DS3: 1 - (r + 2αm) / (n + 2α) over records with a type, m the share of reviews of all topics of the phase or ``prior``."""
    return absence_of_reviews(review_counts(pub), alpha, prior)


def review_counts(pub: DataFrame) -> DataFrame:
    """(phase, topic, r, n): reviews among the records with a type."""
    p = topics(pub).withColumn("r", F.when(F.col("doc_type").isNotNull(), is_review(F.col("doc_type")).cast("double")))
    return p.groupBy(*KEYS).agg(F.coalesce(F.sum("r"), F.lit(0.0)).alias("r"), F.count("r").alias("n"))


def absence_of_reviews(a: DataFrame, alpha: float | Column = 5.0, prior: float | None = None) -> DataFrame:
    """The absence of reviews from their counts."""
    alpha = F.lit(alpha) if not isinstance(alpha, Column) else alpha
    a = a.join(a.groupBy("phase").agg(F.when(F.sum("n") > 0, F.sum("r") / F.sum("n")).alias("m")), "phase")
    m0 = F.lit(float(prior)) if prior is not None else F.coalesce("m", F.lit(0.5))
    return a.select(*KEYS, (1.0 - (F.col("r") + 2.0 * alpha * m0) / (F.col("n") + 2.0 * alpha)).alias("ds3"))


def author_key(author: Column, orcid: Column) -> Column:
    """S12f: the ORCID where it is complete, else the name in lower case with single blanks."""
    name = F.lower(F.regexp_replace(F.trim(author), r"\s+", " "))
    return F.when(orcid.rlike(r"^[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]$"), orcid).otherwise(name)


def mention_key(author: Column, orcid: Column) -> Column:
    """A10: who a mention counts for: the last part of the ORCID slot where one is given, else the name as written."""
    given = F.trim(F.element_at(F.split(orcid, "/"), -1))
    return F.when(F.length(given) > 0, given).otherwise(F.trim(author))


def author_concentration(authors: DataFrame) -> DataFrame:
    """A10 DI1: Gini of mentions per author, 1 below 2 mentions."""
    c = topics(authors).withColumn("a", mention_key(F.col("author"), F.col("orcid"))).filter("a IS NOT NULL AND a <> ''").groupBy(*KEYS, "a").agg(F.count(F.lit(1)).alias("n"))
    m = c.groupBy(*KEYS).agg(F.sum("n").alias("mentions"))
    g = K.gini(c, KEYS, "n", "g").join(m, KEYS)
    return g.select(*KEYS, F.when(F.col("mentions") < 2, F.lit(1.0)).otherwise(F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.col("g")))).alias("di1"))


def institutional_concentration(pub: DataFrame, inst: DataFrame) -> DataFrame:
    """A11 DI2: 1 / (1 + ln(1 + institutions / records)); 1 below 2 mentions."""
    n = topics(pub).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"))
    i = topics(inst).groupBy(*KEYS, "term").agg(F.count(F.lit(1)).alias("c")).groupBy(*KEYS).agg(F.count(F.lit(1)).alias("kinds"), F.sum("c").alias("mentions"))
    v = F.when(F.coalesce("mentions", F.lit(0)) < 2, F.lit(1.0)).otherwise(1.0 / (1.0 + F.log(1.0 + F.col("kinds") / F.col("n"))))
    return n.join(i, KEYS, "left").select(*KEYS, v.alias("di2"))


def geographic_concentration(pub: DataFrame, ctry: DataFrame) -> DataFrame:
    """A12 DI3: HHI of countries, each once per record; 1 below 2 mentions."""
    c = K.counts(topics(ctry).distinct(), KEYS, "term")
    h = K.hhi(c, KEYS, "h")
    base = topics(pub).select(*KEYS).distinct().join(h, KEYS, "left")
    return base.select(*KEYS, F.when(F.coalesce("total", F.lit(0)) < 2, F.lit(1.0)).otherwise(F.col("h")).alias("di3"))


def citation_rate(cites: Column, year: Column) -> Column:
    """Citations per year of age, the age at least 1 (2026 - year)."""
    return F.coalesce(cites, F.lit(0)) / F.greatest(F.lit(LAST_YEAR + 1) - year, F.lit(1))


def citation_concentration(pub: DataFrame) -> DataFrame:
    """A13 DI4: Gini of age-normalised citation rates; 0.5 below 3 records or without citations."""
    r = topics(pub).filter("year IS NOT NULL").withColumn("r", citation_rate(F.col("times_cited"), F.col("year")))
    return K.gini(r, KEYS, "r", "g").select(*KEYS, F.when(F.col("n") < 3, F.lit(0.5)).otherwise(F.col("g")).alias("di4"))


def growth_rate(tem: DataFrame) -> DataFrame:
    """A15 IP1: compound growth shifted and clipped, clip((g + 0.5) / 1.5, 0, 1)."""
    return tem.select(*KEYS, F.least(F.lit(1.0), F.greatest(F.lit(0.0), (F.col("growth") + 0.5) / 1.5)).alias("ip1"))


def citation_momentum(pub: DataFrame) -> DataFrame:
    """A16 IP2: late over early mean citation rate, clipped to 2 and halved; null below 4 records or with an empty half."""
    h = halves(topics(pub)).withColumn("r", citation_rate(F.col("times_cited"), F.col("year")))
    a = h.groupBy(*KEYS).agg(F.count(F.lit(1)).alias("n"), F.avg(F.when(F.col("half") == "early", F.col("r"))).alias("e"), F.avg(F.when(F.col("half") == "late", F.col("r"))).alias("l"))
    v = F.when((F.col("n") < 4) | F.col("e").isNull() | F.col("l").isNull(), None).when(F.col("e") == 0, F.when(F.col("l") > 0, F.lit(0.5)).otherwise(0.0)).otherwise(F.least(F.col("l") / F.col("e"), F.lit(2.0)) / 2.0)
    return a.select(*KEYS, v.alias("ip2"))


def all_indicators(parts: list[DataFrame]) -> DataFrame:
    """The indicators side by side; eo1, ds2 and ip2 take the phase's median where they are null, else 0.5.

    The parts are stacked and spread by one aggregation instead of fifteen joins.
    """
    names = [next(c for c in p.columns if c not in KEYS) for p in parts]
    long = None
    for p, n in zip(parts, names, strict=True):
        p = p.select(*KEYS, F.lit(n).alias("name"), F.col(n).cast("double").alias("value"))
        long = p if long is None else long.unionByName(p)
    out = long.groupBy(*KEYS).agg(*[F.max(F.when(F.col("name") == n, F.col("value"))).alias(n) for n in names])
    w = Window.partitionBy("phase")
    return out.withColumns({c: F.coalesce(c, F.percentile(c, 0.5).over(w), F.lit(0.5)) for c in ("eo1", "ds2", "ip2")})


def dimension_scores(ind: DataFrame, dimensions: dict[str, list[str]] = DIMENSIONS, least_sd: float = 0.01, keys: list[str] = ("phase",)) -> DataFrame:
    """Mean of the z-scores (population) of each dimension's indicators whose sample deviation exceeds ``least_sd``; 0 if none.

    ``keys`` group the standardisation: the phase, or also a variant or replicate.
    """
    w = Window.partitionBy(*keys)
    z = {i: F.when(F.stddev_samp(i).over(w) > least_sd, (F.col(i) - F.avg(i).over(w)) / F.stddev_pop(i).over(w)) for m in dimensions.values() for i in m}
    ind = ind.select("*", *[z[i].alias(f"z_{i}") for i in z])

    def mean(members: list[str]) -> Column:
        valid = F.array_compact(F.array(*[F.col(f"z_{i}") for i in members]))
        return F.when(F.size(valid) > 0, F.aggregate(valid, F.lit(0.0), lambda s, x: s + x) / F.size(valid)).otherwise(0.0)

    return ind.select(*[c for c in ind.columns if not c.startswith("z_")], *[mean(m).alias(d) for d, m in dimensions.items()])


def sigmoid(x: Column, k: float | Column = 1.0) -> Column:
    return 1.0 / (1.0 + F.exp(-k * x))


def memberships(dims: DataFrame, k: float | Column = 1.0, lam: float | Column = 0.5, keys: list[str] = ("phase",), ec: tuple[str, ...] = EC) -> DataFrame:
    """Four fuzzy memberships, their margin and the dominant class (ties: ws, trend, ec, latent).

    ``dims`` has the dimension scores and the indicators of ``ec``; all are standardised robustly within ``keys``. Weak signal:
    mean of the four core dimensions; trend: against it, with the weighted impact; emerging concept: mean of the ``ec``
    indicators; latent: against the mean of all five dimensions.
    """
    keys = list(keys)
    k = k if isinstance(k, Column) else F.lit(k)
    lam = lam if isinstance(lam, Column) else F.lit(lam)
    s = dims.withColumns({f"z_{c}": K.robust_z(c, keys) for c in [*DIMENSIONS, *ec]})
    z = lambda names: [F.col(f"z_{c}") for c in names]
    mean = lambda cols: sum(cols[1:], cols[0]) / float(len(cols))
    core = mean(z(CORE))
    s = s.withColumns({"m_ws": sigmoid(core, k), "m_trend": sigmoid(lam * F.col("z_WP") - core, k), "m_ec": sigmoid(mean(z(ec)), k), "m_latent": sigmoid(-mean(z([*CORE, "WP"])), k)})
    m = F.sort_array(F.array("m_ws", "m_trend", "m_ec", "m_latent"), asc=False)
    dom = K.dominant({"ws": "m_ws", "trend": "m_trend", "ec": "m_ec", "latent": "m_latent"})
    return s.withColumn("margin", m[0] - m[1]).withColumn("dominant", dom).drop(*[f"z_{c}" for c in [*DIMENSIONS, *ec]])
