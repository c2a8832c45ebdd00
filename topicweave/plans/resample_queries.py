"""Queries for grids, resampling, factor structure, clustering and the stream; SQL where the result is deterministic arithmetic."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F

from topicweave.functions import text as T
from topicweave.operators import cluster as L
from topicweave.operators import indicators as I
from topicweave.operators import kernels as K
from topicweave.operators import matching as M
from topicweave.operators import multivariate as N
from topicweave.operators import resample as S
from topicweave.operators.graph import reliable, shared_folder
from topicweave.plans import fixtures as X
from topicweave.plans.indicator_queries import DIM_SQL, MEM_SQL, TOPICS, W, classified, indicators16, query, rounded, scored
from topicweave.plans.validation_queries import _PAIR, _scores


def _base(spark, d):
    return reliable(scored(spark, d))


_GRID = [*DIM_SQL, "grid AS (SELECT * FROM (VALUES (0.5::DOUBLE), (1.0), (2.0)) a(k), (VALUES (0.3::DOUBLE), (0.5), (0.7)) b(lam))", *[c for c in MEM_SQL if c.startswith("rz5 ")],
         "gm AS (SELECT phase, topic, k, lam, 1 / (1 + exp(-k * (r_EO + r_WN + r_EP + r_DI) / 4)) AS m_ws, 1 / (1 + exp(-k * (lam * r_WP - (r_EO + r_WN + r_EP + r_DI) / 4))) AS m_trend, 1 / (1 + exp(-k * (r_ds1 + r_ip1 + r_ip2 + r_ip3) / 4)) AS m_ec, 1 / (1 + exp(k * (r_EO + r_WN + r_EP + r_DI + r_WP) / 5)) AS m_latent FROM rz5, grid)"]


@query("grid_k_lambda", W(*_GRID) + "SELECT phase, topic, k, lam, round(m_ws, 5) AS m_ws, round(m_trend, 5) AS m_trend, round(m_ec, 5) AS m_ec, round(m_latent, 5) AS m_latent FROM gm")
def _m9(spark, d):
    """M9."""
    return rounded(S.k_lambda_grid(_base(spark, d), spark).select("phase", "topic", "k", "lam", *S.MEMBERSHIPS), *S.MEMBERSHIPS, digits=5)


def _rho_sql(c: str) -> str:
    rank = lambda x: f"rank() OVER (PARTITION BY phase, k, lam ORDER BY {x}) + (count(*) OVER (PARTITION BY phase, k, lam, {x}) - 1) / 2.0"
    return f"{rank('round(' + c + ', 12)')} AS r_{c}, {rank('round(b_' + c + ', 12)')} AS s_{c}"


_GDOM = "CASE WHEN m_ws >= greatest(m_trend, m_ec, m_latent) THEN 'ws' WHEN m_trend >= greatest(m_ec, m_latent) THEN 'trend' WHEN m_ec >= m_latent THEN 'ec' ELSE 'latent' END"
_GST = [*_GRID, f"gd AS (SELECT *, {_GDOM} AS dominant, list_sort([m_ws, m_trend, m_ec, m_latent], 'DESC')[1] - list_sort([m_ws, m_trend, m_ec, m_latent], 'DESC')[2] AS margin FROM gm)",
        "gb AS (SELECT phase, topic, dominant AS b_dominant, margin AS b_margin, m_ws AS b_m_ws, m_trend AS b_m_trend, m_ec AS b_m_ec, m_latent AS b_m_latent FROM gd WHERE k = 1 AND lam = 0.5)", "gj AS (SELECT *, " + ", ".join(_rho_sql(c) for c in S.MEMBERSHIPS) + " FROM gd JOIN gb USING (phase, topic))"]


@query("grid_k_lambda_stability", W(*_GST) + "SELECT phase, k, lam, round(avg(CASE WHEN dominant <> b_dominant THEN 1.0 ELSE 0.0 END), 6) AS changed, round(avg(margin - b_margin), 6) AS margin_shift, " + ", ".join(f"round(CASE WHEN count(*) >= 5 THEN corr(r_{c}, s_{c}) END, 6) AS rho_{c}" for c in S.MEMBERSHIPS) + " FROM gj GROUP BY 1, 2, 3")
def _m16(spark, d):
    """Rank correlation of each cell with the base; the cell (1, 0.5) is the control and gives 1."""
    base = _base(spark, d)
    return rounded(S.compare(reliable(S.k_lambda_grid(base, spark)), reliable(I.memberships(base)), ["phase", "k", "lam"]))


@query("grid_prior_alpha", W(TOPICS, "rv AS (SELECT phase, topic, CASE WHEN doc_type IS NOT NULL THEN CAST(len(list_filter(string_split_regex(doc_type, '[;|]'), lambda p: lower(trim(p)) = 'review')) > 0 AS INT) END AS r FROM tp)", "pm AS (SELECT phase, avg(r) AS m FROM rv GROUP BY 1)")
       + "SELECT rv.phase, topic, alpha, round(1 - (sum(r) + 2 * alpha * any_value(m)) / (count(r) + 2 * alpha), 6) AS ds3 FROM rv JOIN pm USING (phase), (VALUES (2.0::DOUBLE), (5.0), (10.0)) a(alpha) GROUP BY 1, 2, 3")
def _m10(spark, d):
    """M10."""
    return rounded(S.alpha_grid(X.pub(spark, d), spark))


@query("grid_leave_one_out")
def _m12(spark, d):
    """M12."""
    ind = reliable(indicators16(spark, d))
    loo = reliable(S.leave_one_out(ind, spark))
    base = loo.filter("left_out = 'none'").drop("left_out")
    return rounded(S.compare(loo, base, ["phase", "left_out"]))


@query("grid_standardisation")
def _m20(spark, d):
    """M20."""
    out = reliable(S.standardisations(reliable(indicators16(spark, d)), spark))
    return rounded(S.compare(out, out.filter("variant = 'classic'").drop("variant"), ["phase", "variant"]))


@query("grid_hybrid_alpha", W(*_PAIR[:-2], "ga AS (SELECT ps.*, alpha, round(alpha * cosine + (1 - alpha) * jaccard, 9) AS h FROM ps, (VALUES (0.4::DOUBLE), (0.6), (0.8)) v(alpha))",
         "gb AS (SELECT *, row_number() OVER (PARTITION BY alpha, topic1 ORDER BY h DESC, topic2) AS r1, row_number() OVER (PARTITION BY alpha, topic2 ORDER BY h DESC, topic1) AS r2 FROM ga)")
       + "SELECT alpha, topic1, topic2 FROM gb WHERE r1 = 1 AND r2 = 1")
def _m15(spark, d):
    """Mutual best pairs for several mixtures; cosine and Jaccard are computed once."""
    from pyspark.sql import Window

    s = S.variants(_scores(spark, d), [{"alpha": a} for a in (0.4, 0.6, 0.8)], spark)
    s = s.withColumn("h", F.round(F.col("alpha") * F.col("cosine") + (1.0 - F.col("alpha")) * F.col("jaccard"), 9))
    s = s.withColumn("r1", F.row_number().over(Window.partitionBy("alpha", "topic1").orderBy(F.desc("h"), "topic2"))).withColumn("r2", F.row_number().over(Window.partitionBy("alpha", "topic2").orderBy(F.desc("h"), "topic1")))
    return s.filter("r1 = 1 AND r2 = 1").select("alpha", "topic1", "topic2")


@query("resample_perturbation")
def _m17(spark, d):
    """M17, V7."""
    ind = reliable(indicators16(spark, d))
    return rounded(S.flip_rates(S.perturbed(ind), I.memberships(I.dimension_scores(ind))))


@query("resample_null_model")
def _m18(spark, d):
    """M18, M19, M29."""
    return rounded(S.null_model(reliable(indicators16(spark, d))))


@query("resample_null_model_blocks")
def _m18b(spark, d):
    """M18 with the indicators of a dimension permuted together."""
    return rounded(S.null_model(reliable(indicators16(spark, d)), blocks=I.DIMENSIONS))


@query("resample_time_permutation")
def _c13(spark, d):
    """C13."""
    p = X.pub(spark, d)
    return rounded(S.time_permutation_ses(p, X.terms(p, "kw")))


@query("resample_time_permutation_years")
def _c13y(spark, d):
    """DS2_A1, from the keywords of neighbouring years."""
    p = X.pub(spark, d)
    return rounded(S.time_permutation_ses(p, X.terms(p, "kw"), mode="years", out="ds2_a1"))


@query("resample_time_permutation_phrases")
def _c13p(spark, d):
    """DS2_A2, from the phrases of title and abstract."""
    from topicweave.plans.prepare_queries import STOP

    p = X.pub(spark, d).withColumn("row", F.col("row_id"))
    # the texts of all deliveries, under the topic each has itself: they are moved once, and the newest picked where they meet the records
    texts = X.topic_of(X.table(spark, d, "publications")).select(*I.KEYS, F.col("row_id").alias("row"), T.marked(F.concat_ws(" | ", "title", "abstract")).alias("text"))
    return rounded(S.phrase_permutation_ses(p, texts, STOP))


@query("resample_class_shares")
def _m19(spark, d):
    """M19."""
    return rounded(S.class_shares_against_null(reliable(indicators16(spark, d))))


def _measures(df, keys):
    """Means over records that serve as measures here: citations, rate of citations, vitality, single country, review."""
    age = F.greatest(F.lit(2026) - F.col("year"), F.lit(1))
    a = df.groupBy(*keys).agg(
        F.avg(F.col("times_cited").cast("double")).alias("citations"), F.avg(F.col("times_cited") / age).alias("rate"), F.avg(1.0 / age).alias("vitality"),
        F.avg((F.col("country_count") == 1).cast("double")).alias("single_country"), F.avg(I.is_review(F.col("doc_type")).cast("double")).alias("review"))
    return a.unpivot(keys, ["citations", "rate", "vitality", "single_country", "review"], "measure", "value")


def _criteria(spark, d):
    p = I.topics(X.pub(spark, d)).select("uid", *I.KEYS, "year", "times_cited", "country_count", "doc_type")
    p = reliable(p)
    halves = _measures(S.split_halves(p), ["rep", "half", *I.KEYS]).withColumn("sample", F.when(F.col("half") == 0, "half_a").otherwise("half_b")).drop("half")
    rare = _measures(S.rarefied(p.select("uid", *I.KEYS)).join(p, ["uid", *I.KEYS]), ["rep", *I.KEYS]).withColumn("sample", F.lit("rare"))
    # permuted: topics are drawn anew among the records of a phase, sizes kept in expectation
    n = p.groupBy("phase").agg(F.count(F.lit(1)).alias("n"))
    spans = p.groupBy(*I.KEYS).agg(F.count(F.lit(1)).alias("k")).join(n, "phase")
    from pyspark.sql import Window

    w = Window.partitionBy("phase").orderBy("topic").rowsBetween(Window.unboundedPreceding, 0)  # a row per topic
    spans = spans.withColumn("to", F.sum("k").over(w) / F.col("n")).groupBy("phase").agg(F.sort_array(F.collect_list(F.struct("to", "topic"))).alias("ends"))
    drawn = S.replicates(p, 20).withColumn("u", S.uniform(F.lit(7), "rep", "uid")).join(spans, "phase")
    drawn = drawn.withColumn("topic", F.get(F.filter("ends", lambda e: F.col("u") <= e["to"]), F.lit(0))["topic"]).drop("ends", "u").filter("topic IS NOT NULL")
    null = _measures(drawn, ["rep", *I.KEYS]).withColumn("sample", F.lit("null"))
    ref = _measures(p, I.KEYS).withColumn("rep", F.lit(0)).withColumn("sample", F.lit("ref"))
    values = reliable(ref.unionByName(halves).unionByName(rare).unionByName(null))
    return S.verdicts(S.criteria(values, p.groupBy(*I.KEYS).agg(F.log(F.count(F.lit(1))).alias("ln_n"))))


@query("resample_criteria")
def _c23(spark, d):
    """Reliability, dependence on size, null model and redundancy of five measures, and their status."""
    return rounded(_criteria(spark, d))


@query("resample_replication")
def _p19(spark, d):
    """Which measures that passed in the first phase pass in the second."""
    return rounded(S.replication(_criteria(spark, d)))


_HALF = [TOPICS, "sh2 AS (SELECT phase, topic, rep, ('0x' || substr(md5(concat_ws('|', 42, rep, uid)), 1, 1))::INT % 2 AS half, avg(CAST(times_cited AS DOUBLE)) AS v FROM tp, (SELECT unnest(range(1, 51)) AS rep) GROUP BY ALL)", "hp AS (SELECT a.phase, a.rep, a.v AS x, b.v AS y FROM sh2 a JOIN sh2 b ON a.phase = b.phase AND a.topic = b.topic AND a.rep = b.rep WHERE a.half = 0 AND b.half = 1 AND a.v IS NOT NULL AND b.v IS NOT NULL)",
         "hr AS (SELECT phase, rep, rank() OVER (PARTITION BY phase, rep ORDER BY x) + (count(*) OVER (PARTITION BY phase, rep, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY phase, rep ORDER BY y) + (count(*) OVER (PARTITION BY phase, rep, y) - 1) / 2.0 AS ry FROM hp)", "hc AS (SELECT phase, rep, CASE WHEN count(*) >= 5 THEN corr(rx, ry) END AS rho FROM hr GROUP BY 1, 2)"]


@query("resample_split_half", W(*_HALF) + "SELECT phase, round(avg(2 * rho / (1 + rho)), 6) AS reliability, count(rho) AS reps FROM hc GROUP BY 1")
def _m22(spark, d):
    """Reliability of the mean citations of topics over split halves."""
    h = S.split_halves(X.pub(spark, d)).filter("topic >= 0").groupBy("rep", "half", *I.KEYS).agg(F.avg(F.col("times_cited").cast("double")).alias("v"))
    return rounded(S.split_half_reliability(h, "v"))


@query("resample_rarefaction", W(TOPICS, X.terms_sql("kw"), "rd AS (SELECT phase, topic, uid, rep, row_number() OVER (PARTITION BY phase, topic, rep ORDER BY md5(concat_ws('|', 42, rep, uid)), uid) AS k FROM tp, (SELECT unnest(range(1, 31)) AS rep))", "rk AS (SELECT rd.phase, rd.topic, rep, count(DISTINCT term) AS k FROM rd JOIN kw USING (uid) WHERE k <= 25 GROUP BY 1, 2, 3)") + "SELECT phase, topic, round(avg(k), 6) AS keywords, count(*) AS reps FROM rk GROUP BY 1, 2")
def _m22b(spark, d):
    """Mean number of different keywords of 25 records."""
    p = X.pub(spark, d)
    r = S.rarefied(p.select("uid", *I.KEYS), 25)
    kinds = r.join(X.terms(p, "kw", ["uid"]), "uid").groupBy(*I.KEYS, "rep").agg(F.countDistinct("term").alias("k"))
    return rounded(kinds.groupBy(*I.KEYS).agg(F.avg("k").alias("keywords"), F.count(F.lit(1)).alias("reps")))


@query("resample_bootstrap")
def _c22(spark, d):
    """Interval of the correlation of citations per record with the logarithm of the size."""
    t = I.topics(X.pub(spark, d)).groupBy(*I.KEYS).agg(F.avg(F.col("times_cited").cast("double")).alias("x"), F.log(F.count(F.lit(1))).alias("ln_n"))
    return rounded(S.bootstrap_rho(reliable(t), "x", "ln_n"))


@query("resample_folds", W(TOPICS, "fs AS (SELECT phase, topic, count(*) AS size FROM tp GROUP BY 1, 2)", "ft AS (SELECT phase, topic, row_number() OVER (PARTITION BY phase ORDER BY size, topic) AS r, count(*) OVER (PARTITION BY phase) AS n FROM fs)",
         "fu AS (SELECT phase, topic, repeat, CASE WHEN r <= n / 3.0 THEN 0 WHEN r <= 2 * n / 3.0 THEN 1 ELSE 2 END AS tercile FROM ft, (SELECT unnest(range(1, 6)) AS repeat))") + "SELECT phase, topic, CAST(repeat AS INT) AS repeat, tercile, CAST(row_number() OVER (PARTITION BY phase, repeat, tercile ORDER BY md5(concat_ws('|', 42, repeat, topic)), topic) % 5 AS INT) AS fold FROM fu")
def _c26(spark, d):
    """C26, W13."""
    t = I.topics(X.pub(spark, d)).groupBy(*I.KEYS).agg(F.count(F.lit(1)).alias("n"))
    return S.cross_validation_folds(t, "n").select(*I.KEYS, "repeat", "tercile", "fold")


@query("resample_random_weights")
def _m24(spark, d):
    """Shares of the classes over random weights."""
    r = S.random_weights(_base(spark, d))
    return rounded(r.groupBy(*I.KEYS, "dominant").agg((F.count(F.lit(1)) / 1000.0).alias("share")))


@query("valid_residualised", W(TOPICS, "t AS (SELECT phase, topic, avg(CAST(times_cited AS DOUBLE)) AS x, ln(count(*)) AS l FROM tp GROUP BY 1, 2)", "c AS (SELECT phase, regr_slope(x, l) AS b, avg(x) AS mx, avg(l) AS ml FROM t GROUP BY 1)") + "SELECT t.phase, topic, round(x - mx - b * (l - ml), 6) AS x_res FROM t JOIN c USING (phase)")
def _m25(spark, d):
    """M25."""
    t = I.topics(X.pub(spark, d)).groupBy(*I.KEYS).agg(F.avg(F.col("times_cited").cast("double")).alias("x"), F.count(F.lit(1)).alias("n"))
    return rounded(S.residualised(t, "x", "n").select(*I.KEYS, "x_res"))


@query("valid_rank_sum", W(TOPICS, "r AS (SELECT phase, coalesce(len(list_filter(string_split_regex(doc_type, '[;|]'), lambda p: lower(trim(p)) = 'review')) > 0, false) AS g, rank() OVER (PARTITION BY phase ORDER BY times_cited) + (count(*) OVER (PARTITION BY phase, times_cited) - 1) / 2.0 AS k FROM tp WHERE times_cited IS NOT NULL)",
         "s AS (SELECT phase, sum(k) FILTER (g) - count(*) FILTER (g) * (count(*) FILTER (g) + 1) / 2.0 AS u, count(*) FILTER (g) AS n1, count(*) FILTER (NOT g) AS n0 FROM r GROUP BY 1)") + "SELECT phase, n1, n0, round(u, 6) AS u, round(2 * u / (n1 * n0) - 1, 6) AS delta FROM s")
def _c27(spark, d):
    """Citations of reviews against other records."""
    p = I.topics(X.pub(spark, d)).filter("times_cited IS NOT NULL").withColumn("g", I.is_review(F.col("doc_type")))
    return rounded(S.rank_sums(p, "g", "times_cited", ["phase"]))


@query("set_mixture_metamorphic", W(X.terms_sql("cat"), "mc AS (SELECT phase, topic, term, count(*) AS n FROM cat WHERE topic >= 0 GROUP BY 1, 2, 3)", "mo AS (SELECT phase, topic, sum(n) AS total, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS h FROM mc GROUP BY 1, 2)", "mp AS (SELECT phase, CAST(floor(topic / 2) AS INT) AS topic, term, sum(n) AS n FROM mc GROUP BY 1, 2, 3)",
         "mh AS (SELECT phase, topic, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS merged FROM mp GROUP BY 1, 2)", "mw AS (SELECT phase, CAST(floor(topic / 2) AS INT) AS topic, sum(h * total) / sum(total) AS parts FROM mo GROUP BY 1, 2)") + "SELECT phase, topic, round(merged, 6) AS merged, round(parts, 6) AS parts, merged >= parts - 1e-9 AS rises FROM mh JOIN mw USING (phase, topic)")
def _c28(spark, d):
    """Topics merged in pairs have at least about the mean diversity of their parts."""
    t = X.terms(X.pub(spark, d), "cat").filter("topic >= 0")
    one = K.entropy(K.counts(t, I.KEYS, "term"), I.KEYS, "h").select(*I.KEYS, "total", "h")
    pair = K.entropy(K.counts(t.withColumn("topic", F.floor(F.col("topic") / 2).cast("int")), I.KEYS, "term"), I.KEYS, "merged").select(*I.KEYS, "merged")
    parts = one.groupBy("phase", F.floor(F.col("topic") / 2).cast("int").alias("topic")).agg((F.sum(F.col("h") * F.col("total")) / F.sum("total")).alias("parts"))
    return rounded(pair.join(parts, I.KEYS).withColumn("rises", F.col("merged") >= F.col("parts") - 1e-9))


# --- factor structure: a few numbers of a table with a row per topic
@query("multi_factor_adequacy")
def _m5(spark, d):
    """Adequacy of the correlations of the indicators over the topics of both phases, retained factors, effective number."""
    cols, x = N.matrix(indicators16(spark, d), I.INDICATORS)
    r = N.correlation(x)
    chi, df, p = N.bartlett(r, len(x))
    _, _, kept = N.parallel_analysis(x)
    row = (len(x), len(cols), N.kmo(r), chi, df, p, kept, N.effective_number(r))
    return spark.createDataFrame([tuple(float(v) if isinstance(v, float) else int(v) for v in row)], "topics int, columns int, kmo double, chi2 double, df int, p double, factors int, effective double")


@query("multi_factor_loadings")
def _m4(spark, d):
    """Of the indicators that vary, the pattern of two correlated factors (principal axis and direct quartimin) and communalities."""
    cols, x = N.matrix(indicators16(spark, d), I.INDICATORS)
    load = N.principal_axis(N.correlation(x), 2)
    pattern, phi = N.oblimin(load)
    h2 = ((pattern @ phi) * pattern).sum(axis=1)
    pdf = pd.DataFrame({"indicator": cols, "f1": pattern[:, 0], "f2": pattern[:, 1], "communality": h2})
    return spark.createDataFrame(pdf)


@query("multi_components")
def _m7(spark, d):
    """M7: explained variance of the principal components."""
    _, x = N.matrix(indicators16(spark, d), I.INDICATORS)
    share, _ = N.pca(x)
    return spark.createDataFrame(pd.DataFrame({"component": range(1, len(share) + 1), "share": share}))


@query("multi_theory_coherence")
def _m8(spark, d):
    """M8: share of a dimension's indicators on its most common factor, of as many factors as parallel analysis keeps (at least two)."""
    cols, x = N.matrix(indicators16(spark, d), I.INDICATORS)
    _, _, kept = N.parallel_analysis(x)
    pattern, _ = N.oblimin(N.principal_axis(N.correlation(x), max(2, kept)))
    return spark.createDataFrame(N.theory_coherence(pattern, cols, I.DIMENSIONS), "dimension string, indicators int, share double, verdict string")


@query("multi_own_shares")
def _m26(spark, d):
    """Share of each indicator's variance that no other explains."""
    cols, x = N.matrix(indicators16(spark, d), I.INDICATORS)
    return rounded(spark.createDataFrame(pd.DataFrame({"indicator": cols, "own_share": N.own_shares(N.correlation(x))})))


@query("cluster_density")
def _m3(spark, d):
    """M2, M3: density clusters of the projected embeddings, and their agreement with the labels."""
    e = X.table(spark, d, "embeddings")
    found = L.density_clusters(L.project(e, "vec_id", "embedding", 8), "vec_id", "reduced", k=8, least=10)
    return rounded(M.label_agreement(found.join(e.select("vec_id", "label"), "vec_id").filter("cluster >= 0 OR cluster < -1"), "label", "cluster"))


@query("stream_yearly_counts", W(TOPICS) + "SELECT phase, topic, year, count(*) AS n FROM tp WHERE year IS NOT NULL GROUP BY 1, 2, 3")
def _stream(spark, d):
    """Extension (B1's counts from a stream): the newest deliveries read as a stream, all available rows, counts complete."""
    from topicweave.streaming.yearly import yearly_counts

    folder = _stream_input(spark, d)
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)
    name = f"yearly_{abs(hash(folder))}"
    q = yearly_counts(stream).writeStream.outputMode("complete").format("memory").queryName(name).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.table(name).select(*I.KEYS, "year", "n")


def _stream_input(spark, d) -> str:
    """The newest deliveries as a table in the shared folder."""
    import uuid

    folder = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    X.pub(spark, d).select("uid", "phase", "topic", F.col("year").cast("int").alias("year"), "loaded_at").write.parquet(folder)
    return folder
