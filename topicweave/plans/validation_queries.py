"""Queries and SQL for temporal, matching and validation operators, joins, windows, top-k and sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicweave.functions import text as T
from topicweave.operators import indicators as I
from topicweave.operators import kernels as K
from topicweave.operators import matching as M
from topicweave.operators import temporal as P
from topicweave.operators import validation as V
from topicweave.operators.graph import reliable
from topicweave.plans import fixtures as X
from topicweave.plans.prepare_queries import TEXT_SQL
from topicweave.plans.indicator_queries import IND_SQL, MEM_SQL, RATE, TOPICS, W, classified, indicators16, query, rounded

_SHN = """sn AS (SELECT s.phase, s.topic, y.year, coalesce(n, 0) / CAST(total AS DOUBLE) AS share FROM (SELECT DISTINCT phase, topic FROM pub WHERE topic >= 0 AND year IS NOT NULL) s
 JOIN (SELECT phase, year, count(*) AS total FROM pub WHERE year IS NOT NULL GROUP BY 1, 2) y ON y.phase = s.phase
 LEFT JOIN (SELECT phase, topic, year, count(*) AS n FROM pub WHERE year IS NOT NULL GROUP BY 1, 2, 3) c ON c.phase = s.phase AND c.topic = s.topic AND c.year = y.year)"""


@query("temporal_proportions", W(_SHN) + "SELECT phase, topic, year, round(share, 6) AS share FROM sn")
def _b2(spark, d):
    return rounded(P.proportions_with_noise(X.pub(spark, d)))


_OLS = "ols AS (SELECT phase, topic, count(*) AS years, avg(share) AS m, max(share) AS top, CASE WHEN count(*) > 1 AND avg(share) > 0 THEN coalesce(regr_slope(share, year) / avg(share), 0) ELSE 0 END AS ols_growth FROM sn GROUP BY 1, 2)"
_HALF = "hs AS (SELECT *, row_number() OVER (PARTITION BY phase, topic ORDER BY year) AS i, count(*) OVER (PARTITION BY phase, topic) AS n FROM sn), hg AS (SELECT phase, topic, CASE WHEN max(n) >= 4 AND median(share) FILTER (i <= n // 2) > 0 THEN (median(share) FILTER (i > n - n // 2) - median(share) FILTER (i <= n // 2)) / median(share) FILTER (i <= n // 2) ELSE 0.0 END AS half_growth FROM hs GROUP BY 1, 2)"


@query("temporal_growth", W(_SHN, _OLS, _HALF) + "SELECT phase, topic, years, round(m, 6) AS m, round(top, 6) AS top, round(ols_growth, 6) AS ols_growth, round(half_growth, 6) AS half_growth FROM ols JOIN hg USING (phase, topic)")
def _b5(spark, d):
    """B3-B5, W14."""
    s = reliable(P.proportions_with_noise(X.pub(spark, d)))
    return rounded(P.linear_growth(s).join(P.half_split_growth(s), I.KEYS))


def _edge_sql(name: str, where: str) -> list[str]:
    src = f"{name}_s"
    here = "FILTER (share > 0)"
    return [f"{src} AS (SELECT sn.* FROM sn JOIN (SELECT phase, max(year) AS last FROM sn GROUP BY 1) l USING (phase) WHERE {where})", f"{name}_h AS (SELECT *, row_number() OVER (PARTITION BY phase, topic ORDER BY year) AS i, count(*) OVER (PARTITION BY phase, topic) AS n FROM {src})",
            f"""{name} AS (SELECT phase, topic, CASE WHEN max(year) {here} > min(year) {here} THEN pow(max_by(share, year) {here} / min_by(share, year) {here}, 1.0 / (max(year) {here} - min(year) {here})) - 1 ELSE 0.0 END AS cagr,
 CASE WHEN count(*) > 1 AND avg(share) > 0 THEN coalesce(regr_slope(share, year) / avg(share), 0) ELSE 0 END AS ols, CASE WHEN max(n) >= 4 AND median(share) FILTER (i <= n // 2) > 0 THEN (median(share) FILTER (i > n - n // 2) - median(share) FILTER (i <= n // 2)) / median(share) FILTER (i <= n // 2) ELSE 0.0 END AS half FROM {name}_h GROUP BY 1, 2)"""]  # fmt: skip


_EDGE = [_SHN, *_edge_sql("ef", "true"), *_edge_sql("ec", "year < last"), "el AS (SELECT ef.phase, e.estimator, round(e.x, 9) AS x, round(e.y, 9) AS y FROM ef JOIN ec ON ef.phase = ec.phase AND ef.topic = ec.topic, LATERAL (VALUES ('cagr', ef.cagr, ec.cagr), ('ols', ef.ols, ec.ols), ('half', ef.half, ec.half)) e(estimator, x, y))",
         "er AS (SELECT *, rank() OVER (PARTITION BY phase, estimator ORDER BY x) + (count(*) OVER (PARTITION BY phase, estimator, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY phase, estimator ORDER BY y) + (count(*) OVER (PARTITION BY phase, estimator, y) - 1) / 2.0 AS ry FROM el)"]


@query("temporal_right_edge", W(*_EDGE) + "SELECT phase, estimator, count(*) AS n, round(CASE WHEN count(*) >= 5 THEN corr(rx, ry) END, 6) AS rho, coalesce(CASE WHEN count(*) >= 5 THEN corr(rx, ry) END > 0.9, false) AS stable FROM er GROUP BY 1, 2")
def _b6(spark, d):
    """Three estimates of growth with and without the last year, and the rank correlation of both."""
    s = reliable(P.proportions_with_noise(X.pub(spark, d)))
    last = s.groupBy("phase").agg(F.max("year").alias("last"))

    def growth(shares, suffix):
        a = I.tem_metrics(shares).select(*I.KEYS, F.col("growth").alias("cagr"))
        a = a.join(P.linear_growth(shares).select(*I.KEYS, F.col("ols_growth").alias("ols")), I.KEYS).join(P.half_split_growth(shares).select(*I.KEYS, F.col("half_growth").alias("half")), I.KEYS)
        return a.unpivot([*I.KEYS], ["cagr", "ols", "half"], "estimator", suffix).withColumn(suffix, F.round(suffix, 9))

    both = growth(s, "x").join(growth(s.join(last, "phase").filter("year < last").drop("last"), "y"), [*I.KEYS, "estimator"])
    return rounded(K.spearman(both, ["phase", "estimator"], "x", "y", 5)).withColumn("stable", F.coalesce(F.col("rho") > 0.9, F.lit(False)))


@query("temporal_partial_years", W("y AS (SELECT year, count(*) AS n FROM pub WHERE year IS NOT NULL GROUP BY 1)", "z AS (SELECT *, row_number() OVER (ORDER BY year) AS i, count(*) OVER () AS k, median(n) OVER (ORDER BY year ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS before FROM y)")
       + "SELECT 'all' AS corpus, threshold, year, n, before FROM z, (VALUES (0.6::DOUBLE), (1.5)) t(threshold) WHERE i > 3 AND i > k - 4 AND n < threshold * before")
def _p13(spark, d):
    """P13, W5 at the default of 0.6, and at 1.5, so that the test tables have cases."""
    y = X.pub(spark, d).filter("year IS NOT NULL").groupBy(F.lit("all").alias("corpus"), "year").agg(F.count(F.lit(1)).alias("n"))
    at = lambda t: P.partial_years(y, ["corpus"], t).withColumn("threshold", F.lit(t))
    return at(0.6).unionByName(at(1.5))


@query("temporal_phase_splits", "WITH " + X.PUB + " SELECT CAST(s AS INT) AS split_year, count(*) FILTER (year <= s) AS until, count(*) FILTER (year > s) AS after FROM pub, (SELECT unnest([2013, 2014, 2015, 2016, 2017]) AS s) WHERE year IS NOT NULL GROUP BY 1")
def _p14(spark, d):
    return P.phase_splits(X.pub(spark, d), [2013, 2014, 2015, 2016, 2017])


@query("temporal_latency_mask", "WITH " + X.PUB + " SELECT phase, count(*) AS n, count(*) FILTER (year <= (SELECT max(year) FROM pub) - 0.5) AS kept FROM pub WHERE year IS NOT NULL GROUP BY 1")
def _p15(spark, d):
    p = X.pub(spark, d).filter("year IS NOT NULL")
    last = p.agg(F.max("year").alias("last"))
    return p.join(last).groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("year") <= F.col("last") - 6 / 12).alias("kept"))


@query("temporal_per_year", "WITH " + X.PUB + " SELECT year, count(*) AS n FROM pub WHERE year IS NOT NULL GROUP BY 1")
def _v11(spark, d):
    return X.pub(spark, d).filter("year IS NOT NULL").groupBy("year").agg(F.count(F.lit(1)).alias("n"))


# --- joins over labels: two labelings of the records, by the macro and by the meso level of their citation topic
_LAB = "lab AS (SELECT uid, phase, topic AS old, CASE WHEN coalesce(regexp_extract(ct_meso, '^[0-9]+[.]([0-9]+) ', 1), '') = '' THEN -1 ELSE topic * 1000 + CAST(regexp_extract(ct_meso, '^[0-9]+[.]([0-9]+) ', 1) AS INT) END AS new FROM pub)"


def _labels(spark, d):
    p = X.pub(spark, d)
    meso = F.coalesce(F.regexp_extract("ct_meso", "^[0-9]+[.]([0-9]+) ", 1), F.lit(""))
    return p.select("uid", "phase", F.col("topic").alias("old"), F.when(meso == "", -1).otherwise(F.col("topic") * 1000 + meso.cast("int")).cast("int").alias("new"))


_JAC = "j AS (SELECT old, new, c / CAST(na + nb - c AS DOUBLE) AS jaccard FROM (SELECT old, new, count(*) AS c FROM lab GROUP BY 1, 2) JOIN (SELECT old, count(*) AS na FROM lab GROUP BY 1) USING (old) JOIN (SELECT new, count(*) AS nb FROM lab GROUP BY 1) USING (new))"


@query("join_overlap_match", W(_LAB, _JAC) + "SELECT new, old, round(jaccard, 6) AS jaccard FROM (SELECT *, row_number() OVER (PARTITION BY new ORDER BY jaccard DESC, old) AS k FROM j WHERE old >= 0 AND new >= 0) WHERE k = 1 AND jaccard >= 0.05")
def _j8(spark, d):
    """J8-J10."""
    return rounded(M.overlap_matches(_labels(spark, d), "uid", "old", "new"))


@query("join_clusterwise_stability", W(_LAB, "jp AS (SELECT phase, old, new, c / CAST(na + nb - c AS DOUBLE) AS j FROM (SELECT phase, old, new, count(*) AS c FROM lab GROUP BY 1, 2, 3) JOIN (SELECT phase, old, count(*) AS na FROM lab GROUP BY 1, 2) USING (phase, old) JOIN (SELECT phase, new, count(*) AS nb FROM lab GROUP BY 1, 2) USING (phase, new))")
       + "SELECT old, round(avg(b), 6) AS stability FROM (SELECT phase, old, max(j) AS b FROM jp GROUP BY 1, 2) GROUP BY 1")
def _j11(spark, d):
    return rounded(M.clusterwise_stability(_labels(spark, d), "uid", "old", "new", "phase"))


_AGREE = [_LAB, "lc AS (SELECT old, new, CAST(count(*) AS DOUBLE) AS n FROM lab GROUP BY 1, 2)", "la AS (SELECT sum(n * (n - 1) / 2) AS i, sum(n * ln(n)) AS hi FROM (SELECT old, sum(n) AS n FROM lc GROUP BY 1))", "lb AS (SELECT sum(n * (n - 1) / 2) AS j, sum(n * ln(n)) AS hj FROM (SELECT new, sum(n) AS n FROM lc GROUP BY 1))",
          "lt AS (SELECT sum(n * (n - 1) / 2) AS ij, sum(n * ln(n)) AS hij, sum(n) AS t FROM lc)", "lh AS (SELECT (ij - i * j / (t * (t - 1) / 2)) / ((i + j) / 2 - i * j / (t * (t - 1) / 2)) AS ari, 1 - ((hj - hij) / t) / (ln(t) - hi / t) AS homogeneity, 1 - ((hi - hij) / t) / (ln(t) - hj / t) AS completeness FROM lt, la, lb)"]


@query("valid_label_agreement", W(*_AGREE) + "SELECT round(ari, 6) AS ari, round(homogeneity, 6) AS homogeneity, round(completeness, 6) AS completeness, round(2 * homogeneity * completeness / (homogeneity + completeness), 6) AS v_measure FROM lh")
def _m14(spark, d):
    """M14."""
    return rounded(M.label_agreement(_labels(spark, d), "old", "new"))


_CROSS = "rep AS (SELECT new, sum(c) AS members, max(c) FILTER (old = -1) AS noise, count(*) FILTER (old >= 0) AS kinds, max(c) FILTER (old >= 0) AS most FROM (SELECT old, new, count(*) AS c FROM lab WHERE new >= 0 GROUP BY 1, 2) GROUP BY 1)"


@query("join_overlap_report", W(_LAB, _CROSS) + "SELECT new, CAST(members AS BIGINT) AS members, coalesce(noise, 0) AS noise, kinds, round(most / CAST(members AS DOUBLE), 6) AS best_share FROM rep")
def _j10(spark, d):
    """For each new label its members, those that the old labeling left as noise, the old labels it meets and the share of the best one (null without any)."""
    return rounded(M.overlap_report(_labels(spark, d), "old", "new"))


@query("join_unique_match", W(_LAB, _JAC, "ju AS (SELECT new, old, jaccard FROM j WHERE old >= 0 AND new >= 0 AND jaccard >= 0.75)") + "SELECT new, old, round(jaccard, 6) AS jaccard, count(*) OVER (PARTITION BY new) = 1 AND count(*) OVER (PARTITION BY old) = 1 AS unique_match FROM ju")
def _j9(spark, d):
    """Labels that share at least three quarters of their members, and whether the match is one to one."""
    return rounded(M.close_matches(_labels(spark, d), "old", "new"))


@query("filter_small_topics_to_noise", W(_LAB) + "SELECT CASE WHEN c < 40 THEN -1 ELSE old END AS topic, count(*) AS n FROM (SELECT old, count(*) OVER (PARTITION BY phase, old) AS c FROM lab) GROUP BY 1")
def _p7(spark, d):
    lab = _labels(spark, d)
    size = lab.groupBy("phase", "old").agg(F.count(F.lit(1)).alias("c"))
    return size.groupBy(F.when(F.col("c") < 40, -1).otherwise(F.col("old")).alias("topic")).agg(F.sum("c").alias("n"))


# --- matching across phases
_KWTOP = "kt AS (SELECT phase, topic, list(term) AS terms FROM (SELECT phase, topic, term, row_number() OVER (PARTITION BY phase, topic ORDER BY count(*) DESC, term) AS k FROM kw WHERE topic >= 0 GROUP BY 1, 2, 3) WHERE k <= 15 GROUP BY 1, 2)"
_PAIR = [X.VEC, X.terms_sql("kw"), _KWTOP, "cd AS (SELECT phase, topic, i, avg(x) AS m FROM (SELECT phase, topic, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM vec WHERE topic >= 0) GROUP BY 1, 2, 3)",
         "cs AS (SELECT a.topic AS topic1, b.topic AS topic2, sum(a.m * b.m) / sqrt(sum(a.m * a.m) * sum(b.m * b.m)) AS cosine FROM cd a JOIN cd b ON a.i = b.i WHERE a.phase = 1 AND b.phase = 2 GROUP BY 1, 2)",
         "ps AS (SELECT topic1, topic2, cosine, len(list_intersect(a.terms, b.terms)) / CAST(len(list_distinct(list_concat(a.terms, b.terms))) AS DOUBLE) AS jaccard FROM cs JOIN kt a ON a.phase = 1 AND a.topic = topic1 JOIN kt b ON b.phase = 2 AND b.topic = topic2)",
         "hy AS (SELECT *, round(0.6 * cosine + 0.4 * jaccard, 9) AS hybrid FROM ps)", "bm AS (SELECT *, row_number() OVER (PARTITION BY topic1 ORDER BY hybrid DESC, topic2) AS rank12, row_number() OVER (PARTITION BY topic2 ORDER BY hybrid DESC, topic1) AS rank21 FROM hy)"]


def top_keywords(spark, d, k=15):
    t = I.topics(X.terms(X.pub(spark, d), "kw"))
    return V.top_k(K.counts(t, I.KEYS, "term"), I.KEYS, "n", ["term"], k)


def _scores(spark, d):
    kw = top_keywords(spark, d).groupBy(*I.KEYS).agg(F.collect_list("term").alias("terms"))
    return M.pair_scores(X.vectors(spark, d), kw)


@query("join_pair_scores", W(*_PAIR) + "SELECT topic1, topic2, round(cosine, 6) AS cosine, round(jaccard, 6) AS jaccard FROM ps")
def _j7(spark, d):
    return rounded(_scores(spark, d))


@query("join_mutual_best", W(*_PAIR) + "SELECT topic1, topic2, round(hybrid, 6) AS hybrid, CAST(rank12 AS INT) AS rank12, CAST(rank21 AS INT) AS rank21, rank12 = 1 AND rank21 = 1 AS mutual_best FROM bm")
def _j12(spark, d):
    return rounded(M.best_matches(_scores(spark, d)).select("topic1", "topic2", "hybrid", "rank12", "rank21", "mutual_best"))


@query("topk_keywords_per_topic", W(X.terms_sql("kw")) + "SELECT phase, topic, term, n, CAST(k AS INT) AS rank FROM (SELECT phase, topic, term, count(*) AS n, row_number() OVER (PARTITION BY phase, topic ORDER BY count(*) DESC, term) AS k FROM kw WHERE topic >= 0 GROUP BY 1, 2, 3) WHERE k <= 10")
def _t1(spark, d):
    """T1, T4, IO8."""
    return top_keywords(spark, d, 10)


@query("topk_keywords_without_substrings")
def _t7(spark, d):
    """Keywords of a topic in order, leaving out those that contain or lie in a kept one, the first five."""
    ranked = top_keywords(spark, d, 30).groupBy(*I.KEYS).agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "term"))), lambda x: x["term"]).alias("terms"))
    keep = F.aggregate("terms", F.array().cast("array<string>"), lambda acc, x: F.when((F.size(acc) >= 5) | F.exists(acc, lambda y: F.contains(x, y) | F.contains(y, x)), acc).otherwise(F.array_append(acc, x)))
    return ranked.select(*I.KEYS, F.array_join(keep, "; ").alias("keywords"))


@query("topk_most_cited", "WITH " + X.PUB + " SELECT uid, times_cited FROM pub ORDER BY times_cited DESC NULLS LAST, uid LIMIT 20")
def _t3(spark, d):
    """A limit is the feature."""
    return X.pub(spark, d).select("uid", "times_cited").orderBy(F.desc_nulls_last("times_cited"), "uid").limit(20)


@query("topk_hash_draw", W(TOPICS) + "SELECT phase, topic, uid, CAST(k AS INT) AS rank FROM (SELECT phase, topic, uid, row_number() OVER (PARTITION BY phase, topic ORDER BY md5(concat_ws('|', 42, uid)), uid) AS k FROM tp) WHERE k <= 10")
def _t9(spark, d):
    """Ten records of each topic drawn by hash order; slices of the hash are cut first, so no topic is sorted whole."""
    from pyspark.sql import Window

    p = I.topics(X.pub(spark, d)).select(*I.KEYS, "uid").withColumn("h", F.md5(F.concat_ws("|", F.lit("42"), "uid"))).withColumn("part", F.substring("h", -2, 2))
    first = lambda df, keys: df.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy("h", "uid"))).filter("rank <= 10")
    return first(first(p, [*I.KEYS, "part"]), I.KEYS).select(*I.KEYS, "uid", "rank")


# --- references
_REF = ["re AS (SELECT DISTINCT uid, uid_ref FROM reference_edges WHERE uid_ref IS NOT NULL)", "rd AS (SELECT pub.phase, pub.topic, uid, count(*) AS n FROM re JOIN pub USING (uid) WHERE topic >= 0 GROUP BY 1, 2, 3)"]


@query("valid_reference_overlap", W(*_REF, "rp AS (SELECT a.phase, a.topic, a.uid AS ua, b.uid AS ub, a.n AS na, b.n AS nb FROM rd a JOIN rd b ON a.phase = b.phase AND a.topic = b.topic AND a.uid < b.uid)", "rc AS (SELECT a.uid AS ua, b.uid AS ub, count(*) AS c FROM re a JOIN re b ON a.uid_ref = b.uid_ref AND a.uid < b.uid GROUP BY 1, 2)",
         "ro AS (SELECT phase, topic, avg(coalesce(c, 0) / CAST(na + nb - coalesce(c, 0) AS DOUBLE)) AS o FROM rp LEFT JOIN rc USING (ua, ub) GROUP BY 1, 2)")
       + "SELECT s.phase, s.topic, n_refs, round(coalesce(o, 0), 6) AS overlap FROM (SELECT phase, topic, count(*) AS n_refs FROM rd GROUP BY 1, 2) s LEFT JOIN ro USING (phase, topic)")
def _b7(spark, d):
    """B7, B8."""
    docs = I.topics(X.pub(spark, d)).select("uid", *I.KEYS)
    return rounded(V.reference_overlap(X.table(spark, d, "reference_edges"), docs, I.KEYS))


@query("valid_reference_coverage", W("re AS (SELECT DISTINCT uid FROM reference_edges WHERE uid_ref IS NOT NULL)") + "SELECT phase, count(*) AS n, count(re.uid) AS covered, round(count(re.uid) / CAST(count(*) AS DOUBLE), 6) AS share FROM pub LEFT JOIN re USING (uid) GROUP BY 1")
def _b9(spark, d):
    """B9, J6, IO6."""
    e = X.table(spark, d, "reference_edges").filter("uid_ref IS NOT NULL").select("uid").distinct().withColumn("has", F.lit(1))
    a = X.pub(spark, d).select("uid", "phase").join(e, "uid", "left").groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.count("has").alias("covered"))
    return rounded(a.withColumn("share", F.col("covered") / F.col("n")))


for _lvl in ("macro", "meso", "micro"):
    query(f"valid_citation_profile_{_lvl}", W("x AS (SELECT phase, topic, trim(ct_%s) AS v, count(*) AS n FROM pub WHERE topic >= 0 AND lower(trim(ct_%s)) NOT IN ('', 'nan', 'none', 'null', 'n/a', 'na') GROUP BY 1, 2, 3)" % (_lvl, _lvl))
          + "SELECT phase, topic, v AS dominant, round(n / CAST(total AS DOUBLE), 6) AS modal_share, kinds, CAST(total AS BIGINT) AS covered FROM (SELECT *, row_number() OVER (PARTITION BY phase, topic ORDER BY n DESC, v) AS k, sum(n) OVER (PARTITION BY phase, topic) AS total, count(*) OVER (PARTITION BY phase, topic) AS kinds FROM x) WHERE k = 1")(
        lambda spark, d, c=f"ct_{_lvl}": rounded(V.level_profile(I.topics(X.pub(spark, d)).withColumn("v", T.present(F.col(c))), I.KEYS, "v"))
    )


# --- external validation
_EXT = "ext AS (SELECT phase, topic, median(rtw) AS rtw, median(ctw) AS ctw, count(rtw) AS n_rtw, count(ctw) AS n_ctw, count(*) AS n FROM pub WHERE topic >= 0 GROUP BY 1, 2)"


def _external(spark, d):
    return I.topics(X.pub(spark, d)).groupBy(*I.KEYS).agg(F.percentile("rtw", 0.5).alias("rtw"), F.percentile("ctw", 0.5).alias("ctw"), F.count("rtw").alias("n_rtw"), F.count("ctw").alias("n_ctw"), F.count(F.lit(1)).alias("n"))


@query("valid_external_criteria", W(_EXT) + "SELECT phase, topic, round(rtw, 6) AS rtw, round(ctw, 6) AS ctw, n_rtw, n_ctw, n FROM ext")
def _b11(spark, d):
    return rounded(_external(spark, d))


_CORR_IND = list(I.INDICATORS)
# What an external criterion should go along with and what not.
EXPECTED = {"rtw": {"eo2": "convergent", "di3": "discriminant", "di1": "discriminant", "ds1": "discriminant"}, "ctw": {"ip3": "convergent", "di3": "discriminant", "di1": "discriminant", "ds1": "discriminant"}}
_WHEN = " ".join(f"WHEN external = '{e}' AND indicator = '{i}' THEN '{x}'" for e, m in EXPECTED.items() for i, x in m.items())
_CORR = [_EXT, *IND_SQL, "lo AS (SELECT phase, topic, i.indicator, i.x, e.external, e.y FROM (SELECT * FROM ind JOIN ext USING (phase, topic)), "
         "LATERAL (VALUES " + ", ".join(f"('{n}', round({n}, 9))" for n in _CORR_IND) + ") i(indicator, x), LATERAL (VALUES ('rtw', rtw), ('ctw', ctw)) e(external, y))",
         "rk AS (SELECT *, rank() OVER (PARTITION BY phase, external, indicator ORDER BY x) + (count(*) OVER (PARTITION BY phase, external, indicator, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY phase, external, indicator ORDER BY y) + (count(*) OVER (PARTITION BY phase, external, indicator, y) - 1) / 2.0 AS ry FROM lo WHERE x IS NOT NULL AND y IS NOT NULL)",
         "co AS (SELECT phase, external, indicator, count(*) AS n, CASE WHEN count(*) >= 5 AND NOT isnan(corr(rx, ry)) THEN corr(rx, ry) END AS rho FROM rk GROUP BY 1, 2, 3)",
         f"cv AS (SELECT *, CASE {_WHEN} ELSE 'neutral' END AS expected FROM co)",
         "vd AS (SELECT *, CASE WHEN rho IS NULL THEN 'NA' WHEN expected = 'convergent' THEN CASE WHEN rho >= 0.3 THEN 'OK' ELSE 'FAIL_CONVERGENT' END WHEN expected = 'discriminant' THEN CASE WHEN abs(rho) <= 0.3 THEN 'OK' ELSE 'FAIL_DISCRIMINANT' END ELSE 'INFO' END AS verdict FROM cv)"]


def _correlations(spark, d):
    ind = reliable(rounded(indicators16(spark, d), digits=9))
    c = V.external_correlations(ind, _external(spark, d).select(*I.KEYS, "rtw", "ctw"), _CORR_IND, ["rtw", "ctw"])
    expected = F.lit("neutral")
    for e, m in EXPECTED.items():
        for i, x in m.items():
            expected = F.when((F.col("external") == e) & (F.col("indicator") == i), x).otherwise(expected)
    return c.withColumn("expected", expected).withColumn("verdict", V.correlation_verdict(F.col("rho"), F.col("expected")))


@query("valid_spearman_p")
def _b12p(spark, d):
    """The correlations with their two-sided p-values by Student's t, which SQL has no distribution for."""
    return rounded(V.with_p_value(_correlations(spark, d).select("phase", "external", "indicator", "n", "rho")))


@query("valid_spearman", W(*_CORR) + "SELECT phase, external, indicator, n, round(rho, 6) AS rho, expected, verdict FROM vd")
def _b12(spark, d):
    """B12, P12."""
    return rounded(_correlations(spark, d))


@query("valid_mtmm", W(*_CORR) + "SELECT phase, external, round(avg(rho) FILTER (expected = 'convergent'), 6) AS mean_convergent, round(avg(abs(rho)) FILTER (expected = 'discriminant'), 6) AS mean_discriminant, count(*) FILTER (verdict LIKE 'FAIL%') AS violations, CASE WHEN count(*) FILTER (expected = 'convergent' AND verdict = 'OK') = count(*) FILTER (expected = 'convergent') AND count(*) FILTER (verdict = 'FAIL_DISCRIMINANT') = 0 THEN 'supported' WHEN count(*) FILTER (expected = 'convergent' AND verdict = 'OK') > 0 THEN 'partial' ELSE 'rejected' END AS validity FROM vd GROUP BY 1, 2")
def _b13(spark, d):
    return rounded(V.mtmm(_correlations(spark, d)))


# --- term weights
_TOK = "tk AS (SELECT uid, phase, topic, unnest(regexp_extract_all(lower(coalesce(title, '')), '[a-z][a-z0-9-]+')) AS term FROM pub)"


def tokens(spark, d):
    return X.pub(spark, d).select("uid", *I.KEYS, F.explode(F.regexp_extract_all(F.lower(F.coalesce("title", F.lit(""))), F.lit("([a-z][a-z0-9-]+)"))).alias("term"))


_TFIDF = ["nd AS (SELECT count(DISTINCT uid) AS total FROM tk)", "vo AS (SELECT term, ln((1.0 + total) / (1.0 + df)) + 1 AS idf FROM (SELECT term, count(DISTINCT uid) AS df, count(*) AS tf FROM tk GROUP BY 1), nd WHERE df >= 3 AND df <= 0.85 * total ORDER BY tf DESC, term LIMIT 10000)",
          "wt AS (SELECT phase, topic, term, (1 + ln(count(*))) * any_value(idf) AS w FROM tk JOIN vo USING (term) WHERE topic >= 0 GROUP BY 1, 2, 3)", "ws AS (SELECT phase, topic, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY phase, topic)), 9) AS score FROM wt)"]


@query("valid_tfidf_terms", W(_TOK, *_TFIDF) + "SELECT phase, topic, term, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY phase, topic ORDER BY score DESC, term) AS k FROM ws) WHERE k <= 5")
def _b14(spark, d):
    t = tokens(spark, d)
    total = V.tfidf_terms(t, I.KEYS, "uid", "term", 5).filter("topic >= 0")
    return rounded(total.select(*I.KEYS, "term", "score"), digits=5)


_CT = ["cf AS (SELECT tk.phase, tk.topic, term, count(*) AS n FROM tk JOIN (SELECT term FROM tk GROUP BY 1 HAVING count(DISTINCT uid) >= 2) USING (term) WHERE topic >= 0 GROUP BY 1, 2, 3)", "cz AS (SELECT phase, topic, sum(n) AS size FROM cf GROUP BY 1, 2)",
       "ca AS (SELECT sum(size) / CAST(count(*) AS DOUBLE) AS m FROM cz)", "ck AS (SELECT cf.phase, cf.topic, term, round(n / CAST(size AS DOUBLE) * ln(1 + m / CAST(sum(n) OVER (PARTITION BY term) AS DOUBLE)), 9) AS score FROM cf JOIN cz USING (phase, topic), ca)", "cr AS (SELECT *, row_number() OVER (PARTITION BY phase, topic ORDER BY score DESC, term) AS rank FROM ck)"]


@query("valid_class_tfidf", W(_TOK, *_CT) + "SELECT phase, topic, term, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM cr WHERE rank <= 10")
def _b15(spark, d):
    return rounded(V.class_tfidf(tokens(spark, d), I.KEYS, "uid", "term"))


_COH = ["tt AS (SELECT * FROM cr WHERE rank <= 10)", "oc AS (SELECT DISTINCT uid, term FROM tk WHERE term IN (SELECT term FROM tt))", "nd AS (SELECT count(DISTINCT uid) AS total FROM tk)", "dfx AS (SELECT term, count(*) AS df FROM oc GROUP BY 1)", "cc AS (SELECT a.term AS ta, b.term AS tb, count(*) AS c FROM oc a JOIN oc b ON a.uid = b.uid AND a.term <> b.term GROUP BY 1, 2)",
        "pp AS (SELECT x.phase, x.topic, coalesce(c, 0) AS c, da.df AS da, db.df AS db, total FROM tt x JOIN tt y ON x.phase = y.phase AND x.topic = y.topic AND x.rank < y.rank LEFT JOIN cc ON ta = x.term AND tb = y.term JOIN dfx da ON da.term = x.term JOIN dfx db ON db.term = y.term, nd)"]
_NPMI = "round(avg(CASE WHEN c = 0 THEN -1.0 WHEN c = total THEN 1.0 ELSE ln((c / CAST(total AS DOUBLE)) / ((da / CAST(total AS DOUBLE)) * (db / CAST(total AS DOUBLE)))) / -ln(c / CAST(total AS DOUBLE)) END), 6)"


@query("valid_coherence", W(_TOK, *_CT, *_COH) + f"SELECT phase, topic, round(avg(ln((c + 1.0) / da)), 6) AS u_mass, {_NPMI} AS npmi FROM pp GROUP BY 1, 2")
def _b16(spark, d):
    t = reliable(tokens(spark, d))
    return rounded(V.cooccurrence_coherence(t, reliable(V.class_tfidf(t, I.KEYS, "uid", "term")), I.KEYS, "uid", "term"))


@query("valid_diversity", W(_TOK, *_CT) + "SELECT phase, count(DISTINCT term) AS kinds, count(*) AS total, round(count(DISTINCT term) / CAST(count(*) AS DOUBLE), 6) AS diversity FROM cr WHERE rank <= 10 GROUP BY 1")
def _b17(spark, d):
    a = V.class_tfidf(tokens(spark, d), I.KEYS, "uid", "term").groupBy("phase").agg(F.countDistinct("term").alias("kinds"), F.count(F.lit(1)).alias("total"))
    return rounded(a.withColumn("diversity", F.col("kinds") / F.col("total")))


# --- term weights of whole texts
# Function words that no term holds.
STOP = "a about above across after again against all almost along already also although always am among an and another any are around as at be became because become been before being below between both but by can cannot could did do does doing done down due during each either else ever every few first for from further had has have having he her here hers him his how however i if in indeed into is it its itself last least less made many may me might more moreover most much must my neither never no nor not nothing now of off often on once one only onto or other others otherwise our ours out over own per perhaps rather same seem she should since so some still such than that the their them then there therefore these they this those through throughout thus to together too toward towards two under until up upon us very via was we well were what when where whether which while who whose why will with within without would yet you your".split()


def documents(spark, d):
    """(uid, keys, text): cleaned title and abstract of every record of the years of ``prep_corpus`` with at least ten words."""
    p = X.pub(spark, d).filter(F.col("year").between(2000, 2025)).select("uid", *I.KEYS, T.topic_text(F.col("title"), F.col("abstract")).alias("text"))
    return p.filter(T.word_count(F.col("text")) >= 10)


def text_words(spark, d):
    return documents(spark, d).select("uid", *I.KEYS, F.regexp_extract_all("text", F.lit(r"\b[a-z][a-z0-9-]+\b"), F.lit(0)).alias("words"))


def text_ngrams(spark, d):
    """Words without stop words, and pairs of neighbours among those left."""
    w = documents(spark, d).select("uid", *I.KEYS, F.filter(F.regexp_extract_all("text", F.lit(r"\b\w\w+\b"), F.lit(0)), lambda x: ~x.isin(STOP)).alias("w"))
    pairs = F.when(F.size("w") > 1, F.zip_with(F.expr("slice(w, 1, size(w) - 1)"), F.expr("slice(w, 2, size(w) - 1)"), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return w.select("uid", *I.KEYS, F.concat("w", pairs).alias("words"))


def _text_tops(words, n=10):
    c = reliable(V.term_counts(words, I.KEYS, "words"))
    kept = c.groupBy("term").agg(F.sum("df").alias("df")).filter("df >= 2").select("term")
    return V.class_tfidf_of_counts(c.filter("topic >= 0").join(kept, "term").select(*I.KEYS, "term", "n"), I.KEYS, "term", n)


_DOCS = f"dx AS (SELECT * FROM (SELECT uid, phase, topic, {TEXT_SQL} AS text FROM pub WHERE year BETWEEN 2000 AND 2025) WHERE len(list_filter(string_split(text, ' '), lambda x: x <> '')) >= 10)"
_TOKX = [_DOCS, "tk AS (SELECT uid, phase, topic, unnest(regexp_extract_all(text, '\\b[a-z][a-z0-9-]+\\b')) AS term FROM dx)"]
_STOP = ", ".join(f"'{w}'" for w in STOP)
_TOKN = [_DOCS, f"tw AS (SELECT uid, phase, topic, list_filter(regexp_extract_all(text, '\\b\\w\\w+\\b'), lambda x: x NOT IN ({_STOP})) AS w FROM dx)", "tk AS (SELECT uid, phase, topic, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tw)"]


@query("valid_text_tfidf_terms", W(*_TOKN, *_TFIDF).replace("(SELECT count(DISTINCT uid) AS total FROM tk)", "(SELECT count(*) AS total FROM dx)") + "SELECT phase, topic, term, round(score, 5) AS score FROM (SELECT *, row_number() OVER (PARTITION BY phase, topic ORDER BY score DESC, term) AS k FROM ws) WHERE k <= 15")
def _b14_text(spark, d):
    """B14 on title and abstract, single words and pairs."""
    docs = text_ngrams(spark, d)
    c = reliable(V.term_counts(docs, I.KEYS, "words"))
    df = c.groupBy("term").agg(F.sum("df").alias("df"), F.sum("n").alias("tf"))
    top = V.tfidf_of_counts(c, df, documents(spark, d).count(), I.KEYS, "term")
    return rounded(top.filter("topic >= 0").select(*I.KEYS, "term", "score"), digits=5)


@query("valid_text_class_tfidf", W(*_TOKX, *_CT) + "SELECT phase, topic, term, round(score, 6) AS score, CAST(rank AS INT) AS rank FROM cr WHERE rank <= 10")
def _b15_text(spark, d):
    """B15 on title and abstract."""
    return rounded(_text_tops(text_words(spark, d)))


@query("valid_text_coherence", W(*_TOKX, *_CT, *_COH).replace("nd AS (SELECT count(DISTINCT uid) AS total FROM tk)", "nd AS (SELECT count(*) AS total FROM dx)") + f"SELECT phase, topic, round(avg(ln((c + 1.0) / da)), 6) AS u_mass, {_NPMI} AS npmi FROM pp GROUP BY 1, 2")
def _b16_text(spark, d):
    """B16 on title and abstract."""
    words = text_words(spark, d)
    tops = reliable(_text_tops(words))
    held = words.select("uid", F.explode(F.array_distinct("words")).alias("term")).join(F.broadcast(tops.select("term").distinct()), "term", "left_semi")
    return rounded(V.cooccurrence_coherence(reliable(held), tops, I.KEYS, "uid", "term", documents(spark, d).count()))


@query("valid_text_diversity", W(*_TOKX, *_CT) + "SELECT phase, 'top_' || k AS tops, count(DISTINCT term) AS kinds, count(*) AS total, round(count(DISTINCT term) / CAST(count(*) AS DOUBLE), 6) AS diversity FROM cr, (VALUES (10), (100)) v(k) WHERE rank <= k GROUP BY 1, 2")
def _b17_text(spark, d):
    """B17 on title and abstract, of the ten and of the hundred best terms of each topic."""
    t = _text_tops(text_words(spark, d), 100).withColumn("k", F.explode(F.array(F.lit(10), F.lit(100)))).filter("rank <= k")
    a = t.groupBy("phase", F.concat(F.lit("top_"), F.col("k").cast("string")).alias("tops")).agg(F.countDistinct("term").alias("kinds"), F.count(F.lit(1)).alias("total"))
    return rounded(a.withColumn("diversity", F.col("kinds") / F.col("total")))


@query("cand_eo5_a1_text_diversity")
def _eo5_text(spark, d):
    """C9 on the words of title and abstract at the full bounds, 20 records outside the topic and 5 words of a record."""
    from topicweave.operators.candidates import semantic_diversity

    words = text_words(spark, d).select("uid", *I.KEYS, F.explode(F.array_distinct("words")).alias("term"))
    return rounded(semantic_diversity(words, X.vectors(spark, d).select("uid", "embedding")))


@query("valid_summary", W(TOPICS, RATE) + "SELECT phase, round(avg(r), 6) AS mean, round(stddev_pop(r), 6) AS sd, round(median(r), 6) AS median, count(r) AS valid FROM rate GROUP BY 1")
def _b18(spark, d):
    r = I.topics(X.pub(spark, d)).filter("year IS NOT NULL").select("phase", I.citation_rate(F.col("times_cited"), F.col("year")).alias("r"))
    return rounded(r.groupBy("phase").agg(F.avg("r").alias("mean"), F.stddev_pop("r").alias("sd"), F.percentile("r", 0.5).alias("median"), F.count("r").alias("valid")))


# --- classes
_DOMQ = [*MEM_SQL]


@query("valid_transition_matrix", W(*_DOMQ) + "SELECT coalesce(a.dominant, 'all') AS a, coalesce(b.dominant, 'all') AS b, count(*) AS n FROM mem a JOIN mem b ON a.topic = b.topic WHERE a.phase = 1 AND b.phase = 2 GROUP BY CUBE (a.dominant, b.dominant)")
def _b19(spark, d):
    """Classes of the topics of both phases; topics keep their number here."""
    m = classified(spark, d)
    a, b = m.filter("phase = 1").select("topic", F.col("dominant").alias("a")), m.filter("phase = 2").select("topic", F.col("dominant").alias("b"))
    return V.transition_matrix(a.join(b, "topic"), "a", "b")


@query("valid_migration_cells", W(*_DOMQ) + "SELECT a.dominant AS a, b.dominant AS b, count(*) AS n, count(*) FILTER (least(a.margin, b.margin) < 0.1) AS n_close, round(avg(b.m_ws - a.m_ws), 5) AS shift_ws FROM mem a JOIN mem b ON a.topic = b.topic WHERE a.phase = 1 AND b.phase = 2 GROUP BY 1, 2")
def _b20(spark, d):
    m = classified(spark, d)
    a = m.filter("phase = 1").select("topic", F.col("dominant").alias("a"), F.col("margin").alias("ma"), F.col("m_ws").alias("wa"))
    b = m.filter("phase = 2").select("topic", F.col("dominant").alias("b"), F.col("margin").alias("mb"), F.col("m_ws").alias("wb"))
    out = a.join(b, "topic").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.least("ma", "mb") < 0.1).alias("n_close"), F.avg(F.col("wb") - F.col("wa")).alias("shift_ws"))
    return rounded(out, digits=5)


@query("join_semi_both_phases", W(*_DOMQ) + "SELECT phase, topic FROM mem m WHERE dominant IN (SELECT dominant FROM mem x WHERE x.topic = m.topic AND x.phase <> m.phase)")
def _j13(spark, d):
    """Topics with the same class in both phases."""
    m = classified(spark, d).select(*I.KEYS, "dominant")
    other = m.select((3 - F.col("phase")).alias("phase"), "topic", "dominant")
    return m.join(other, ["phase", "topic", "dominant"], "left_semi").select(*I.KEYS)


@query("fig_margin_histogram", W(*_DOMQ) + "SELECT phase, CAST(floor(margin / 0.01) AS INT) AS bin, count(*) AS n FROM mem GROUP BY 1, 2")
def _v4(spark, d):
    return classified(spark, d).groupBy("phase", F.floor(F.col("margin") / 0.01).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("fig_class_profiles", W(*_DOMQ) + "SELECT phase, dominant, round(avg(EO), 5) AS EO, round(avg(WN), 5) AS WN, round(avg(EP), 5) AS EP, round(avg(DI), 5) AS DI, round(avg(WP), 5) AS WP, count(*) AS n FROM mem GROUP BY 1, 2")
def _v2(spark, d):
    """V1, V2."""
    return rounded(classified(spark, d).groupBy("phase", "dominant").agg(*[F.avg(c).alias(c) for c in I.DIMENSIONS], F.count(F.lit(1)).alias("n")), digits=5)


@query("fig_margin_classes", W(*_DOMQ) + "SELECT phase, CASE WHEN margin < 0.05 THEN '<0.05' WHEN margin < 0.1 THEN '0.05-0.10' ELSE '>=0.10' END AS class, count(*) AS n FROM mem GROUP BY 1, 2")
def _p11(spark, d):
    c = F.when(F.col("margin") < 0.05, "<0.05").when(F.col("margin") < 0.1, "0.05-0.10").otherwise(">=0.10")
    return classified(spark, d).groupBy("phase", c.alias("class")).agg(F.count(F.lit(1)).alias("n"))


@query("fig_weak_signals", W(*_DOMQ) + "SELECT phase, topic, round(1 - m_ws, 5) AS distance, round(margin, 5) AS margin FROM mem QUALIFY row_number() OVER (PARTITION BY phase ORDER BY round(1 - m_ws, 9), topic) <= 6")
def _v5(spark, d):
    """V5, V6."""
    m = classified(spark, d).withColumn("score", F.round(F.col("m_ws"), 9))
    return rounded(V.top_k(m, ["phase"], "score", ["topic"], 6).select(*I.KEYS, (1.0 - F.col("m_ws")).alias("distance"), "margin"), digits=5)


_NAMES = [(a, b) for i, a in enumerate(I.INDICATORS) for b in I.INDICATORS[:i]]
_C120 = [*IND_SQL, "c120 AS (SELECT phase, " + ", ".join(f"corr({a}, {b}) AS {a}_{b}" for a, b in _NAMES) + " FROM ind GROUP BY 1)", "cl AS (SELECT phase, x.a, x.b, CASE WHEN isfinite(x.r) THEN x.r END AS r FROM c120, LATERAL (VALUES " + ", ".join(f"('{a}', '{b}', {a}_{b})" for a, b in _NAMES) + ") x(a, b, r))"]


def _long_correlations(spark, d):
    one = indicators16(spark, d).groupBy("phase").agg(*[K.pearson(a, b).alias(f"{a}_{b}") for a, b in _NAMES])
    return one.select("phase", F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{a}_{b}").alias("r")) for a, b in _NAMES])))


@query("valid_indicator_correlations", W(*_C120) + "SELECT phase, a, b, round(r, 5) AS r FROM cl")
def _b28(spark, d):
    """The 120 Pearson correlations of the indicators, in one aggregation."""
    return rounded(_long_correlations(spark, d), digits=5)


@query("fig_correlation_scale", W(*_C120) + "SELECT ceil(max(abs(round(r, 5))) * 10) / 10 AS scale FROM cl")
def _v10(spark, d):
    """The largest correlation below the diagonal in both phases, rounded up to a tenth, as one scale for both."""
    return _long_correlations(spark, d).agg((F.ceil(F.max(F.abs(F.round("r", 5))) * 10) / 10).alias("scale"))


# --- windows and sets
@query("win_avg_rank", "WITH " + X.PUB + " SELECT uid, rank() OVER (PARTITION BY phase ORDER BY times_cited) + (count(*) OVER (PARTITION BY phase, times_cited) - 1) / 2.0 AS rank FROM pub WHERE times_cited IS NOT NULL")
def _w2(spark, d):
    return K.avg_rank(X.pub(spark, d).filter("times_cited IS NOT NULL"), ["phase"], "times_cited").select("uid", "rank")


_CLASSES = ["ws", "ec", "latent", "trend"]
_ORDER = "CASE dominant WHEN 'ws' THEN 1 WHEN 'ec' THEN 2 WHEN 'latent' THEN 3 ELSE 4 END"


@query("win_class_shares_over_years", W(*MEM_SQL, "cy AS (SELECT tp.phase, tp.year, dominant, count(*) AS n FROM tp JOIN mem ON tp.phase = mem.phase AND tp.topic = mem.topic WHERE year IS NOT NULL GROUP BY 1, 2, 3)")
       + f"SELECT phase, year, dominant, n, round(n / CAST(sum(n) OVER (PARTITION BY phase, year) AS DOUBLE), 6) AS share, round(sum(n) OVER (PARTITION BY phase, year ORDER BY {_ORDER}) / CAST(sum(n) OVER (PARTITION BY phase, year) AS DOUBLE), 6) AS upper FROM cy")
def _b21(spark, d):
    """Records of each year by the class of their topic, shares and the upper edge of each class in the stack."""
    from pyspark.sql import Window

    m = classified(spark, d).select(*I.KEYS, "dominant")
    c = I.topics(X.pub(spark, d)).filter("year IS NOT NULL").join(m, I.KEYS).groupBy("phase", "year", "dominant").agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("phase", "year")
    place = F.array_position(F.array(*[F.lit(x) for x in _CLASSES]), F.col("dominant"))
    run = F.sum("n").over(w.orderBy(place).rowsBetween(Window.unboundedPreceding, 0))
    return rounded(c.withColumn("share", F.col("n") / F.sum("n").over(w)).withColumn("upper", run / F.sum("n").over(w)))


@query("fig_emergence_map", W(*MEM_SQL, "em AS (SELECT phase, topic, avg_share, growth, EO, margin, dominant, median(avg_share) OVER (PARTITION BY phase) AS cut FROM tem JOIN mem USING (phase, topic))")
       + "SELECT phase, topic, round(avg_share, 6) AS avg_share, round(growth, 6) AS growth, round(EO, 5) AS EO, dominant, CASE WHEN growth >= 0 THEN CASE WHEN avg_share >= cut THEN 'strong' ELSE 'emerging' END WHEN avg_share >= cut THEN 'established' ELSE 'latent' END AS quadrant FROM em")
def _v3(spark, d):
    """V3: topics by mean share (cut at the median) and growth (cut at 0)."""
    from pyspark.sql import Window

    m = classified(spark, d).select(*I.KEYS, "EO", "dominant")
    t = I.tem_metrics(I.yearly_shares(X.pub(spark, d))).join(m, I.KEYS)
    large = F.col("avg_share") >= F.percentile("avg_share", 0.5).over(Window.partitionBy("phase"))
    quadrant = F.when(F.col("growth") >= 0, F.when(large, "strong").otherwise("emerging")).otherwise(F.when(large, "established").otherwise("latent"))
    t = t.select(*I.KEYS, F.round("avg_share", 6).alias("avg_share"), F.round("growth", 6).alias("growth"), F.round("EO", 5).alias("EO"), "dominant", quadrant.alias("quadrant"))
    return t


_PROFILE = " UNION ALL ".join(f"SELECT phase, '{c}' AS dimension, round(quantile_cont({c}, 0.9), 5) AS q90, round(median({c}), 5) AS median FROM mem GROUP BY 1" for c in I.DIMENSIONS)


@query("fig_dimension_profile", W(*MEM_SQL) + _PROFILE)
def _b23(spark, d):
    """Median and 0.9 quantile of each dimension over the topics of a phase."""
    long = classified(spark, d).unpivot(["phase"], list(I.DIMENSIONS), "dimension", "v")
    return rounded(long.groupBy("phase", "dimension").agg(F.percentile("v", 0.9).alias("q90"), F.percentile("v", 0.5).alias("median")), digits=5)


_SIG = [*_PAIR, "sg AS (SELECT topic1, topic2, cosine, jaccard, quantile_cont(cosine, 1/3.0) OVER () AS xl, quantile_cont(cosine, 2/3.0) OVER () AS xh, quantile_cont(jaccard, 1/3.0) OVER () AS yl, quantile_cont(jaccard, 2/3.0) OVER () AS yh FROM bm WHERE rank12 = 1)"]


@query("fig_signature_cells", W(*_SIG) + "SELECT topic1, topic2, round(cosine, 6) AS cosine, round(jaccard, 6) AS jaccard, CASE WHEN cosine >= xh AND jaccard >= yh THEN 'stable' WHEN cosine >= xh AND jaccard < yl THEN 'drift' WHEN cosine < xl THEN 'precondition' ELSE 'other' END AS cell FROM sg")
def _b22(spark, d):
    """Best matches of the topics by terciles of cosine and Jaccard."""
    m = reliable(M.best_matches(_scores(spark, d)).filter("rank12 = 1").select("topic1", "topic2", "cosine", "jaccard"))
    third = [F.lit(1 / 3.0), F.lit(2 / 3.0)]
    q = m.agg(F.percentile("cosine", F.array(*third)).alias("x"), F.percentile("jaccard", F.array(*third)).alias("y"))
    x, y = F.col("cosine"), F.col("jaccard")
    cell = F.when((x >= F.col("x")[1]) & (y >= F.col("y")[1]), "stable").when((x >= F.col("x")[1]) & (y < F.col("y")[0]), "drift").when(x < F.col("x")[0], "precondition").otherwise("other")
    return rounded(m.join(q).select("topic1", "topic2", "cosine", "jaccard", cell.alias("cell")))  # a table of one row


_E = [*_PAIR, "am AS (SELECT topic1, max(hybrid) AS h FROM hy GROUP BY 1)", "ae AS (SELECT topic1, h, (SELECT count(*) FROM hy x WHERE x.hybrid > am.h) / CAST((SELECT count(*) FROM hy) AS DOUBLE) AS p FROM am)"]


@query("valid_match_evalues", W(*_E) + "SELECT topic1, round(h, 6) AS h, round(p, 9) AS p, round((SELECT count(DISTINCT topic2) FROM hy) * p, 6) AS e FROM ae")
def _b24(spark, d):
    """Tail probability of each topic's best score among all pairs, and its E-value, candidates times that probability."""
    return rounded(V.match_evalues(M.best_matches(_scores(spark, d)).select("topic1", "topic2", "hybrid")).withColumn("p", F.round("p", 9)), "h", "e")


_MLE = [*_E, "ar AS (SELECT least(greatest(1 - p, 1e-12), 1 - 1e-12) AS r FROM ae)", "ac AS (SELECT median(r) AS c FROM ar)"]


@query("valid_effective_candidates", W(*_MLE) + "SELECT round(-count(*) / sum(ln(r)), 6) AS n_all, round(count(*) FILTER (r <= c) / (count(*) FILTER (r <= c) * ln(any_value(c)) - sum(ln(r)) FILTER (r <= c)), 6) AS n_lower, round((SELECT avg(CASE WHEN hybrid = 0 THEN 1.0 ELSE 0.0 END) FROM hy), 6) AS ties FROM ar, ac")
def _b24n(spark, d):
    """Effective number of candidates from the ranks of the best scores (Beta(n, 1)), of all and of the lower half by the truncated likelihood."""
    s = reliable(M.best_matches(_scores(spark, d)).select("topic1", "topic2", "hybrid"))
    return rounded(V.effective_candidates(s))


_FLAG = [*_PAIR[:-1], "fq AS (SELECT 'cosine' AS scale, topic1, topic2, round(cosine, 9) AS v FROM ps UNION ALL SELECT 'jaccard', topic1, topic2, round(jaccard, 9) FROM ps)", "f99 AS (SELECT scale, quantile_cont(v, 0.99) AS q FROM fq GROUP BY 1)", "fb AS (SELECT scale, topic1, max(v) AS h FROM fq GROUP BY 1, 2)",
         "fl AS (SELECT scale, topic1 AS topic FROM fb JOIN f99 USING (scale) WHERE h < q)", "fm AS (SELECT scale, topic2, max(v) AS h FROM fq GROUP BY 1, 2)", "fz AS (SELECT scale, topic2 AS topic FROM fm JOIN (SELECT scale, quantile_cont(h, 0.25) AS q FROM fm GROUP BY 1) USING (scale) WHERE h < q)"]
_SETS = lambda name, src: f"SELECT '{name}' AS flag, (SELECT count(*) FROM {src} WHERE scale = 'cosine') AS a, (SELECT count(*) FROM {src} WHERE scale = 'jaccard') AS b, (SELECT count(*) FROM (SELECT topic FROM {src} WHERE scale = 'cosine' INTERSECT SELECT topic FROM {src} WHERE scale = 'jaccard')) AS common"


@query("set_flag_overlap", W(*_FLAG) + "SELECT flag, a, b, common, round(common / CAST(nullif(a + b - common, 0) AS DOUBLE), 6) AS jaccard FROM (" + _SETS("below_q99", "fl") + " UNION ALL " + _SETS("below_q25", "fz") + ")")
def _b25(spark, d):
    """Topics that the scales of cosine and of keywords mark alike: best score below the 0.99 quantile of all pairs (first phase),
    and below the lower quartile of the best scores (second phase)."""
    s = _scores(spark, d)
    return rounded(V.flag_overlap(s.select("topic1", "topic2", F.round("cosine", 9).alias("cosine"), F.round("jaccard", 9).alias("jaccard")), ["cosine", "jaccard"]))


_OVER = [*_REF, "rp AS (SELECT a.phase, a.topic, a.uid AS ua, b.uid AS ub, a.n AS na, b.n AS nb FROM rd a JOIN rd b ON a.phase = b.phase AND a.topic = b.topic AND a.uid < b.uid)", "rc AS (SELECT a.uid AS ua, b.uid AS ub, count(*) AS c FROM re a JOIN re b ON a.uid_ref = b.uid_ref AND a.uid < b.uid GROUP BY 1, 2)",
         "ro AS (SELECT s.phase, s.topic, round(coalesce(o, 0), 9) AS o FROM (SELECT DISTINCT phase, topic FROM rd) s LEFT JOIN (SELECT phase, topic, avg(coalesce(c, 0) / CAST(na + nb - coalesce(c, 0) AS DOUBLE)) AS o FROM rp LEFT JOIN rc USING (ua, ub) GROUP BY 1, 2) USING (phase, topic))",
         "rm AS (SELECT *, median(o) OVER (PARTITION BY phase) AS base FROM ro)", "rr AS (SELECT phase, topic, o / nullif(base, 0) AS ratio FROM rm)"]


@query("fig_reference_coherence", W(*_OVER) + "SELECT phase, count(*) AS n, round(quantile_cont(greatest(ratio, 0.1), 0.05), 6) AS low, round(quantile_cont(greatest(ratio, 0.1), 0.25), 6) AS q25, round(median(ratio), 6) AS median, round(quantile_cont(greatest(ratio, 0.1), 0.75), 6) AS q75, round(quantile_cont(greatest(ratio, 0.1), 0.95), 6) AS high, count(*) FILTER (ratio < 1.0) AS below FROM rr WHERE ratio IS NOT NULL GROUP BY 1")
def _v8(spark, d):
    """V8: overlap of references over the median topic of the phase, lifted to a floor: whiskers, quartiles, median and how many lie below 1."""
    docs = I.topics(X.pub(spark, d)).select("uid", *I.KEYS)
    return rounded(V.ratio_box(V.reference_overlap(X.table(spark, d, "reference_edges"), docs, I.KEYS).select(*I.KEYS, F.round("overlap", 9).alias("o"))))


@query("fig_coherence_box", W(_TOK, *_CT, *_COH) + "SELECT phase, count(*) AS n, round(avg(npmi), 5) AS mean, round(quantile_cont(npmi, 0.25), 5) AS q25, round(median(npmi), 5) AS median, round(quantile_cont(npmi, 0.75), 5) AS q75 FROM (SELECT phase, topic, " + _NPMI + " AS npmi FROM pp GROUP BY 1, 2) WHERE npmi IS NOT NULL GROUP BY 1")
def _v9(spark, d):
    """V9: box statistics of the topics' coherence."""
    c = _b16(spark, d).filter("npmi IS NOT NULL")
    q = F.percentile("npmi", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    a = c.groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.avg("npmi").alias("mean"), q.alias("q"))
    return rounded(a.select("phase", "n", "mean", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75")), digits=5)


@query("win_year_deviation", "WITH " + X.PUB + " SELECT uid, round(times_cited - avg(times_cited) OVER (PARTITION BY phase, year), 6) AS deviation FROM pub WHERE year IS NOT NULL AND times_cited IS NOT NULL")
def _w4(spark, d):
    p = X.pub(spark, d).filter("year IS NOT NULL AND times_cited IS NOT NULL").select("uid", "phase", "year", "times_cited")
    return rounded(p.join(p.groupBy("phase", "year").agg(F.avg("times_cited").alias("m")), ["phase", "year"]).select("uid", (F.col("times_cited") - F.col("m")).alias("deviation")))


@query("set_keyword_union", W(X.terms_sql("kw"), X.terms_sql("kwp")) + "SELECT DISTINCT term FROM (SELECT term FROM kw UNION SELECT term FROM kwp)")
def _u4(spark, d):
    """U1, U4."""
    p = X.pub(spark, d)
    return X.terms(p, "kw").select("term").unionByName(X.terms(p, "kwp").select("term")).distinct()


@query("set_id_overlap", "SELECT (SELECT count(*) FROM (SELECT uid FROM publications INTERSECT SELECT uid FROM reference_edges)) AS both, (SELECT count(*) FROM (SELECT uid FROM publications EXCEPT SELECT uid FROM reference_edges)) AS only_publications, (SELECT count(*) FROM (SELECT uid FROM reference_edges EXCEPT SELECT uid FROM publications)) AS only_edges")
def _u5(spark, d):
    """One pass over the union of ids instead of three set operations."""
    a = X.table(spark, d, "publications").select("uid", F.lit(1).alias("p"), F.lit(0).alias("e"))
    b = X.table(spark, d, "reference_edges").select("uid", F.lit(0).alias("p"), F.lit(1).alias("e"))
    u = a.unionByName(b).groupBy("uid").agg(F.max("p").alias("p"), F.max("e").alias("e"))
    return u.agg(F.count_if(F.col("p") + F.col("e") == 2).alias("both"), F.count_if(F.col("p") > F.col("e")).alias("only_publications"), F.count_if(F.col("e") > F.col("p")).alias("only_edges"))
