"""Queries and SQL for the candidate indicators."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicweave.functions import lexicon as L
from topicweave.functions import text as T
from topicweave.operators import candidates as C
from topicweave.operators import indicators as I
from topicweave.operators.graph import reliable
from topicweave.plans import fixtures as X
from topicweave.plans.indicator_queries import CTE, MED, SHARE, TOPICS, W, gini_sql, query, rounded
from topicweave.plans.prepare_queries import FINDS, SENTENCES, phrases_of

def _simpson(name: str, kind: str) -> list[str]:
    return [X.terms_sql(kind), f"{name}_x AS (SELECT phase, topic, uid, term, count(*) AS n FROM {kind} WHERE topic >= 0 GROUP BY 1, 2, 3, 4)",
            f"{name}_k AS (SELECT phase, topic, sum(nk * nk) AS a, sum(nk) AS total FROM (SELECT phase, topic, term, sum(n) AS nk FROM {name}_x GROUP BY 1, 2, 3) GROUP BY 1, 2)",
            f"{name}_b AS (SELECT phase, topic, sum(n * n) AS b FROM {name}_x GROUP BY 1, 2)", f"{name}_l AS (SELECT phase, topic, sum(ld * ld) AS l FROM (SELECT phase, topic, uid, sum(n) AS ld FROM {name}_x GROUP BY 1, 2, 3) GROUP BY 1, 2)",
            f"{name} AS (SELECT phase, topic, CASE WHEN total * total > l THEN (a - b) / CAST(total * total - l AS DOUBLE) END AS lam FROM {name}_k JOIN {name}_b USING (phase, topic) JOIN {name}_l USING (phase, topic))"]


_LAM = "SELECT phase, topic, round({v}, 6) AS {o} FROM s"
for _o, _kind, _label in (("di2_a1", "inst", "institution_lambda"), ("di3_a1", "ctry", "country_lambda")):
    query(f"cand_{_o}_{_label}", W(*_simpson("s", _kind)) + _LAM.format(v="lam", o=_o))(lambda spark, d, o=_o, k=_kind: rounded(C.K.simpson(C.K.counts(I.topics(X.terms(X.pub(spark, d), k)), [*I.KEYS, "uid"], "term"), I.KEYS, "uid", "term", o)))
for _o, _kind, _label in (("eo1_a1", "kw", "keyword_diversity"), ("ip3_a1", "kwp", "keyword_plus_diversity")):
    query(f"cand_{_o}_{_label}", W(*_simpson("s", _kind)) + _LAM.format(v="CASE WHEN lam > 0 THEN -ln(lam) END", o=_o))(lambda spark, d, o=_o, k=_kind: rounded(C.renyi(X.terms(X.pub(spark, d), k), o)))


@query("cand_eo2_a1_category_diversity", W(*_simpson("s", "cat"), "kk AS (SELECT phase, count(DISTINCT term) AS kinds FROM cat GROUP BY 1)") + "SELECT s.phase, topic, round(CASE WHEN lam > 0 THEN -ln(lam) / ln(kinds) END, 6) AS eo2_a1 FROM s JOIN kk ON s.phase = kk.phase")
def _eo2a1(spark, d):
    return rounded(C.renyi(X.terms(X.pub(spark, d), "cat"), "eo2_a1", True))


@query("cand_eo2_a2_chao_shen", W(X.terms_sql("cat"), "c AS (SELECT phase, topic, term, count(*) AS n FROM cat WHERE topic >= 0 GROUP BY 1, 2, 3)", "g AS (SELECT phase, topic, sum(n) AS tot, count(*) FILTER (n = 1) AS f1 FROM c GROUP BY 1, 2)",
         "p AS (SELECT c.phase, c.topic, tot, (1 - CASE WHEN f1 = tot THEN f1 - 1 ELSE f1 END / CAST(tot AS DOUBLE)) * n / tot AS pa FROM c JOIN g USING (phase, topic))", "kk AS (SELECT phase, count(DISTINCT term) AS kinds FROM cat GROUP BY 1)")
       + "SELECT p.phase, topic, round(CASE WHEN max(tot) >= 2 THEN -sum(pa * ln(pa) / (1 - pow(1 - pa, tot))) / ln(max(kinds)) END, 6) AS eo2_a2 FROM p JOIN kk ON p.phase = kk.phase GROUP BY 1, 2")
def _chao(spark, d):
    return rounded(C.chao_shen(X.terms(X.pub(spark, d), "cat")))


@query("cand_di3_a2_single_country", W(X.terms_sql("ctry")) + "SELECT phase, topic, round(CASE WHEN count(*) >= 2 THEN 1 - avg(CASE WHEN k >= 2 THEN 1.0 ELSE 0.0 END) END, 6) AS di3_a2 FROM (SELECT phase, topic, uid, count(DISTINCT term) AS k FROM ctry WHERE topic >= 0 GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _di3a2(spark, d):
    return rounded(C.single_country(X.terms(X.pub(spark, d), "ctry")))


@query("cand_eo3_a1_length_adjusted", W(X.VEC, "v AS (SELECT phase, topic, uid, embedding, (SELECT count(*) FROM (SELECT unnest(q.cuts) AS x) WHERE x <= size) AS bin FROM vec JOIN (SELECT phase, quantile_cont(size, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS cuts FROM vec GROUP BY 1) q USING (phase) WHERE size IS NOT NULL)",
         "s AS (SELECT a.phase, a.topic, a.uid AS ua, a.bin AS ba, b.bin AS bb, b.topic AS tb, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c FROM v a JOIN v b ON a.phase = b.phase AND a.uid <> b.uid)",
         "g AS (SELECT phase, ba, bb, avg(c) AS g FROM s GROUP BY 1, 2, 3)", "o AS (SELECT phase, topic, avg(c) AS o FROM s WHERE topic >= 0 AND tb = topic GROUP BY 1, 2)", "e AS (SELECT s.phase, s.topic, avg(g) AS e FROM s JOIN g USING (phase, ba, bb) WHERE s.topic >= 0 AND s.tb = s.topic GROUP BY 1, 2)")
       + "SELECT phase, topic, round(e - o, 5) AS eo3_a1 FROM e JOIN o USING (phase, topic)")
def _eo3a1(spark, d):
    return rounded(C.length_adjusted_incoherence(X.vectors(spark, d)), digits=5)


_PATTERN = L.pattern([*L.HEDGES, *L.HEDGE_PHRASES], [*L.BOOSTERS, *L.BOOSTER_PHRASES]).replace("'", "''")
_IS_HEDGE = "list_contains([" + ", ".join("'" + h.replace("'", "''").replace(" ", "  ") + "'" for h in (*L.HEDGES, *L.HEDGE_PHRASES)) + "], x)"


def _counts_sql(name: str, source: str, text: str) -> list[str]:
    """``name``: the rows of ``source`` with hedges, boosters and words of ``text``."""
    return [f"{name}_w AS (SELECT *, regexp_extract_all(lower({text}), '{L.WORD.replace(chr(39), chr(39) * 2)}') AS w FROM {source})", f"{name}_f AS (SELECT *, regexp_extract_all(' ' || array_to_string(w, '  ') || ' ', '{_PATTERN}', 1) AS f FROM {name}_w)",
            f"{name} AS (SELECT *, len(list_filter(f, lambda x: {_IS_HEDGE})) AS hedges, len(f) - len(list_filter(f, lambda x: {_IS_HEDGE})) AS boosters, len(w) AS words FROM {name}_f)"]


_A2 = [TOPICS, *_counts_sql("hd", "tp", "abstract"), "a2 AS (SELECT phase, topic, avg(1000.0 * hedges / words) AS eo4_a2, avg(1000.0 * boosters / words) AS booster FROM hd WHERE words >= 20 GROUP BY 1, 2)"]
# the stand-in for a model's score of a sentence: 1000 · (boosters - hedges) / words
_SCORED = [SENTENCES, "sp AS (SELECT * FROM se WHERE topic >= 0)", *_counts_sql("sw", "sp", "sentence"),
           f"sc AS (SELECT uid, phase, topic, nr, {FINDS} AS finding, CASE WHEN words > 0 THEN 1000.0 * (boosters - hedges) / words ELSE 0.0 END AS score, regexp_matches(sentence, '(?i)©|\\(c\\)|all rights reserved|copyright') AS notice FROM sw)",
           "sd AS (SELECT phase, topic, uid, coalesce(avg(score) FILTER (finding), max_by(score, nr)) AS a1, avg(score) AS a1r, coalesce(avg(score) FILTER (finding AND NOT notice), max_by(score, nr) FILTER (NOT notice)) AS a1b, avg(score) FILTER (NOT notice) AS a1rb FROM sc GROUP BY 1, 2, 3)",
           "a1 AS (SELECT phase, topic, -avg(a1) AS eo4_a1, -avg(a1r) AS eo4_a1r, -avg(a1b) AS eo4_a1b, -avg(a1rb) AS eo4_a1rb FROM sd GROUP BY 1, 2)"]


def _scored_sentences(spark, d):
    s = I.topics(X.pub(spark, d)).select(*I.KEYS, "uid", F.posexplode(T.sentences(F.col("abstract"))).alias("nr", "s"))
    s = s.withColumn("c", L.hedge_counts(F.col("s")))
    score = F.when(F.col("c.words") > 0, 1000.0 * (F.col("c.boosters") - F.col("c.hedges")) / F.col("c.words")).otherwise(0.0)
    return s.select(*I.KEYS, "uid", "nr", T.is_finding(F.col("s")).alias("finding"), score.alias("score"), F.col("s").rlike(r"(?i)©|\(c\)|all rights reserved|copyright").alias("notice"))


@query("cand_eo4_a2_hedges", W(*_A2) + "SELECT phase, topic, round(eo4_a2, 6) AS eo4_a2, round(booster, 6) AS booster FROM a2")
def _hedge(spark, d):
    """C6 and the booster density beside it."""
    return rounded(C.hedge_density(X.pub(spark, d)))


@query("cand_eo4_a1_findings", W(*_SCORED) + "SELECT phase, topic, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("eo4_a1", "eo4_a1r", "eo4_a1b", "eo4_a1rb")) + " FROM a1")
def _find(spark, d):
    """The certainty of a sentence is an input; boosters minus hedges per 1000 words stand for a model's score here."""
    return rounded(C.finding_scores(_scored_sentences(spark, d)))


@query("cand_eo4_r3_combined", W(*_A2, *_SCORED, "zz AS (SELECT phase, topic, (eo4_a1 - avg(eo4_a1) OVER (PARTITION BY phase)) / nullif(stddev_pop(eo4_a1) OVER (PARTITION BY phase), 0) AS z1, (eo4_a2 - avg(eo4_a2) OVER (PARTITION BY phase)) / nullif(stddev_pop(eo4_a2) OVER (PARTITION BY phase), 0) AS z2 FROM a1 JOIN a2 USING (phase, topic) WHERE eo4_a1 IS NOT NULL AND eo4_a2 IS NOT NULL)") + "SELECT phase, topic, round((z1 + z2) / 2, 6) AS eo4_r3 FROM zz")
def _r3(spark, d):
    """C8."""
    return rounded(C.combined_certainty(C.finding_scores(_scored_sentences(spark, d)), C.hedge_density(X.pub(spark, d))))


def _fixed_k_sql(k: int) -> str:
    return f"SELECT phase, topic, {k} AS k, round(avg(CASE WHEN own < 0 THEN 1.0 ELSE 0.0 END), 6) AS noise FROM dr WHERE r <= {k} GROUP BY 1, 2"


@query("cand_pe2_fixed_k", W(*CTE["pe2"][:-1]) + _fixed_k_sql(25) + " UNION ALL " + _fixed_k_sql(50))
def _pe2k(spark, d):
    """J16, PE2_A1, PE2_A2: noise among the 25 and 50 nearest records."""
    v = reliable(X.vectors(spark, d))
    one = lambda k: I.nearest_to_centroids(v, lambda n, corpus: F.least(F.lit(k).cast("long"), corpus)).select(*I.KEYS, F.lit(k).alias("k"), "noise")
    return rounded(one(25).unionByName(one(50)))


@query("cand_eo5_a1_semantic_diversity", W(X.VEC, X.terms_sql("kwp"), "w AS (SELECT DISTINCT kwp.phase, kwp.topic, uid, term, embedding FROM kwp JOIN vec USING (uid))", "d AS (SELECT phase, topic, uid, term, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM w)",
         "tw AS (SELECT DISTINCT phase, topic, term FROM w WHERE topic >= 0)", "o AS (SELECT tw.phase, tw.topic, tw.term, i, sum(x) AS s, sum(x * x) AS q, count(*) AS m FROM tw JOIN d ON d.phase = tw.phase AND d.term = tw.term AND d.topic <> tw.topic GROUP BY 1, 2, 3, 4)",
         "sd AS (SELECT phase, topic, term, -ln(greatest((sum(s * s) - sum(q)) / (max(m) * (max(m) - 1.0)), 0.001)) AS v FROM o GROUP BY 1, 2, 3 HAVING max(m) >= 5)", "pd AS (SELECT w.phase, w.topic, uid, avg(v) AS v, count(*) AS k FROM w JOIN sd USING (phase, topic, term) GROUP BY 1, 2, 3)")
       + "SELECT phase, topic, round(avg(v), 6) AS eo5_a1 FROM pd WHERE k >= 2 GROUP BY 1, 2")
def _eo5(spark, d):
    return rounded(C.semantic_diversity(X.terms(X.pub(spark, d), "kwp"), X.vectors(spark, d).select("uid", "embedding"), least_docs=5, least_words=2))


@query("cand_pe1_a1_visibility", W(TOPICS, SHARE, "v AS (SELECT phase, topic, sum(share * (1 - 0.05 * (2025 - year))) AS v FROM sh GROUP BY 1, 2)", "f AS (SELECT phase, topic, greatest(v, quantile_cont(v, 0.1) OVER (PARTITION BY phase)) AS v FROM v)")
       + "SELECT phase, topic, round(1 - (rank() OVER (PARTITION BY phase ORDER BY v) + (count(*) OVER (PARTITION BY phase, v) - 1) / 2.0) / count(*) OVER (PARTITION BY phase), 6) AS pe1_a1 FROM f")
def _pe1a1(spark, d):
    return rounded(C.visibility(I.yearly_shares(X.pub(spark, d))))


_RATES = "r AS (SELECT *, coalesce(times_cited, 0) / CAST(greatest(2026 - year, 1) AS DOUBLE) AS r FROM pub WHERE year IS NOT NULL AND source_title <> '')"


@query("cand_pe3_a1_inverse_prestige", W(TOPICS, _RATES, "cj AS (SELECT phase, source_title, trim(x) AS cat FROM (SELECT phase, source_title, unnest(string_split_regex(wos_categories, '[;|]')) AS x FROM pub) WHERE trim(x) <> '' AND source_title <> '')",
         "mc AS (SELECT phase, source_title, cat FROM (SELECT *, row_number() OVER (PARTITION BY phase, source_title ORDER BY n DESC, cat) AS k FROM (SELECT phase, source_title, cat, count(*) AS n FROM cj GROUP BY 1, 2, 3)) WHERE k = 1)",
         "pr AS (SELECT phase, source_title, round(avg(r), 9) AS p FROM r GROUP BY 1, 2)", "pc AS (SELECT phase, source_title, (rank() OVER (PARTITION BY phase, cat ORDER BY p) + (count(*) OVER (PARTITION BY phase, cat, p) - 1) / 2.0 - 0.5) / count(*) OVER (PARTITION BY phase, cat) AS pct FROM mc JOIN pr USING (phase, source_title))")
       + "SELECT tp.phase, topic, round(CASE WHEN count(*) >= 2 THEN avg(1 - pct) END, 6) AS pe3_a1 FROM tp JOIN pc USING (phase, source_title) GROUP BY 1, 2")
def _pe3a1(spark, d):
    p = X.pub(spark, d)
    return rounded(C.inverse_prestige(p, X.terms(p, "cat", ["phase", "source_title"]).filter("source_title <> ''")))


@query("cand_pe3_a2_niche_ses", W(TOPICS, "j AS (SELECT phase, source_title, count(*) AS size FROM pub WHERE source_title <> '' GROUP BY 1, 2)", "m AS (SELECT phase, median(size) AS med FROM j GROUP BY 1)", "x AS (SELECT pub.phase, topic, CASE WHEN size <= med THEN 1.0 ELSE 0.0 END AS niche FROM pub JOIN j USING (phase, source_title) JOIN m ON m.phase = pub.phase)",
         "g AS (SELECT phase, avg(niche) AS q, count(*) AS a FROM x GROUP BY 1)", "t AS (SELECT x.phase, topic, sum(niche) AS x, count(*) AS n, max(q) AS q, max(a) AS a FROM x JOIN g ON g.phase = x.phase WHERE topic >= 0 GROUP BY 1, 2)")
       + "SELECT phase, topic, round(CASE WHEN n * q * (1 - q) * (a - n) > 0 THEN (x - n * q) / sqrt(n * q * (1 - q) * (a - n) / (a - 1.0)) END, 6) AS pe3_a2 FROM t")
def _pe3a2(spark, d):
    return rounded(C.niche_ses(X.pub(spark, d)))


@query("cand_ds1_vitality", W(TOPICS) + "SELECT phase, topic, round(avg(1.0 / (2026 - year)), 6) AS ds1_a1, round(avg(CASE WHEN year > 2022 THEN 1.0 ELSE 0.0 END), 6) AS ds1_a2 FROM tp WHERE year IS NOT NULL GROUP BY 1, 2")
def _vit(spark, d):
    return rounded(C.vitality(X.pub(spark, d)))


@query("cand_ds2_a3_term_novelty", W(X.terms_sql("kw"), "t AS (SELECT DISTINCT phase, topic, uid, year, term FROM kw WHERE year IS NOT NULL)", "f AS (SELECT *, min(year) OVER (PARTITION BY phase, term) AS first FROM t)", "d AS (SELECT phase, topic, uid, year, avg(CASE WHEN first >= year - 2 THEN 1.0 ELSE 0.0 END) AS new FROM f GROUP BY 1, 2, 3, 4)",
         "e AS (SELECT *, new - avg(new) OVER (PARTITION BY phase, year) AS x FROM d)") + "SELECT phase, topic, round(avg(x), 6) AS ds2_a3 FROM e WHERE topic >= 0 GROUP BY 1, 2")
def _novel(spark, d):
    return rounded(C.term_novelty(X.terms(X.pub(spark, d), "kw")))


@query("cand_ds2_a3_text_novelty")
def _novel_text(spark, d):
    """C14, W10 on the phrases of title and abstract; the query above has it for keywords, with SQL."""
    return rounded(C.term_novelty(phrases_of(X.pub(spark, d).select("uid", *I.KEYS, "year", "title", "abstract"))))


@query("cand_ds3_a1_review_tail")
def _tail(spark, d):
    return rounded(C.review_tail(X.pub(spark, d)))


@query("cand_di1_a1_author_groups")
def _groups(spark, d):
    return rounded(C.author_groups(X.authors(spark, d), I.author_key(F.col("author"), F.col("orcid"))))


@query("cand_di4_citation_spread")
def _spread(spark, d):
    return rounded(C.citation_spread(X.pub(spark, d)))


@query("cand_ip1_a1_poisson_growth")
def _poisson(spark, d):
    return rounded(C.poisson_growth(I.yearly_shares(X.pub(spark, d))))


@query("cand_ip2_rate_ratios", W(TOPICS, MED, "h AS (SELECT tp.phase, tp.topic, year <= m AS e, CAST(coalesce(times_cited, 0) AS DOUBLE) AS c, greatest(2026 - year, 1) AS age FROM tp JOIN med USING (phase, topic) WHERE year IS NOT NULL)",
         "a AS (SELECT phase, topic, count(*) AS n, avg(c / age) FILTER (e) AS re, avg(c / age) FILTER (NOT e) AS rl, sum(c) FILTER (e) AS ce, sum(c) FILTER (NOT e) AS cl, sum(age) FILTER (e) AS ae, sum(age) FILTER (NOT e) AS al FROM h GROUP BY 1, 2)")
       + "SELECT phase, topic, round(CASE WHEN n >= 4 THEN ln((rl + 0.5) / (re + 0.5)) END, 6) AS ip2_a1, round(CASE WHEN n >= 4 AND cl > 0 AND ce > 0 THEN ln((cl / al) / (ce / ae)) END, 6) AS ip2_a2 FROM a")
def _ratios(spark, d):
    return rounded(C.rate_ratios(X.pub(spark, d)))


_PCT = "pc AS (SELECT *, (rank() OVER (PARTITION BY phase, year ORDER BY coalesce(times_cited, 0)) + (count(*) OVER (PARTITION BY phase, year, coalesce(times_cited, 0)) - 1) / 2.0) / count(*) OVER (PARTITION BY phase, year) AS pct FROM pub WHERE year IS NOT NULL)"


@query("win_percentile_in_year", W(_PCT) + "SELECT uid, round(pct, 6) AS pct FROM pc")
def _pct(spark, d):
    """W3, S24."""
    return rounded(C.yearly_percentiles(X.pub(spark, d)).select("uid", "pct"))


@query("cand_ip2_percentile_momentum", W(_PCT, "q AS (SELECT *, median(year) OVER (PARTITION BY phase, topic) AS m FROM pc WHERE topic >= 0)")
       + "SELECT phase, topic, round(CASE WHEN count(*) >= 4 THEN avg(pct) FILTER (year > m) - avg(pct) FILTER (year <= m) END, 6) AS ip2_a3, round(avg(pct) FILTER (year >= 2020), 6) AS ip2_a5, round(avg(CASE WHEN pct > 0.9 THEN 1.0 ELSE 0.0 END), 6) AS ip3_a2 FROM q GROUP BY 1, 2")
def _mom(spark, d):
    return rounded(C.percentile_momentum(X.pub(spark, d)))


@query("cand_ip2_a4_kendall", W(_PCT, "x AS (SELECT phase, topic, uid, year, round(pct, 9) AS pct FROM pc WHERE topic >= 0)", "k AS (SELECT a.phase, a.topic, sum(sign(b.pct - a.pct) * sign(b.year - a.year)) AS s, count(*) AS n, count(*) FILTER (a.year = b.year) AS ty, count(*) FILTER (a.pct = b.pct) AS tp FROM x a JOIN x b ON a.phase = b.phase AND a.topic = b.topic AND a.uid < b.uid GROUP BY 1, 2)")
       + "SELECT phase, topic, round(CASE WHEN n >= 6 AND sqrt(CAST(n - ty AS DOUBLE) * (n - tp)) > 0 THEN s / sqrt(CAST(n - ty AS DOUBLE) * (n - tp)) END, 6) AS ip2_a4 FROM (SELECT DISTINCT phase, topic FROM x) LEFT JOIN k USING (phase, topic)")
def _kendall(spark, d):
    return rounded(C.kendall(X.pub(spark, d)))


@query("join_outside_neighbours", W(X.VEC, "n AS (SELECT a.phase, a.topic, a.uid, count(*) AS k FROM vec a JOIN vec b ON a.phase = b.phase AND a.topic <> b.topic AND list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) >= 0.35 WHERE a.topic >= 0 GROUP BY 1, 2, 3)")
       + "SELECT a.phase, a.topic, round(avg(CASE WHEN coalesce(k, 0) >= 10 THEN 1.0 ELSE 0.0 END), 6) AS diag_a1 FROM vec a LEFT JOIN n USING (phase, topic, uid) WHERE a.topic >= 0 GROUP BY 1, 2")
def _outside(spark, d):
    return rounded(C.outside_neighbours(X.vectors(spark, d)))
