"""Queries and SQL for the indicators (A1-A28), their kernels and the memberships."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicweave.operators import indicators as I
from topicweave.operators import kernels as K
from topicweave.operators.graph import reliable
from topicweave.plans import fixtures as X

Q: dict = {}
SQL: dict[str, str] = {}
K2 = I.KEYS


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            SQL[name] = sql
        return f

    return add


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns or [c for c, t in df.dtypes if t == "double"]})


W = X.with_sql
TOPICS = "tp AS (SELECT * FROM pub WHERE topic >= 0)"
MED = "med AS (SELECT phase, topic, median(year) AS m FROM tp WHERE year IS NOT NULL GROUP BY 1, 2)"
RATE = "rate AS (SELECT phase, topic, uid, year, coalesce(times_cited, 0) / CAST(greatest(2026 - year, 1) AS DOUBLE) AS r FROM tp WHERE year IS NOT NULL)"
SHARE = """yt AS (SELECT phase, topic, year, count(*) AS n FROM tp WHERE year IS NOT NULL GROUP BY 1, 2, 3),
yy AS (SELECT phase, year, sum(n) AS total FROM yt GROUP BY 1, 2),
sh AS (SELECT s.phase, s.topic, yy.year, CAST(coalesce(n, 0) AS BIGINT) AS n, coalesce(n, 0) / CAST(total AS DOUBLE) AS share
 FROM (SELECT DISTINCT phase, topic FROM yt) s JOIN yy ON yy.phase = s.phase LEFT JOIN yt ON yt.phase = s.phase AND yt.topic = s.topic AND yt.year = yy.year)"""
TEM = """tem AS (SELECT phase, topic, avg(share) AS avg_share, CASE WHEN max(year) FILTER (share > 0) > min(year) FILTER (share > 0)
 THEN pow(max_by(share, year) FILTER (share > 0) / min_by(share, year) FILTER (share > 0), 1.0 / (max(year) FILTER (share > 0) - min(year) FILTER (share > 0))) - 1 ELSE 0.0 END AS growth FROM sh GROUP BY 1, 2)"""


def gini_sql(name: str, source: str, value: str) -> str:
    return f"""{name} AS (SELECT phase, topic, count(*) AS n, sum({value}) AS s, CASE WHEN sum({value}) = 0 THEN 0.5
 ELSE 2 * sum(i * CAST({value} AS DOUBLE)) / (count(*) * CAST(sum({value}) AS DOUBLE)) - (count(*) + 1.0) / count(*) END AS g
 FROM (SELECT *, row_number() OVER (PARTITION BY phase, topic ORDER BY {value}) AS i FROM {source}) GROUP BY 1, 2)"""


def ruzicka_sql(name: str, source: str, keys: str, side: str) -> str:
    """``source`` has keys, side ('a'/'b'), term; null distance if a side is empty."""
    return f"""{name}_c AS (SELECT {keys}, {side} AS side, term, count(*) AS n FROM {source} GROUP BY ALL),
{name}_p AS (SELECT *, n / CAST(sum(n) OVER (PARTITION BY {keys}, side) AS DOUBLE) AS p FROM {name}_c),
{name}_t AS (SELECT {keys}, term, coalesce(max(p) FILTER (side = 'a'), 0) AS pa, coalesce(max(p) FILTER (side = 'b'), 0) AS pb FROM {name}_p GROUP BY ALL),
{name} AS (SELECT {keys}, CASE WHEN sum(pa) > 0 AND sum(pb) > 0 THEN 1 - sum(least(pa, pb)) / sum(greatest(pa, pb)) END AS d FROM {name}_t GROUP BY ALL)"""


CTE = {
    "eo1": [TOPICS, MED, X.terms_sql("kw"), "hk AS (SELECT kw.phase, kw.topic, term, CASE WHEN year <= m THEN 'a' ELSE 'b' END AS half FROM kw JOIN med USING (phase, topic) WHERE year IS NOT NULL)",
            ruzicka_sql("rz", "hk", "phase, topic", "half"), "eo1 AS (SELECT phase, topic, CASE WHEN n >= 4 THEN d END AS eo1 FROM (SELECT phase, topic, count(*) AS n FROM tp GROUP BY 1, 2) LEFT JOIN rz USING (phase, topic))"],
    "ds2": [TOPICS, X.terms_sql("kw"), "ys AS (SELECT phase, topic, year, lead(year) OVER (PARTITION BY phase, topic ORDER BY year) AS nx FROM (SELECT DISTINCT phase, topic, year FROM tp WHERE year IS NOT NULL))",
            "pk AS (SELECT kw.phase, kw.topic, ys.year AS y0, term, CASE WHEN kw.year = ys.year THEN 'a' ELSE 'b' END AS half FROM kw JOIN ys ON kw.phase = ys.phase AND kw.topic = ys.topic AND (kw.year = ys.year OR kw.year = ys.nx) WHERE nx IS NOT NULL)",
            ruzicka_sql("r2", "pk", "phase, topic, y0", "half"), "ds2 AS (SELECT phase, topic, CASE WHEN n >= 3 THEN d END AS ds2 FROM (SELECT phase, topic, count(*) AS n FROM ys GROUP BY 1, 2) LEFT JOIN (SELECT phase, topic, avg(d) AS d FROM r2 GROUP BY 1, 2) USING (phase, topic))"],
    "eo3": [X.VEC, "lv AS (SELECT phase, topic, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM vec WHERE topic >= 0)",
            "ls AS (SELECT phase, topic, i, sum(x) AS s, sum(x * x) AS q, count(*) AS n FROM lv GROUP BY 1, 2, 3)", "eo3 AS (SELECT phase, topic, CASE WHEN max(n) < 3 THEN 0.5 ELSE 1 - (sum(s * s) - sum(q)) / (max(n) * (max(n) - 1.0)) END AS eo3 FROM ls GROUP BY 1, 2)"],
    "pe1": [TOPICS, SHARE, TEM, "pe1 AS (SELECT phase, topic, 1 - (rank() OVER (PARTITION BY phase ORDER BY avg_share) + (count(*) OVER (PARTITION BY phase, avg_share) - 1) / 2.0) / count(*) OVER (PARTITION BY phase) AS pe1 FROM tem)"],
    "pe2": [X.VEC, "dv AS (SELECT phase, topic, uid, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM vec)",
            "ct AS (SELECT phase, topic, i, avg(x) AS m, count(*) AS n FROM dv WHERE topic >= 0 GROUP BY 1, 2, 3)", "nn AS (SELECT phase, count(*) AS total FROM vec GROUP BY 1)",
            "dd AS (SELECT ct.phase, ct.topic, max(ct.n) AS n, dv.uid, dv.topic AS own, round(sqrt(sum((x - m) * (x - m))), 9) AS d FROM ct JOIN dv ON ct.phase = dv.phase AND ct.i = dv.i GROUP BY ct.phase, ct.topic, dv.uid, dv.topic)",
            "dr AS (SELECT dd.*, total, row_number() OVER (PARTITION BY dd.phase, topic ORDER BY d, uid) AS r FROM dd JOIN nn USING (phase))", "pe2 AS (SELECT phase, topic, CASE WHEN max(n) < 3 THEN 0.5 ELSE avg(CASE WHEN own < 0 THEN 1.0 ELSE 0.0 END) END AS pe2 FROM dr WHERE r <= least(2 * n, total) GROUP BY 1, 2)"],
    "pe3": [TOPICS, "jj AS (SELECT phase, source_title, count(*) AS size FROM pub WHERE source_title <> '' GROUP BY 1, 2)", "jm AS (SELECT phase, median(size) AS m FROM jj GROUP BY 1)",
            "pe3 AS (SELECT tp.phase, topic, CASE WHEN count(size) < 2 THEN 0.5 ELSE avg(CASE WHEN size <= m THEN 1.0 WHEN size > m THEN 0.0 END) END AS pe3 FROM tp LEFT JOIN jj USING (phase, source_title) LEFT JOIN jm ON jm.phase = tp.phase GROUP BY 1, 2)"],
    "ds1": [TOPICS, "ds1 AS (SELECT phase, topic, coalesce(least(1.0, greatest(0.0, (avg(year) - 2000) / 25.0)), 0.5) AS ds1 FROM tp GROUP BY 1, 2)"],
    "ds3": [TOPICS, "rv AS (SELECT phase, topic, CASE WHEN doc_type IS NOT NULL THEN CAST(len(list_filter(string_split_regex(doc_type, '[;|]'), lambda p: lower(trim(p)) = 'review')) > 0 AS INT) END AS r FROM tp)",
            "ds3 AS (SELECT phase, topic, 1 - (coalesce(sum(r), 0) + 10.0 * (SELECT avg(r) FROM rv v WHERE v.phase = rv.phase)) / (count(r) + 10.0) AS ds3 FROM rv GROUP BY 1, 2)"],
    "di1": [X.AUTHORS, "ak AS (SELECT phase, topic, CASE WHEN length(trim(string_split(orcid, '/')[-1])) > 0 THEN trim(string_split(orcid, '/')[-1]) ELSE trim(author) END AS a FROM au WHERE topic >= 0)",
            "ac AS (SELECT phase, topic, a, count(*) AS n FROM ak WHERE a <> '' GROUP BY 1, 2, 3)", gini_sql("ag", "ac", "n"), "di1 AS (SELECT phase, topic, CASE WHEN s < 2 THEN 1.0 ELSE least(1.0, greatest(0.0, g)) END AS di1 FROM ag)"],
    "di2": [TOPICS, X.terms_sql("inst"), "di2 AS (SELECT phase, topic, CASE WHEN coalesce(m, 0) < 2 THEN 1.0 ELSE 1 / (1 + ln(1 + k / CAST(n AS DOUBLE))) END AS di2 FROM (SELECT phase, topic, count(*) AS n FROM tp GROUP BY 1, 2) LEFT JOIN (SELECT phase, topic, count(DISTINCT term) AS k, count(*) AS m FROM inst GROUP BY 1, 2) USING (phase, topic))"],
    "di3": [TOPICS, X.terms_sql("ctry"), "cc AS (SELECT phase, topic, term, count(DISTINCT uid) AS n FROM ctry GROUP BY 1, 2, 3)", "di3 AS (SELECT phase, topic, CASE WHEN coalesce(sum(n), 0) < 2 THEN 1.0 ELSE sum(n * CAST(n AS DOUBLE)) / (sum(n) * CAST(sum(n) AS DOUBLE)) END AS di3 FROM (SELECT DISTINCT phase, topic FROM tp) LEFT JOIN cc USING (phase, topic) GROUP BY 1, 2)"],
    "di4": [TOPICS, RATE, gini_sql("rg", "rate", "r"), "di4 AS (SELECT phase, topic, CASE WHEN n < 3 THEN 0.5 ELSE g END AS di4 FROM rg)"],
    "ip1": [TOPICS, SHARE, TEM, "ip1 AS (SELECT phase, topic, least(1.0, greatest(0.0, (growth + 0.5) / 1.5)) AS ip1 FROM tem)"],
    "ip2": [TOPICS, MED, RATE, "ip2 AS (SELECT phase, topic, CASE WHEN n < 4 OR e IS NULL OR l IS NULL THEN NULL WHEN e = 0 THEN CASE WHEN l > 0 THEN 0.5 ELSE 0.0 END ELSE least(l / e, 2.0) / 2 END AS ip2 FROM (SELECT phase, topic, count(*) AS n, avg(r) FILTER (year <= m) AS e, avg(r) FILTER (year > m) AS l FROM rate JOIN med USING (phase, topic) GROUP BY 1, 2))"],
}


def entropy_sql(out: str, kind: str, least: int, below: float) -> list[str]:
    return [TOPICS, X.terms_sql(kind), f"ec_{kind} AS (SELECT phase, topic, term, count(*) AS n FROM {kind} GROUP BY 1, 2, 3)",
            f"""{out} AS (SELECT phase, topic, CASE WHEN coalesce(sum(n), 0) < {least} THEN {below} WHEN count(n) <= 1 THEN 0.0 ELSE (log2(sum(n)) - sum(n * log2(n)) / sum(n)) / log2(count(n)) END AS {out}
 FROM (SELECT DISTINCT phase, topic FROM tp) LEFT JOIN ec_{kind} USING (phase, topic) GROUP BY 1, 2)"""]  # fmt: skip


CTE["eo2"] = entropy_sql("eo2", "cat", 2, 0.0)
CTE["ip3"] = entropy_sql("ip3", "kwp", 5, 0.5)


class Parts:
    """The indicators of a folder's tables by name; ``kept`` writes the newest records once for all of them."""

    def __init__(self, spark: SparkSession, d: str, kept: bool = False, pub: DataFrame | None = None) -> None:
        self.spark, self.d, self.pub = spark, d, X.pub(spark, d) if pub is None else pub
        if kept:
            used = ["uid", "row_id", "phase", "topic", "year", "doc_type", "source_title", "times_cited", *[c for c, _, _ in X.LISTS.values()], F.length("abstract").alias("size")]
            self.pub = reliable(self.pub.select(*used))

    def terms(self, kind: str) -> DataFrame:
        return X.terms(self.pub, kind)

    def make(self, name: str) -> DataFrame:
        p, t = self.pub, self.terms
        tem = lambda: I.tem_metrics(I.yearly_shares(p))
        return {
            "eo1": lambda: I.keyword_volatility(p, t("kw")),
            "eo2": lambda: I.normalised_entropy(t("cat"), p, "eo2", 2, 0.0),
            "eo3": lambda: I.semantic_incoherence(X.vectors(self.spark, self.d, self.pub)),
            "pe1": lambda: I.relative_proportion(tem()),
            "pe2": lambda: I.noise_ratio(X.vectors(self.spark, self.d, self.pub)),
            "pe3": lambda: I.journal_specificity(p),
            "ds1": lambda: I.temporal_novelty(p),
            "ds2": lambda: I.terminological_instability(p, t("kw")),
            "ds3": lambda: I.review_absence(p),
            "di1": lambda: I.author_concentration(X.authors(self.spark, self.d, self.pub)),
            "di2": lambda: I.institutional_concentration(p, t("inst")),
            "di3": lambda: I.geographic_concentration(p, t("ctry")),
            "di4": lambda: I.citation_concentration(p),
            "ip1": lambda: I.growth_rate(tem()),
            "ip2": lambda: I.citation_momentum(p),
            "ip3": lambda: I.normalised_entropy(t("kwp"), p, "ip3", 5, 0.5),
        }[name]()


LABELS = {
    "eo1": "keyword_volatility", "eo2": "disciplinary_entropy", "eo3": "semantic_incoherence", "pe1": "relative_proportion", "pe2": "noise_ratio", "pe3": "journal_specificity",
    "ds1": "temporal_novelty", "ds2": "terminological_instability", "ds3": "review_absence", "di1": "author_concentration", "di2": "institutional_concentration",
    "di3": "geographic_concentration", "di4": "citation_concentration", "ip1": "growth_rate", "ip2": "citation_momentum", "ip3": "field_breadth",
}

for _n, _label in LABELS.items():
    query(f"agg_{_n}_{_label}", W(*CTE[_n]) + f"SELECT phase, topic, round({_n}, 6) AS {_n} FROM {_n}")(lambda spark, d, n=_n: rounded(Parts(spark, d).make(n)))


def indicators16(spark: SparkSession, d: str) -> DataFrame:
    """The indicator matrix of every topic and phase."""
    p = Parts(spark, d, kept=True)
    return I.all_indicators([p.make(n) for n in I.INDICATORS])


def scored(spark: SparkSession, d: str, keep: list[str] = I.INDICATORS) -> DataFrame:
    return I.dimension_scores(indicators16(spark, d))


def classified(spark: SparkSession, d: str) -> DataFrame:
    """The topics with indicators, memberships, margin and dominant class, kept in the checkpoint folder: a row per topic."""
    return reliable(I.memberships(scored(spark, d)))


_ALL_CTE = list(dict.fromkeys(c for n in I.INDICATORS for c in CTE[n]))
_IND = ", ".join(f"coalesce({n}, median({n}) OVER (PARTITION BY phase), 0.5) AS {n}" if n in ("eo1", "ds2", "ip2") else n for n in I.INDICATORS)
IND_SQL = [*_ALL_CTE, f"ind AS (SELECT phase, topic, {_IND} FROM eo1 " + " ".join(f"LEFT JOIN {n} USING (phase, topic)" for n in I.INDICATORS[1:]) + ")"]
_Z = {n: f"CASE WHEN stddev_samp({n}) OVER (PARTITION BY phase) > 0.01 THEN ({n} - avg({n}) OVER (PARTITION BY phase)) / stddev_pop({n}) OVER (PARTITION BY phase) END" for n in I.INDICATORS}
DIM_SQL = [*IND_SQL, "zs AS (SELECT phase, topic, " + ", ".join(f"{n}, {z} AS z_{n}" for n, z in _Z.items()) + " FROM ind)",
           "dims AS (SELECT *, " + ", ".join(f"coalesce(list_avg([{', '.join('z_' + i for i in m)}]), 0.0) AS {dim}" for dim, m in I.DIMENSIONS.items()) + " FROM zs)"]
_R = lambda c: f"({c} - median({c}) OVER (PARTITION BY phase)) / greatest((quantile_cont({c}, 0.75) OVER (PARTITION BY phase) - quantile_cont({c}, 0.25) OVER (PARTITION BY phase)) / 2, 1e-9)"
MEM_SQL = [*DIM_SQL, "rz5 AS (SELECT *, " + ", ".join(f"{_R(c)} AS r_{c}" for c in [*I.DIMENSIONS, *I.EC]) + " FROM dims)",
           """mm AS (SELECT *, 1 / (1 + exp(-(r_EO + r_WN + r_EP + r_DI) / 4)) AS m_ws, 1 / (1 + exp(-(0.5 * r_WP - (r_EO + r_WN + r_EP + r_DI) / 4))) AS m_trend,
 1 / (1 + exp(-(r_ds1 + r_ip1 + r_ip2 + r_ip3) / 4)) AS m_ec, 1 / (1 + exp((r_EO + r_WN + r_EP + r_DI + r_WP) / 5)) AS m_latent FROM rz5)""",
           """mem AS (SELECT *, list_sort([m_ws, m_trend, m_ec, m_latent], 'DESC')[1] - list_sort([m_ws, m_trend, m_ec, m_latent], 'DESC')[2] AS margin,
 CASE WHEN m_ws >= greatest(m_trend, m_ec, m_latent) THEN 'ws' WHEN m_trend >= greatest(m_ec, m_latent) THEN 'trend' WHEN m_ec >= m_latent THEN 'ec' ELSE 'latent' END AS dominant FROM mm)"""]  # fmt: skip


@query("agg_indicators16", W(*IND_SQL) + "SELECT phase, topic, " + ", ".join(f"round({n}, 6) AS {n}" for n in I.INDICATORS) + " FROM ind")
def _ind(spark: SparkSession, d: str) -> DataFrame:
    return rounded(indicators16(spark, d))


@query("agg_dimension_scores", W(*DIM_SQL) + "SELECT phase, topic, " + ", ".join(f"round({n}, 5) AS {n}" for n in I.DIMENSIONS) + " FROM dims")
def _dims(spark: SparkSession, d: str) -> DataFrame:
    return rounded(scored(spark, d).select(*K2, *I.DIMENSIONS), digits=5)


@query("agg_memberships", W(*MEM_SQL) + "SELECT phase, topic, " + ", ".join(f"round({n}, 5) AS {n}" for n in ("m_ws", "m_trend", "m_ec", "m_latent", "margin")) + ", dominant FROM mem")
def _mem(spark: SparkSession, d: str) -> DataFrame:
    return rounded(I.memberships(scored(spark, d)).select(*K2, "m_ws", "m_trend", "m_ec", "m_latent", "margin", "dominant"), digits=5)


@query("agg_robust_z", W(TOPICS) + "SELECT uid, round((rtw - median(rtw) OVER (PARTITION BY phase)) / greatest((quantile_cont(rtw, 0.75) OVER (PARTITION BY phase) - quantile_cont(rtw, 0.25) OVER (PARTITION BY phase)) / 2, 1e-9), 6) AS z FROM tp WHERE rtw IS NOT NULL")
def _rz(spark: SparkSession, d: str) -> DataFrame:
    """A27."""
    return rounded(I.topics(X.pub(spark, d)).filter("rtw IS NOT NULL").select("uid", K.robust_z("rtw", ["phase"]).alias("z")))


@query("agg_pair_cosine", W(*CTE["eo3"][:3]) + "SELECT phase, topic, max(n) AS n, round((sum(s * s) - sum(q)) / (max(n) * (max(n) - 1.0)), 6) AS cosine FROM ls GROUP BY 1, 2 HAVING max(n) > 1")
def _pc(spark: SparkSession, d: str) -> DataFrame:
    """A14, S22f."""
    return rounded(K.pair_cosine(I.topics(X.vectors(spark, d)), K2, "embedding").filter("n > 1"))


@query("agg_keyword_jaccard", W(TOPICS, X.terms_sql("kw"), "ks AS (SELECT phase, topic, list(DISTINCT term) AS s FROM kw WHERE topic >= 0 GROUP BY 1, 2)")
       + "SELECT a.topic AS topic_a, b.topic AS topic_b, a.phase, round(len(list_intersect(a.s, b.s)) / CAST(len(list_distinct(list_concat(a.s, b.s))) AS DOUBLE), 6) AS jaccard FROM ks a JOIN ks b ON a.phase = b.phase AND a.topic < b.topic")
def _kj(spark: SparkSession, d: str) -> DataFrame:
    """Keyword sets of all topic pairs, from shared keywords (an equi-join on the keyword), not from pairs of sets."""
    t = I.topics(X.terms(X.pub(spark, d), "kw")).select(*K2, "term").distinct()
    size = t.groupBy(*K2).agg(F.count(F.lit(1)).alias("n"))
    a, b = t.withColumnRenamed("topic", "topic_a"), t.withColumnRenamed("topic", "topic_b")
    common = a.join(b, ["phase", "term"]).filter("topic_a < topic_b").groupBy("phase", "topic_a", "topic_b").agg(F.count(F.lit(1)).alias("c"))
    sa, sb = size.select("phase", F.col("topic").alias("topic_a"), F.col("n").alias("na")), size.select("phase", F.col("topic").alias("topic_b"), F.col("n").alias("nb"))
    pairs = sa.join(sb, "phase").filter("topic_a < topic_b").join(common, ["phase", "topic_a", "topic_b"], "left")
    c = F.coalesce("c", F.lit(0))
    return rounded(pairs.select("phase", "topic_a", "topic_b", (c / (F.col("na") + F.col("nb") - c)).alias("jaccard")))


@query("agg_keyword_hhi", W(TOPICS, X.terms_sql("kw")) + "SELECT phase, topic, CAST(sum(n) AS BIGINT) AS total, round(sum(n * CAST(n AS DOUBLE)) / (sum(n) * CAST(sum(n) AS DOUBLE)), 6) AS hhi FROM (SELECT phase, topic, term, count(*) AS n FROM kw WHERE topic >= 0 GROUP BY 1, 2, 3) GROUP BY 1, 2")
def _kh(spark: SparkSession, d: str) -> DataFrame:
    """A20, A23."""
    return rounded(K.hhi(K.counts(I.topics(X.terms(X.pub(spark, d), "kw")), K2, "term"), K2))


@query("temporal_tem_metrics", W(TOPICS, SHARE, TEM) + "SELECT phase, topic, round(avg_share, 6) AS avg_share, round(growth, 6) AS growth FROM tem")
def _tem(spark: SparkSession, d: str) -> DataFrame:
    """B1, W7."""
    return rounded(I.tem_metrics(I.yearly_shares(X.pub(spark, d))))
