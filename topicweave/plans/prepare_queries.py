"""Queries and SQL for preparation and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from topicweave.functions import text as T
from topicweave.operators import indicators as I
from topicweave.plans import fixtures as X
from topicweave.plans import prepare as R
from topicweave.plans.indicator_queries import W, query, rounded

_LVL = "ctl AS (SELECT uid, " + ", ".join(f"min_by(trim(ctopiclabel), line_nr) FILTER (lower(trim(topic_type)) = '{x}') AS l_{x}" for x in ("macro", "meso", "micro")) + " FROM citation_topics WHERE lower(trim(ctopiclabel)) NOT IN ('', 'nan', 'none', 'null', 'n/a', 'na') GROUP BY 1)"
_AUP = """aup AS (SELECT uid, string_agg(coalesce(author, ''), '; ' ORDER BY seq) AS authors, string_agg(CASE WHEN orcid <> '' THEN concat_ws('/', author, orcid) ELSE '' END, '; ' ORDER BY seq) AS orcid_pairs
 FROM (SELECT *, row_number() OVER (PARTITION BY uid, seq ORDER BY mention_id) AS k FROM author_orcid) WHERE k = 1 GROUP BY 1)"""
_PACK = "CASE WHEN {c} IS NOT NULL THEN array_to_string(list_filter(list_transform(string_split({c}, '|'), lambda x: trim(x)), lambda x: x <> ''), '; ') END"
_TYPE = "coalesce(list_filter(dt, lambda x: lower(x) <> 'early access article')[1], dt[1])"


@query("prep_canonical", W(_LVL, _AUP, "tt AS (SELECT *, list_filter(list_transform(string_split(doc_type, '|'), lambda x: trim(x)), lambda x: x <> '') AS dt FROM pub)")
       + f"SELECT uid, phase, trim(title) AS title, trim(abstract) AS abstract, {_TYPE} AS doc_type, trim(source_title) AS source_title, {_PACK.format(c='author_keywords')} AS author_keywords, {_PACK.format(c='country_list')} AS countries, coalesce(times_cited, 0) AS times_cited, rtw, ctw, doi, l_macro AS ct_macro, l_meso AS ct_meso, l_micro AS ct_micro, authors, orcid_pairs FROM tt LEFT JOIN ctl USING (uid) LEFT JOIN aup USING (uid)")
def _canon(spark, d):
    """IO2, J1, P8, S8f, S9f, S25f, S26f, T8."""
    return R.canonical(X.pub(spark, d), X.table(spark, d, "citation_topics"), X.table(spark, d, "author_orcid")).drop("year", "country_count")


_BL = r"[\s\x1c-\x1f\x85\p{Z}]+"
#: Title and abstract as the topic steps read them.
TEXT_SQL = f"trim(regexp_replace(regexp_replace(lower(concat(coalesce(title, ''), '. ', coalesce(abstract, ''))), '[^a-z0-9\\s-]', ' ', 'g'), '{_BL}', ' ', 'g'))"


@query("prep_corpus", W(f"cp AS (SELECT uid, phase, year, {TEXT_SQL} AS text FROM pub WHERE year BETWEEN 2000 AND 2025 AND length(trim(abstract)) > 0)") + "SELECT uid, phase, year, text FROM cp WHERE len(list_filter(string_split(text, ' '), lambda x: x <> '')) >= 10")
def _corpus(spark, d):
    """IO5, P3-P5, S6f, S7f, S18f."""
    return R.corpus(X.pub(spark, d), 2000, 2025)


_CLEAN = "abstract"
for _p in T.LATEX:
    _CLEAN = f"regexp_replace({_CLEAN}, '{_p}', ' ', 'g')"
_CLEAN = f"regexp_replace({_CLEAN}, '{T.HTML}', ' ', 'g')"


@query("scalar_clean_text", "WITH " + X.PUB + f" SELECT uid, trim(regexp_replace(regexp_replace({_CLEAN}, '{_BL}', ' ', 'g'), ' +([,.;:!?])', '\\1', 'g')) AS cleaned FROM pub WHERE abstract IS NOT NULL")
def _clean(spark, d):
    """S2f, S3f, S5f: markup out, blanks tidied (compatible characters and the copyright tail are left, which SQL has no like for)."""
    return X.pub(spark, d).filter("abstract IS NOT NULL").select("uid", T.tidy_blanks(T.without_tags(T.without_formulas(F.col("abstract")))).alias("cleaned"))


@query("scalar_clean_text_full")
def _clean_full(spark, d):
    """S1f, S4f, S5f: the whole cleaning; without SQL, since compatibility forms are beyond it."""
    return X.pub(spark, d).filter("abstract IS NOT NULL").select("uid", T.cleaned(F.col("abstract")).alias("cleaned"))


@query("agg_artefacts", f"SELECT count(*) AS n_total, count(*) FILTER (regexp_matches(text, '{T.LATEX[3]}')) AS latex_cmd, count(*) FILTER (regexp_matches(text, '{T.LATEX[0]}') OR regexp_matches(text, '{T.LATEX[1]}')) AS inline_math, count(*) FILTER (regexp_matches(text, '{T.HTML}')) AS html_tag FROM documents WHERE length(text) > 0")
def _art(spark, d):
    """B27."""
    return R.artefacts(X.table(spark, d, "documents"), "text").drop("copyright_tail", "n_with_any")


_COLS = ["title", "abstract", "source_title", "author_keywords", "keywords_plus", "wos_categories", "doi", "affiliations", "country_list", "ct_macro", "rtw"]


@query("agg_completeness", W("one AS (SELECT count(*) AS n, " + ", ".join(f"count(*) FILTER (trim(CAST({c} AS VARCHAR)) <> '') AS {c}" for c in _COLS) + " FROM pub)") + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", {c} AS filled, round({c} / CAST(n AS DOUBLE), 6) AS share FROM one" for c in _COLS))
def _compl(spark, d):
    """B26, P10."""
    return rounded(R.completeness(X.pub(spark, d), _COLS))


@query("filter_coverage_masks", W("pt AS (SELECT phase, topic, " + ", ".join(f"count(*) FILTER (length(trim(CAST({c} AS VARCHAR))) > 0) AS {c}" for c in _COLS[:8]) + " FROM pub WHERE topic >= 0 GROUP BY 1, 2)") + " UNION ALL ".join(f"SELECT phase, '{c}' AS \"column\", round(avg(CASE WHEN {c} >= 10 THEN 1.0 ELSE 0.0 END), 6) AS topics_ok, avg(CASE WHEN {c} >= 10 THEN 1.0 ELSE 0.0 END) >= 0.9 AS passed FROM pt GROUP BY 1" for c in _COLS[:8]))
def _cov(spark, d):
    """P16."""
    return rounded(R.coverage(X.pub(spark, d), _COLS[:8]))


@query("prep_edges", "SELECT DISTINCT trim(uid) AS uid, trim(uid_ref) AS uid_ref FROM reference_edges WHERE trim(uid) <> '' AND trim(uid_ref) <> ''")
def _edges(spark, d):
    """IO6, IO7."""
    return X.table(spark, d, "reference_edges").select(F.trim("uid").alias("uid"), F.trim("uid_ref").alias("uid_ref")).filter("uid <> '' AND uid_ref <> ''").distinct()


@query("join_anti_unknown_targets", "SELECT DISTINCT uid_ref FROM reference_edges WHERE uid_ref IS NOT NULL AND uid_ref NOT IN (SELECT uid FROM publications) AND uid_ref NOT IN (SELECT uid FROM cited_core)")
def _anti(spark, d):
    """Targets that stand in no table."""
    known = X.table(spark, d, "publications").select("uid").unionByName(X.table(spark, d, "cited_core").select("uid"))
    return X.table(spark, d, "reference_edges").select("uid_ref").filter("uid_ref IS NOT NULL").distinct().join(known.withColumnRenamed("uid", "uid_ref"), "uid_ref", "left_anti")


_ALIAS = " ".join(f"WHEN '{k.replace(chr(39), chr(39) * 2)}' THEN '{v}'" for k, v in T.COUNTRY_ALIASES.items())


@query("scalar_countries_of_addresses", W("ad AS (SELECT uid, regexp_replace(upper(trim(string_split(trim(x), ',')[-1])), '\\.+$', '') AS k FROM (SELECT uid, unnest(string_split(addresses, ';')) AS x FROM pub))") + f"SELECT CASE k {_ALIAS} ELSE k END AS country, count(DISTINCT uid) AS n FROM ad WHERE length(k) BETWEEN 2 AND 49 GROUP BY 1")
def _ctry(spark, d):
    """S11f, A12's fallback."""
    a = X.pub(spark, d).select("uid", F.explode(F.split("addresses", ";")).alias("x"))
    a = a.select("uid", T.normalise_country(F.element_at(F.split(F.trim("x"), ","), -1)).alias("country")).filter("country IS NOT NULL").distinct()
    return a.groupBy("country").agg(F.count(F.lit(1)).alias("n"))


@query("scalar_review_flag", "WITH " + X.PUB + " SELECT uid, coalesce(len(list_filter(string_split_regex(doc_type, '[;|]'), lambda p: lower(trim(p)) = 'review')) > 0, false) AS review FROM pub")
def _rev(spark, d):
    """S10f."""
    return X.pub(spark, d).select("uid", I.is_review(F.col("doc_type")).alias("review"))


@query("scalar_author_keys", W(X.AUTHORS) + "SELECT uid, seq, CASE WHEN regexp_full_match(orcid, '[0-9]{4}-[0-9]{4}-[0-9]{4}-[0-9]{3}[0-9X]') THEN orcid ELSE lower(regexp_replace(trim(author), '\\s+', ' ', 'g')) END AS key, CASE WHEN length(trim(string_split(orcid, '/')[-1])) > 0 THEN trim(string_split(orcid, '/')[-1]) ELSE trim(author) END AS mention FROM au")
def _keys(spark, d):
    """S12f, S13f: the key of a person, and the key that A10 counts mentions by."""
    a, o = F.col("author"), F.col("orcid")
    return X.authors(spark, d).select("uid", "seq", I.author_key(a, o).alias("key"), I.mention_key(a, o).alias("mention"))


@query("scalar_reference_keys", "WITH r AS (SELECT DISTINCT uid_ref, CASE WHEN ascii(right(uid_ref, 1)) % 2 = 0 THEN concat('Author A, 2010, J Phys, V1, DOI 10.1/', uid_ref) ELSE concat('Author B , 2011, ', uid_ref, ', V2') END AS t FROM reference_edges WHERE uid_ref IS NOT NULL)"
       + " SELECT uid_ref, CASE WHEN regexp_extract(t, '(?i)DOI\\s+(10\\.\\S+)', 1) <> '' THEN lower(regexp_extract(t, '(?i)DOI\\s+(10\\.\\S+)', 1)) ELSE upper(array_to_string(list_transform(string_split(t, ',')[1:3], lambda x: trim(x)), ', ')) END AS key FROM r")
def _refkeys(spark, d):
    """S14f: keys of cited references, whose texts are made of the ids here, since the tables have none."""
    r = X.table(spark, d, "reference_edges").select("uid_ref").filter("uid_ref IS NOT NULL").distinct()
    even = F.ascii(F.right("uid_ref", F.lit(1))) % 2 == 0
    t = F.when(even, F.concat(F.lit("Author A, 2010, J Phys, V1, DOI 10.1/"), "uid_ref")).otherwise(F.concat(F.lit("Author B , 2011, "), "uid_ref", F.lit(", V2")))
    return r.select("uid_ref", T.reference_key(t).alias("key"))


def _shielded(c: str) -> str:
    for a in T.ABBREVIATIONS:
        c = f"replace({c}, '{a}', '{a.replace('.', chr(1))}')"
    return c


#: Sentences of abstracts: (uid, phase, topic, nr, sentence).
SENTENCES = "se AS (SELECT uid, phase, topic, generate_subscripts(l, 1) - 1 AS nr, unnest(l) AS sentence FROM (SELECT uid, phase, topic, list_filter(list_transform(string_split(regexp_replace(" + _shielded(f"trim(regexp_replace(abstract, '{_BL}', ' ', 'g'))") + ", '([.!?])\\s+([A-Z0-9(\\[])', '\\1' || chr(2) || '\\2', 'g'), chr(2)), lambda x: trim(replace(x, chr(1), '.'))), lambda x: x <> '') AS l FROM pub WHERE abstract IS NOT NULL))"
FINDS = "regexp_matches(sentence, '(?i)\\b(" + "|".join(T.FINDING) + ")\\b')"


@query("scalar_sentences", W(SENTENCES) + f"SELECT uid, CAST(nr AS INT) AS nr, sentence, {FINDS} AS finding FROM se")
def _sent(spark, d):
    """S15f, S16f: sentences of the abstracts and whether they report a finding."""
    s = X.pub(spark, d).select("uid", F.posexplode(T.sentences(F.col("abstract"))).alias("nr", "sentence"))
    return s.withColumn("finding", T.is_finding(F.col("sentence")))


# Words that end a run of content words.
STOP = "a an and are as at be been by for from has have in into is it its of on or that the to under up we with without which".split()


def phrases_of(p):
    """The rows of ``p`` without texts, one per different phrase (``term``) of title and abstract."""
    of = lambda c: F.coalesce(T.phrases(F.col(c), STOP), F.array().cast("array<string>"))
    return p.withColumn("term", F.explode(F.array_distinct(F.concat(of("title"), of("abstract"))))).drop("title", "abstract")


@query("scalar_phrases")
def _phr(spark, d):
    """S17f: phrases of title and abstract."""
    p = phrases_of(X.pub(spark, d).select("uid", "title", "abstract"))
    return p.groupBy(F.col("term").alias("phrase")).agg(F.count(F.lit(1)).alias("n"))


@query("scalar_json_report", "WITH " + X.PUB + " SELECT phase, count(*) AS n, round(avg(rtw), 6) AS rtw FROM pub GROUP BY 1")
def _json(spark, d):
    """S24f: a report as JSON and back."""
    a = rounded(X.pub(spark, d).groupBy("phase").agg(F.count(F.lit(1)).alias("n"), F.avg("rtw").alias("rtw")))
    j = a.select(F.to_json(F.struct("phase", "n", "rtw")).alias("j")).select(F.from_json("j", "phase int, n long, rtw double").alias("r"))
    return j.select("r.*")
