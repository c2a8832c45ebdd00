"""Scalar functions on text and packed metadata as column expressions (S1f-S19f). Null stays null."""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Python's white space (Java's \s lacks most of it).
BLANK = r"[\s\x1c-\x1f\x85\p{Z}]+"
# The patterns of LaTeX, HTML and copyright tails, in the order in which they are removed.
LATEX = (r"\$\$[^$]*\$\$|\\\[[^\]]*\\\]", r"\$[^$]*\$|\\\([^)]*\\\)", r"\\[a-zA-Z]+\s*(?:\[[^\]]*\])?\s*\{[^{}]*\}", r"\\[a-zA-Z]+\b")
HTML = r"<[^<>]{1,40}>"
COPYRIGHT = r"(?i)\(c\)\s*\d{4}.*?$|©\s*\d{4}.*?$|copyright\s*\(c\)\s*\d{4}.*?$|all rights reserved\.?\s*$"
# Words of sentences that report a finding, and abbreviations that end no sentence.
FINDING = "show shows showed shown find finds found demonstrate demonstrates demonstrated observe observes observed reveal reveals revealed indicate indicates indicated suggest suggests suggested conclude concludes concluded confirm confirms confirmed prove proves proved proven result results".split()
ABBREVIATIONS = ["e.g.", "i.e.", "et al.", "Fig.", "Figs.", "Eq.", "Eqs.", "Ref.", "Refs.", "vs.", "approx.", "ca.", "No.", "Phys.", "Rev.", "Lett.", "Sec.", "Dr.", "Prof.", "cf.", "resp.", "Vol.", "pp."]
# Other names of countries.
COUNTRY_ALIASES = {
    "USA": "USA", "U S A": "USA", "U.S.A.": "USA", "UNITED STATES": "USA", "UNITED STATES OF AMERICA": "USA", "UK": "UK", "U.K.": "UK", "UNITED KINGDOM": "UK",
    "ENGLAND": "UK", "SCOTLAND": "UK", "WALES": "UK", "NORTHERN IRELAND": "UK", "RUSSIA": "RUS", "RUSSIAN FEDERATION": "RUS", "SOUTH KOREA": "KOR", "KOREA": "KOR",
    "REPUBLIC OF KOREA": "KOR", "CZECH REPUBLIC": "CZE", "CZECHIA": "CZE", "PEOPLES R CHINA": "CHN", "PEOPLE'S REPUBLIC OF CHINA": "CHN", "CHINA": "CHN", "TAIWAN": "TWN", "REPUBLIC OF CHINA": "TWN",
}


def without_formulas(c: Column) -> Column:
    for p in LATEX:
        c = F.regexp_replace(c, p, " ")
    return c


def without_tags(c: Column) -> Column:
    return F.regexp_replace(c, HTML, " ")


def without_copyright(c: Column) -> Column:
    return F.rtrim(F.regexp_replace(c, COPYRIGHT, ""))


@F.pandas_udf(StringType())
def _compatible(values: pd.Series) -> pd.Series:
    known = {v: unicodedata.normalize("NFKC", v) for v in values.dropna().unique()}
    return values.map(known).astype(object).where(values.notna(), None)


def compatible(c: Column) -> Column:
    """S5f: compatibility composed form; plain ASCII never leaves the JVM."""
    return F.coalesce(_compatible(F.when(c.rlike(r"[^\x00-\x7f]"), c)), c)


def collapse_blanks(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, BLANK, " "))


def tidy_blanks(c: Column) -> Column:
    """S5f: blanks collapsed and none before a punctuation mark."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, BLANK, " "), r" +([,.;:!?])", "$1"))


def cleaned(c: Column) -> Column:
    """S1f: compatible characters, markup, formulas and copyright tails out, blanks tidied; null gives ''."""
    c = F.coalesce(c, F.lit(""))
    return tidy_blanks(without_copyright(without_tags(without_formulas(compatible(c)))))


def topic_text(title: Column, abstract: Column) -> Column:
    """S6f, S7f: title and abstract in lower case with letters, digits and hyphens only."""
    t = F.lower(F.concat(F.coalesce(title, F.lit("")), F.lit(". "), F.coalesce(abstract, F.lit(""))))
    return collapse_blanks(F.regexp_replace(t, r"[^a-z0-9\s-]", " "))


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, " "), lambda x: x != ""))


def clean_doctype(c: Column) -> Column:
    """S8f: the first packed type that is not 'early access article', else the first."""
    parts = F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")
    other = F.filter(parts, lambda x: F.lower(x) != "early access article")
    return F.coalesce(F.get(other, F.lit(0)), F.get(parts, F.lit(0)))


def packed_list(c: Column, sep: str = r"[|]", out: str = "; ") -> Column:
    """S9f: the non-empty entries of a packed field, joined by ``out``."""
    return F.array_join(F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != ""), out)


def normalise_country(c: Column) -> Column:
    """S11f: upper case without a trailing dot, by its usual name; null outside 2 to 49 characters."""
    key = F.regexp_replace(F.upper(F.trim(c)), r"\.+$", "")
    alias = F.create_map(*[F.lit(x) for kv in COUNTRY_ALIASES.items() for x in kv])
    return F.when(F.length(key).between(2, 49), F.coalesce(F.element_at(alias, key), key))


def reference_key(c: Column) -> Column:
    """S14f: the DOI of a cited reference in lower case, else its first three comma parts."""
    doi = F.lower(F.regexp_extract(c, r"(?i)DOI\s+(10\.\S+)", 1))
    return F.when(doi != "", doi).otherwise(F.upper(F.array_join(F.slice(F.transform(F.split(c, ","), lambda x: F.trim(x)), 1, 3), ", ")))


def present(c: Column) -> Column:
    """S19f: the value, null for the usual markers of a missing one."""
    return F.when(~F.lower(F.trim(c)).isin("", "nan", "none", "null", "n/a", "na"), F.trim(c))


def sentences(c: Column) -> Column:
    """S15f: sentences of a text. A piece ends at . ! ? before a capital, a digit or an opening bracket; pieces after one that ends in a
    listed abbreviation are joined to it again."""
    pieces = F.split(collapse_blanks(c), r"(?<=[.!?])\s+(?=[A-Z0-9(\[])")
    open_end = "(?:" + "|".join(re.escape(a) for a in ABBREVIATIONS) + ")$"
    last = lambda acc: F.element_at(acc, -1)
    goes_on = lambda acc: (F.size(acc) > 0) & F.coalesce(F.get(acc, F.size(acc) - 1), F.lit("")).rlike(open_end)
    joined = lambda acc, x: F.concat(F.slice(acc, F.lit(1), F.size(acc) - 1), F.array(F.concat_ws(" ", last(acc), x)))
    merged = F.aggregate(pieces, F.array().cast("array<string>"), lambda acc, x: F.when(goes_on(acc), joined(acc, x)).otherwise(F.array_append(acc, x)))
    return F.filter(merged, lambda x: x != "")


def is_finding(c: Column) -> Column:
    """S16f: a sentence that reports a finding."""
    return c.rlike(r"(?i)\b(" + "|".join(FINDING) + r")\b")


def marked(c: Column) -> Column:
    """The text in lower case with a bar for punctuation and other signs."""
    return F.regexp_replace(F.lower(c), r"[^a-z0-9\s'-]+", " | ")


def content_runs(c: Column, stop: list[str]) -> Column:
    """S17f: runs of content words: lower-case words between stop words and punctuation, as arrays."""
    words = F.filter(F.split(marked(c), r"\s+"), lambda x: x != "")
    cut = F.transform(words, lambda x: F.when(x.isin(*stop) | (x == "|"), F.lit("|")).otherwise(x))
    return F.filter(F.transform(F.split(F.array_join(cut, " "), r"(?: ?\| ?)+"), lambda s: F.filter(F.split(s, " "), lambda x: F.length(x) > 1)), lambda a: F.size(a) > 0)


def phrases(c: Column, stop: list[str]) -> Column:
    """S17f: the words and neighbouring pairs of content runs."""
    runs = content_runs(c, stop)
    pairs = lambda r: F.when(F.size(r) > 1, F.zip_with(F.slice(r, F.lit(1), F.size(r) - 1), F.slice(r, F.lit(2), F.size(r) - 1), lambda a, b: F.concat_ws(" ", a, b))).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(runs, lambda r: F.concat(r, pairs(r))))
