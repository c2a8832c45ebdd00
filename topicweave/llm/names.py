"""Problem 5: spellings that mean the same person or organisation.

Every distinct spelling is rewritten into canonical forms by rules - nicknames, initials, legal forms and abbreviations, token order,
one typing error - the forms are exploded and joined by equality, and a rewriting counts by its rarity, 1 / the number of
entities that share its forms: 1 decides alone; a lower one needs evidence (a common ORCID or organisation).

*Organisations*: tokens are folded, expanded, freed from legal forms and connectors, and sorted; equal token strings are one
organisation. Spellings whose letters differ by one insertion, deletion, substitution or swap (blanks count nothing) are joined to
the most frequent one that is used at least ``MISTYPED`` times as often; up to ``SLIPS`` uses are slips beside any not rarer one.

*Persons*: a spelling is parsed into surname, given name and further initials whatever its order. A person is a surname with a full
given name (and a middle initial where several are in use) and has four forms: with the given name or its initial, and with the middle
initial or without. A spelling has the forms that it may stand for, after typing errors are mended and short forms replaced.
A form that very many persons share is one row with their number; its persons meet a spelling only where both have a fact in common,
so a common surname costs no pairs of spellings and persons.

Everything works on distinct spellings with their counts; a spelling that a third of all rows use is one row. Null and blank names
give nothing; repeated rows count as repeated use and change no link. Results are pairs of spellings of one entity, each once.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicweave.llm.textform import folded_form, visible_form
from topicweave.operators.graph import connected_components, reliable

# Words of a surname that may stand elsewhere or be left out.
PARTICLES = frozenset("de der den di da du la le van von ten ter zu".split())
# Abbreviations of words in names of organisations.
EXPANSIONS = {
    "univ": "university", "inst": "institute", "ctr": "center", "centre": "center", "cent": "center", "natl": "national", "nat": "national",
    "lab": "laboratory", "labs": "laboratory", "laboratories": "laboratory", "acad": "academy", "sci": "sciences", "science": "sciences",
    "technol": "technology", "tech": "technology", "technical": "technology", "qu": "quantum", "quant": "quantum", "photon": "photonics",
    "dept": "department", "fac": "faculty", "coll": "college", "hosp": "hospital", "res": "research", "int": "international",
}
# Connectors, and legal forms of companies.
CONNECTORS = frozenset("of for f the and a an in at und fur".split())
LEGAL_FORMS = frozenset("gmbh mbh gesellschaft inc ltd llc corp co company ag sa bv plc kg limited incorporated corporation branch".split())
#: A mistyped form is at least so many times rarer than the right one.
MISTYPED = 3
#: So many uses of a mistyped organisation are slips beside any not rarer one.
SLIPS = 5
_UNDECOMPOSED = str.maketrans({"ø": "o", "ł": "l", "đ": "d", "ı": "i", "æ": "ae", "œ": "oe"})
_UMLAUT = re.compile(r"([aou])e+")


def fold_name(text: str) -> str:
    """Folded form without accents."""
    text = folded_form(text)
    if not text.isascii():
        text = "".join(c for c in unicodedata.normalize("NFKD", text.translate(_UNDECOMPOSED)) if not unicodedata.combining(c))
    return text


def organisation_form(name: str) -> str:
    """The sorted canonical tokens of the name of an organisation."""
    name = re.sub(r"\(([A-Z]{3,})\)", " ", visible_form(name))
    tokens = [EXPANSIONS.get(t, t) for t in re.findall(r"[^\W_]+", fold_name(name))]
    tokens = [x for t in tokens for x in (("technology", "university") if t == "tu" else (t,))]
    kept = [t for t in tokens if t not in CONNECTORS and t not in LEGAL_FORMS] or tokens
    return " ".join(sorted({_UMLAUT.sub(r"\1", t) for t in kept}))


def squashed(name: str) -> str:
    """The letters and digits of a name in order, folded."""
    return _UMLAUT.sub(r"\1", "".join(re.findall(r"[^\W_]+", fold_name(name))))


def near_forms(s: str) -> list[str]:
    """``s`` and every string that it becomes by leaving out one character: two strings one edit apart share one of these."""
    return sorted({s, *(s[:i] + s[i + 1 :] for i in range(len(s)))}) if len(s) > 3 else [s]


def one_edit(a: str, b: str) -> bool:
    """Equal, or one insertion, deletion, substitution or swap of neighbours apart."""
    if a == b:
        return True
    if abs(len(a) - len(b)) > 1:
        return False
    i = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    return a[i + 1 :] == b[i + 1 :] or a[i:] == b[i + 1 :] or a[i + 1 :] == b[i:] or (a[i : i + 2] == b[i : i + 2][::-1] and a[i + 2 :] == b[i + 2 :])


def parse_person(name: str) -> tuple[str, str, str]:
    """(surname, given name or '', initials): initials hold all given names, the full one included.

    >>> parse_person("de Huposon, Fenomar T."), parse_person("Kruvenen KA"), parse_person("Brika de Quugubos")
    (('huposon', 'fenomar', 'ft'), ('kruvenen', '', 'ka'), ('quugubos', 'brika', 'b'))
    """
    name = visible_form(name)
    bare = lambda words: [w for w in words if fold_name(w).strip(".") not in PARTICLES]
    shouted = name.isupper()
    if "," in name:
        last, _, given = name.partition(",")
        last, given = bare(last.split()) or last.split(), bare(given.split())
    else:
        words = bare(name.split()) or name.split()
        if len(words) > 1 and re.fullmatch(r"[^\W\d_]{1,3}", words[-1]) and words[-1].isupper() and not (shouted and len(words[-1]) > 2):
            last, given = words[:-1], [c + "." for c in words[-1]]
        elif len(words) > 1 and re.fullmatch(r"(?:[^\W\d_]\.-?)+", words[0]):
            given = [w for w in words if re.fullmatch(r"(?:[^\W\d_]\.-?)+", w)]
            last = [w for w in words if w not in given]
        else:
            last, given = words[-1:], words[:-1]
    parts: list[str] = []
    for w in given:
        if "." in w:
            parts += [p for p in re.split(r"[.-]", w) if p]
        elif w.isupper() and len(w) <= 3 and not shouted:
            parts += list(w)
        else:
            parts.append(w)
    parts = [p for p in map(fold_name, parts) if p]
    first = parts[0] if parts and len(parts[0]) > 1 else ""
    return fold_name(" ".join(last)), first, "".join(p[0] for p in parts)


_PERSON = T.StructType([T.StructField(c, T.StringType()) for c in ("last", "first", "initials")])


@F.pandas_udf(_PERSON)
def _person_udf(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([parse_person(n) for n in names], columns=["last", "first", "initials"])


@F.pandas_udf(T.StructType([T.StructField("form", T.StringType()), T.StructField("squash", T.StringType())]))
def _organisation_udf(names: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([(organisation_form(n), squashed(n)) for n in names], columns=["form", "squash"])


@F.pandas_udf(T.ArrayType(T.StringType()))
def _near_udf(forms: pd.Series) -> pd.Series:
    return forms.map(near_forms)


@F.pandas_udf(T.BooleanType())
def _one_edit_udf(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([one_edit(x, y) for x, y in zip(a, b, strict=True)], dtype=bool)


def _spellings(rows: DataFrame, column: str) -> DataFrame:
    """(name, n): kept, so that what is computed of a spelling is not pushed below its counting to every mention."""
    return reliable(rows.select(F.col(column).alias("name")).filter(F.length(F.trim("name")) > 0).groupBy("name").agg(F.count(F.lit(1)).alias("n")))


def _near_pairs(nodes: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """Pairs (…_a, …_b) of different nodes whose ``text`` is at most one edit apart; by equal near forms, then verified."""
    forms = nodes.select(*keep, text, F.explode(_near_udf(F.col(text))).alias("near"))
    forms = forms.withColumn("near", F.xxhash64("near"))
    a = forms.select("near", *[F.col(c).alias(f"{c}_a") for c in {*keep, text}])
    b = forms.select("near", *[F.col(c).alias(f"{c}_b") for c in {*keep, text}])
    pairs = a.join(b, "near").filter(F.col(f"{keep[0]}_a") != F.col(f"{keep[0]}_b")).drop("near").distinct()
    return pairs.filter(_one_edit_udf(F.col(f"{text}_a"), F.col(f"{text}_b")))


def organisations(rows: DataFrame, column: str) -> DataFrame:
    """(name, entity): every distinct spelling with the organisation it means, which its canonical form alone decides."""
    s = _spellings(rows, column).withColumn("p", _organisation_udf("name")).select("name", "n", "p.form", "p.squash")
    s = reliable(s.filter(F.length("form") > 0))
    groups = s.groupBy("form").agg(F.sum("n").alias("total"))
    nodes = s.join(groups, "form").select("form", "squash", "n", "total")
    # by the letters of a spelling, and by the letters of its canonical tokens
    by_form = groups.withColumn("squash", F.regexp_replace("form", " ", ""))
    about = ["form", "total"]
    near = _near_pairs(nodes, "squash", about).unionByName(_near_pairs(by_form, "squash", about)).select(*[f"{c}_{x}" for c in about for x in "ab"]).distinct()
    # shares of use, which do not grow with the data
    rarer = f"total_a * {MISTYPED} <= total_b OR total_a <= {SLIPS} AND (total_a < total_b OR total_a = total_b AND form_a > form_b)"
    typed = near.filter(f"form_a <> form_b AND ({rarer})")
    # a rare form goes to one other only: the most frequent one it may stand for
    best = typed.groupBy("form_a").agg(F.max(F.struct("total_b", "form_b")).alias("m")).select(F.col("form_a").alias("a"), F.col("m.form_b").alias("b"))
    member = connected_components(best, "a", "b").withColumnRenamed("node", "form")
    return s.join(member, "form", "left").select("name", F.coalesce("component", "form").alias("entity"))


def persons(rows: DataFrame, column: str, evidence: list[tuple[Column, str]], short_forms: DataFrame, given: str, short: str) -> DataFrame:
    """(name, entity, score): every distinct spelling with each person that uses it; a spelling of two persons has two rows.

    ``evidence`` are columns of ``rows`` (an ORCID, an organisation) with a name each; ``short_forms`` is a table of given
    names and their short forms. ``score`` is the rarity of the rewriting, 1 over the persons that share the spelling's forms, or,
    where facts decide, the person's part of the facts that the spelling shares with any of them (an ORCID counts twice). A person
    with shared facts is taken; without any, the spelling goes to the one that is used most, at its rarity. Spellings that fit
    nobody are persons by surname and initials, at score 1.
    """
    s = _spellings(rows, column).withColumn("p", _person_udf("name")).select("name", "n", "p.last", "p.first", "p.initials")
    s = reliable(s.filter(F.length("last") > 0))
    nick = short_forms.select(F.lower(F.trim(F.col(given))).alias("given"), F.lower(F.trim(F.col(short))).alias("first")).filter("given <> '' AND first <> ''").distinct()
    # a given name is mistyped if it is in no list and another one, one edit away and three times as common, has the surname
    full = s.filter("first <> ''")
    used = full.groupBy("first").agg(F.sum("n").alias("uses"))
    nodes = full.groupBy("last", "first").agg(F.sum("n").alias("n")).join(used, "first")
    listed = nick.select(F.col("given").alias("first")).unionByName(nick.select("first")).distinct().withColumn("listed", F.lit(True))
    nodes = nodes.join(listed, "first", "left").withColumn("listed", F.coalesce("listed", F.lit(False)))
    nodes = nodes.withColumn("key", F.concat_ws("|", "last", "first"))
    about = ["key", "last", "first", "n", "uses", "listed"]
    near = _near_pairs(nodes.select(*about), "key", about)
    slip = F.when(F.col("last_a") == F.col("last_b"), ~F.col("listed_a") & (F.col("uses_a") * MISTYPED < F.col("uses_b"))).otherwise(F.col("first_a") == F.col("first_b"))
    typed = near.filter(slip & (F.col("n_a") <= F.col("n_b")) & ((F.col("n_a") < F.col("n_b")) | (F.col("last_a") == F.col("last_b"))))
    typed = typed.groupBy("key_a").agg(F.max(F.struct("n_b", "last_b", "first_b")).alias("m")).select(F.col("key_a").alias("key"), F.col("m.last_b").alias("to_last"), F.col("m.first_b").alias("to_first"))
    nodes = reliable(nodes.join(typed, "key", "left"))
    # spellings with the surname and given name they stand for
    fixed = s.join(nodes.select("last", "first", "to_last", "to_first"), ["last", "first"], "left")
    fixed = fixed.select("name", "n", F.coalesce("to_last", "last").alias("last"), F.coalesce("to_first", "first").alias("first"), F.coalesce(F.substring("initials", 2, 9), F.lit("")).alias("mid"), F.when(F.col("first") == "", F.substring("initials", 1, 1)).alias("initial"))
    fixed = fixed.join(nick.select("first").distinct().withColumn("is_short", F.lit(True)), "first", "left")
    long_form = fixed.filter("first <> '' AND is_short IS NULL")
    people = long_form.groupBy("last", "first").agg(F.collect_set(F.when(F.col("mid") != "", F.col("mid"))).alias("mids"), F.sum("n").alias("weight"))
    people = people.select("last", "first", "weight", F.explode(F.when(F.size("mids") == 0, F.array(F.lit(""))).otherwise(F.col("mids"))).alias("p_mid"))
    people = people.withColumn("entity", F.concat_ws("|", "last", "first", "p_mid"))
    key = lambda kind, name, mid: F.concat_ws("|", F.lit(kind), "last", name, mid)
    letter = F.substring("first", 1, 1)
    any_mid = F.lit("*")
    held = F.array(key("name", F.col("first"), any_mid), key("name", F.col("first"), F.col("p_mid")), key("initial", letter, any_mid), key("initial", letter, F.col("p_mid")))
    held = reliable(people.select("entity", "weight", F.explode(held).alias("form")))
    # the forms of a spelling; a middle initial fits the persons that have it and, where there is none, those known without any
    asks = lambda kind, name: F.explode(F.when(F.col("mid") == "", F.array(F.struct(key(kind, name, any_mid).alias("form"), F.lit(False).alias("sure")))).otherwise(
        F.array(F.struct(key(kind, name, F.col("mid")).alias("form"), F.lit(True).alias("sure")), F.struct(key(kind, name, F.lit("")).alias("form"), F.lit(False).alias("sure"))))).alias("ask")
    shorts = fixed.filter("is_short").join(nick, "first").select("name", "last", F.col("given").alias("first"), "mid")
    asked = long_form.select("name", asks("name", F.col("first"))).unionByName(shorts.select("name", asks("name", F.col("first"))))
    asked = asked.unionByName(fixed.filter("first = '' AND initial <> ''").select("name", asks("initial", F.col("initial"))))
    # rarity of a form: how many persons share it; the join is of forms, a row each on the right
    forms = held.groupBy("form").agg(F.count(F.lit(1)).alias("persons"), F.max_by("entity", F.struct("weight", "entity")).alias("best"), F.max("weight").alias("weight"))
    fit = asked.select("name", "ask.form", "ask.sure").distinct().join(forms, "form")
    fit = reliable(fit.withColumn("any_sure", F.max("sure").over(Window.partitionBy("name"))).filter("sure OR NOT any_sure").drop("any_sure"))
    choices = fit.groupBy("name").agg(F.sum("persons").alias("choices"), F.max_by("best", F.struct("weight", "best")).alias("best"))
    single = choices.filter("choices = 1").select("name", F.col("best").alias("entity"), F.lit(1.0).alias("score"))
    several = choices.filter("choices > 1")
    # several persons fit: those who share an ORCID or organisation with mentions of the spelling, else the most used one
    facts = [rows.select(F.col(column).alias("name"), F.lit(k).alias("kind"), e.cast("string").alias("fact")) for e, k in evidence]
    facts_all = facts[0]
    for f in facts[1:]:
        facts_all = facts_all.unionByName(f)
    facts_all = reliable(facts_all.filter(F.length("fact") > 0).groupBy("name", "kind", "fact").agg(F.count(F.lit(1)).alias("k")))
    known = single.select("name", "entity").join(facts_all, "name").select("entity", "kind", "fact").distinct()
    open_forms = fit.join(several.select("name"), "name", "left_semi").select("name", "form")
    theirs = held.join(open_forms.select("form").distinct(), "form", "left_semi").select("form", "entity").join(known, "entity")
    shared = open_forms.join(facts_all, "name").join(theirs, ["form", "kind", "fact"])
    shared = shared.groupBy("name", "entity").agg(F.sum(F.when(F.col("kind") == "orcid", 2 * F.col("k")).otherwise(F.col("k"))).alias("shared"))
    shared = shared.withColumn("score", F.col("shared") / F.sum("shared").over(Window.partitionBy("name"))).select("name", "entity", "score")
    shared = reliable(shared)
    by_use = several.join(shared.select("name").distinct(), "name", "left_anti").select("name", F.col("best").alias("entity"), (1.0 / F.col("choices")).alias("score"))
    # spellings that fit nobody: by surname and initials among themselves
    rest = fixed.join(fit.select("name").distinct(), "name", "left_anti")
    alone = rest.select("name", F.concat_ws("|", F.lit("?"), "last", F.coalesce(F.when(F.col("first") != "", F.col("first")), "initial", F.lit(""))).alias("entity"), F.lit(1.0).alias("score"))
    return single.unionByName(shared).unionByName(by_use).unionByName(alone)


def same_entity_pairs(member: DataFrame) -> DataFrame:
    """(name_a, name_b): different spellings of one entity, smaller first, each pair once.

    An entity has as many rows as it has spellings, not mentions: copies of a spelling were counted before.
    """
    a = member.select("entity", F.col("name").alias("name_a"))
    b = member.select("entity", F.col("name").alias("name_b"))
    return a.join(b, "entity").filter("name_a < name_b").select("name_a", "name_b").distinct()
