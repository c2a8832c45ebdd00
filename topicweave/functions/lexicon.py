"""Hedging and boosting words (C6) of the published list in Hyland (2005), and how they are counted in a text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Hedges and boosters of one word and of several words.
HEDGES = "about almost apparent apparently appear appeared appears approximately argue argued argues around assume assumed broadly claim claimed claims could couldn't doubt doubtful essentially estimate estimated fairly feel feels felt frequently generally guess indicate indicated indicates largely likely mainly may maybe might mostly often ought perhaps plausible plausibly possible possibly postulate postulated postulates presumable presumably probable probably quite relatively roughly seem seemed seems should sometimes somewhat suggest suggested suggests suppose supposed supposes suspect suspects typical typically uncertain uncertainly unclear unclearly unlikely usually would wouldn't".split()
HEDGE_PHRASES = ["certain amount", "certain extent", "certain level", "from my perspective", "from our perspective", "from this perspective", "in general", "in most cases", "in most instances", "in my opinion", "in my view", "in this view", "in our opinion", "in our view", "on the whole", "tend to", "tended to", "tends to", "to my knowledge"]
BOOSTERS = "actually always believe believed believes certain certainly clear clearly conclusively decidedly definite definitely demonstrate demonstrated demonstrates doubtless establish established evident evidently find finds found incontestable incontestably incontrovertible incontrovertibly indeed indisputable indisputably know known must never obvious obviously prove proved proves realize realized realizes really show showed shown shows sure surely think thinks thought true truly undeniable undeniably undisputedly undoubtedly".split()
BOOSTER_PHRASES = ["beyond doubt", "in fact", "no doubt", "of course", "without doubt"]

#: Words of a text in lower case.
WORD = r"[a-z]+(?:'[a-z]+)?"


def _escaped(phrases: list[str]) -> list[str]:
    # words are laid out with a blank on either side, so two neighbours never share one
    return [p.replace(" ", "  ") for p in sorted(phrases, key=lambda p: (-len(p.split()), p))]


def pattern(hedges: list[str], boosters: list[str]) -> str:
    """An expression whose matches, from left to right, are the listed words and phrases, longer phrases first, none counted twice."""
    every = [*hedges, *boosters]
    return " (" + "|".join([*_escaped([p for p in every if " " in p]), *[w for w in every if " " not in w]]) + ") "


def laid_out(text: Column) -> Column:
    """The words of a text, each between two blanks of its own."""
    return F.concat(F.lit(" "), F.array_join(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})")), "  "), F.lit(" "))


def hedge_counts(text: Column, hedges: list[str] | None = None, boosters: list[str] | None = None) -> Column:
    """Struct (hedges, boosters, words) of a text; null for null. The default lists are the published ones."""
    hedges = [*HEDGES, *HEDGE_PHRASES] if hedges is None else hedges
    boosters = [*BOOSTERS, *BOOSTER_PHRASES] if boosters is None else boosters
    found = F.regexp_extract_all(laid_out(text), F.lit(pattern(hedges, boosters)))
    is_hedge = lambda x: F.replace(x, F.lit("  "), F.lit(" ")).isin(*hedges) if hedges else F.lit(False)
    n = F.size(F.filter(found, is_hedge))
    words = F.size(F.regexp_extract_all(F.lower(text), F.lit(f"({WORD})")))
    return F.when(text.isNotNull(), F.struct(n.alias("hedges"), (F.size(found) - n).alias("boosters"), words.alias("words")))
