"""Problem 4: one form for text that looks the same but is written with different characters.

``visible_form``   what a reader sees: compatibility characters (width, ligature, font), combining sequences, look-alike
                   letters, kinds of blank and default-ignorable characters are unified; letter case, accents, sub- and
                   superscripts, punctuation and words stay.
``folded_form``    the same with full case folding, for comparisons in which case does not matter.

Both are string functions applied once per distinct value of an Arrow batch (``visible_udf``). Values that are plain ASCII
without control characters never reach Python in ``visible_column`` and ``folded_column``: the JVM handles them.

Null stays null, an empty text stays empty; a text of invisible characters only becomes empty.
"""

from __future__ import annotations

import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicweave.operators.graph import reliable

# Letters of other scripts that are drawn like a Latin letter (left: the other letters, right: the Latin ones), the
# single letters of the confusables table of Unicode Technical Standard 39 in Cyrillic, Greek and Armenian and a few Latin variants.
LOOK_ALIKES = (
    ("аеорсухіјѕһԁԛԝѵӏ", "aeopcyxijshdqwvl"),  # Cyrillic small
    ("АВЕКМНОРСТУХІЈЅԚԜѴ", "ABEKMHOPCTYXIJSQWV"),  # Cyrillic capital
    ("οϲ", "oc"),  # Greek small, drawn alike
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧϹ", "ABEZHIKMNOPTYXC"),  # Greek capital
    ("օսհոցզՕՏ", "ouhngqOS"),  # Armenian
    ("ɑɡıǀ‐‑", "agil--"),  # Latin variants and hyphens
)
# Greek small letters that resemble a Latin one and are symbols by themselves: α decay is no "a decay". They are
# taken for Latin only inside a word that has Latin letters.
LOOK_ALIKES_IN_WORDS = ("αγινρυ", "ayivpu")
# Code points that Unicode calls default-ignorable, as ranges.
IGNORABLE = (
    (0x00AD, 0x00AD), (0x034F, 0x034F), (0x061C, 0x061C), (0x115F, 0x1160), (0x17B4, 0x17B5), (0x180B, 0x180F),
    (0x200B, 0x200F), (0x202A, 0x202E), (0x2060, 0x206F), (0x3164, 0x3164), (0xFE00, 0xFE0F), (0xFEFF, 0xFEFF),
    (0xFFA0, 0xFFA0), (0xFFF0, 0xFFF8), (0x1BCA0, 0x1BCA3), (0x1D173, 0x1D17A), (0xE0000, 0xE0FFF),
)
#: Kinds of compatibility decomposition that do not change what a reader sees.
SAME_LOOK = {"<wide>", "<narrow>", "<compat>", "<noBreak>", "<font>", "<initial>", "<medial>", "<final>", "<isolated>"}
#: A text made of these alone needs no character mapping.
PLAIN = r"^[\x20-\x7e\n]*$"

_IN_WORDS = str.maketrans(*LOOK_ALIKES_IN_WORDS)
_GREEK = re.compile(f"[{LOOK_ALIKES_IN_WORDS[0]}]")
_MIXED_WORD = re.compile(r"[^\W\d_]*(?:[a-zA-Z][^\W\d_]*[%s]|[%s][^\W\d_]*[a-zA-Z])[^\W\d_]*" % (LOOK_ALIKES_IN_WORDS[0], LOOK_ALIKES_IN_WORDS[0]))
_ALIKE = {ord(a): b for left, right in LOOK_ALIKES for a, b in zip(left, right, strict=True)}
_BLANKS = re.compile(r"  +")
#: Characters that may have to be mapped; the others of a text are never looked at one by one.
_SPECIAL = re.compile(r"[^\n\x20-\x7e]")


class _Mapping(dict):
    """Each character is worked out when it is first seen."""

    def __missing__(self, c: str) -> str:
        self[c] = out = _mapped(ord(c))
        return out


def _mapped(code: int) -> str:
    if any(a <= code <= b for a, b in IGNORABLE):
        return ""
    if code in _ALIKE:
        return _ALIKE[code]
    c = chr(code)
    if c == "\n":
        return c
    if c.isspace():
        return " "
    parts = unicodedata.decomposition(c).split()
    if not parts:
        return c
    if parts[0][0] == "<":
        if parts[0] not in SAME_LOOK or parts[1:2] == ["0020"]:
            return c
        parts = parts[1:]
    return "".join(_mapped(int(x, 16)) for x in parts)


_MAP = _Mapping()


def _map_one(m: re.Match) -> str:
    return _MAP[m[0]]


def visible_form(text: str | None) -> str | None:
    """What a reader sees of ``text``; runs of blanks count as one and outer blanks do not count."""
    if text is None:
        return None
    if "\r" in text:
        text = text.replace("\r\n", "\n").replace("\r", "\n")
    text = _SPECIAL.sub(_map_one, text)
    if not text.isascii():
        if _GREEK.search(text):
            text = _MIXED_WORD.sub(lambda m: m[0].translate(_IN_WORDS), text)
        text = unicodedata.normalize("NFC", text)
    if "  " in text:
        text = _BLANKS.sub(" ", text)
    return text.replace(" \n", "\n").replace("\n ", "\n").strip()


def folded_form(text: str | None) -> str | None:
    """``visible_form`` with full case folding, composed again."""
    if text is None:
        return None
    text = visible_form(text)
    return text.lower() if text.isascii() else unicodedata.normalize("NFC", text.casefold())


def _per_distinct(f, values: pd.Series) -> pd.Series:
    known = {v: f(v) for v in values.dropna().unique()}
    return values.map(lambda v: known.get(v) if v is not None else None).astype(object)


@F.pandas_udf(T.StringType())
def visible_udf(values: pd.Series) -> pd.Series:
    return _per_distinct(visible_form, values)


@F.pandas_udf(T.StringType())
def folded_udf(values: pd.Series) -> pd.Series:
    return _per_distinct(folded_form, values)


def _plain_blanks(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, " +", " "), " ?\n ?", "\n"), F.lit(" \n"))


def visible_column(text: Column) -> Column:
    """``visible_form`` as a column: plain ASCII stays in the JVM, only other texts are sent to Python."""
    return F.coalesce(visible_udf(F.when(~text.rlike(PLAIN), text)), _plain_blanks(text))


def folded_column(text: Column) -> Column:
    return F.coalesce(folded_udf(F.when(~text.rlike(PLAIN), text)), F.lower(_plain_blanks(text)))


_BOTH = T.StructType([T.StructField("visible", T.StringType()), T.StructField("folded", T.StringType())])


@F.pandas_udf(_BOTH)
def _both_udf(values: pd.Series) -> pd.DataFrame:
    known = {v: (x := visible_form(v), x.lower() if x.isascii() else unicodedata.normalize("NFC", x.casefold())) for v in values.dropna().unique()}
    none = (None, None)
    return pd.DataFrame([known.get(v, none) if v is not None else none for v in values], columns=["visible", "folded"])


def canonical_texts(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(key, field_name, visible, folded): every named field of every row in one form; null stays null. Both forms come from one
    evaluation per distinct value of a batch; plain ASCII never leaves the JVM."""
    long = rows.select(F.col(key), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("x"))
    long = long.select(key, "x.field_name", F.col("x.text").alias("text"), _both_udf(F.when(~F.col("x.text").rlike(PLAIN), F.col("x.text"))).alias("both"))
    plain = _plain_blanks(F.col("text"))
    return long.select(key, "field_name", F.coalesce("both.visible", plain).alias("visible"), F.coalesce("both.folded", F.lower(plain)).alias("folded"))


def look_alike_pairs(rows: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """(field_name, <key>_a, <key>_b): rows whose field looks the same although the strings differ, smaller key first.

    Equal strings are no pair, null and empty texts (also those empty to a reader) have none. The texts are read and brought into
    one form once; what is kept in the checkpoint folder are digests of fixed size. Looks of a single string leave first.
    Then the *distinct strings* of a look meet, never copies, and the rows of a string come back by its own digest, so a text that is
    copied a million times costs one string, and beside it a variant costs only the pairs that are asked for.
    """
    digest = lambda c: F.unhex(F.md5(c))
    long = rows.select(F.col(key).alias("row"), F.explode(F.array(*[F.struct(F.lit(f).alias("field_name"), F.col(f).alias("text")) for f in fields])).alias("x"))
    long = long.select("row", "x.field_name", F.col("x.text").alias("text")).filter(F.length("text") > 0)
    look = long.select("row", "field_name", digest(F.col("text")).alias("own"), visible_column(F.col("text")).alias("visible"))
    empty = digest(F.lit(""))
    look = reliable(look.select("row", "field_name", "own", digest(F.col("visible")).alias("look"))).filter(F.col("look") != empty)
    strings = look.select("field_name", "look", "own").distinct()
    several = strings.groupBy("field_name", "look").agg(F.min("own").alias("first"), F.max("own").alias("last")).filter("first <> last").select("field_name", "look")
    strings = reliable(strings.join(several, ["field_name", "look"], "left_semi"))
    met = strings.withColumnRenamed("own", "own_a").join(strings.withColumnRenamed("own", "own_b"), ["field_name", "look"]).filter("own_a < own_b").select("field_name", "own_a", "own_b")
    held = look.join(strings.select("field_name", "own"), ["field_name", "own"], "left_semi").select("field_name", "own", "row")
    a, b = held.select("field_name", F.col("own").alias("own_a"), F.col("row").alias("r")), held.select("field_name", F.col("own").alias("own_b"), F.col("row").alias("s"))
    pairs = met.join(a, ["field_name", "own_a"]).join(b, ["field_name", "own_b"]).filter("r <> s")
    return pairs.select("field_name", F.least("r", "s").alias(f"{key}_a"), F.greatest("r", "s").alias(f"{key}_b"))
