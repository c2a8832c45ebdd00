"""Problem 3: several values packed in one field, one row per value with its position.

Dictionary-guided segmentation. A field is cut at every candidate delimiter outside quotes into *atoms*; a multi-pattern automaton
marks the spans of atoms that are known whole values; dynamic programming picks the cover that leaves the fewest atoms outside known
values and, among these, has the fewest values. Delimiters come in two strengths: a *strong* one separates unless a known value spans
it; a *weak* one (the comma of a category or a name) joins unknown atoms and separates only known, quoted or complete ones.

Defined cases: a null or blank field has no values; empty pieces between delimiters are no values and take no position; a quote
opens only at the start of a value and closes at the next single quote sign, a doubled one inside stands for one; an opening quote
that is never closed is an ordinary sign. Repeated rows give repeated results, texts of any length are processed whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import ahocorasick
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words of a surname that are no name by themselves.
PARTICLES = {"de", "der", "den", "di", "da", "du", "la", "le", "van", "von", "ten", "ter"}
#: A dictionary is collected and sent with the tasks; a larger one is refused, not cut.
MAX_KNOWN = 1_000_000

_QUOTED = re.compile(r'\s*"((?:[^"]|"")*)"[^\S\t]*')


@dataclass(frozen=True)
class PackedField:
    """How one field is packed: regular expressions of its strong and weak delimiters, and its known values.

    ``complete`` says, for a weak delimiter, that atoms which all look like whole names are separate.
    """

    name: str
    strong: str
    weak: str | None = None
    complete: bool = False
    known: tuple[str, ...] = field(default=(), compare=False)


CATEGORIES = PackedField("wos_categories", r"[;|]", r",")
KEYWORDS = PackedField("keywords_plus", r"[;|,·\t]")
ORGANISATIONS = PackedField("affiliations", r"[;|]|(?:(?<=\s)|^)/(?=\s|$)")
NAMES = PackedField("author_full_names", r"[;|]|(?:(?<=\s)|^)(?:&|and)(?=\s|$)", r",", complete=True)


def _whole_name(atom: str) -> bool:
    words = [w for w in atom.split() if w.lower() not in PARTICLES]
    if len(words) < 2:
        return False
    if re.fullmatch(r"(?:\w\.-?)+", words[0]) or re.fullmatch(r"[^\W\d_a-z]{1,3}", words[-1]):
        return True
    return all(len(w.rstrip(".")) > 1 for w in words)


def _automaton(known: Iterable[str]) -> ahocorasick.Automaton | None:
    auto = ahocorasick.Automaton()
    for v in known:
        if v.strip():
            auto.add_word(v.strip(), v.strip())
    if not len(auto):
        return None
    auto.make_automaton()
    return auto


class Splitter:
    """Splits the packed strings of one field; keeps its automaton."""

    def __init__(self, spec: PackedField) -> None:
        self.spec, self.auto = spec, _automaton(spec.known)
        self.cut = re.compile("|".join(f"({p})" for p in (spec.strong, spec.weak) if p))

    def atoms(self, text: str) -> list[tuple[int, int, str | None, bool]]:
        """(start, end, quoted value or None, whether a weak delimiter comes before) of each non-empty piece."""
        out, at, start, weak = [], 0, 0, False
        while True:
            quoted = None
            if (q := _QUOTED.match(text, at)) and (q.end() == len(text) or self.cut.match(text, q.end())):
                quoted, at = q[1].replace('""', '"').strip(), q.end()
            m = self.cut.search(text, at)
            end = m.start() if m else len(text)
            piece = text[start:end]
            if quoted or (quoted is None and piece.strip()):
                a = start + len(piece) - len(piece.lstrip())
                out.append((a, start + len(piece.rstrip()), quoted, weak))
            if not m:
                return out
            weak = m.lastindex == 2
            start = at = m.end()

    def __call__(self, text: str) -> list[str]:
        atoms = self.atoms(text)
        if not atoms:
            return []
        if len(atoms) == 1:
            a, b, quoted, _ = atoms[0]
            return [quoted if quoted is not None else text[a:b]]
        n = len(atoms)
        starts, ends = {a: i for i, (a, *_) in enumerate(atoms)}, {b: i for i, (_, b, *_) in enumerate(atoms)}
        spans: dict[int, list[int]] = {}
        if self.auto is not None:
            for last, value in self.auto.iter(text):
                i, j = starts.get(last + 1 - len(value)), ends.get(last + 1)
                if i is not None and j is not None and i <= j and all(x[2] is None for x in atoms[i : j + 1]):
                    spans.setdefault(j, []).append(i)
        separate = self._separate(text, atoms)
        # best[j]: (atoms outside known values, number of values, first atom of the last value) for the first j atoms
        best: list[tuple[int, int, int]] = [(0, 0, 0)]
        for j in range(n):
            options = [(best[i][0], best[i][1] + 1, i) for i in spans.get(j, ())]
            i, cost = j, 0 if atoms[j][2] is not None else 1
            options.append((best[j][0] + cost, best[j][1] + 1, j))
            while cost and i > 0 and atoms[i][3] and not separate[i] and atoms[i - 1][2] is None:
                i -= 1
                options.append((best[i][0] + j - i + 1, best[i][1] + 1, i))
            best.append(min(options))
        out, j = [], n
        while j:
            i = best[j][2]
            out.append(atoms[i][2] if atoms[i][2] is not None else text[atoms[i][0] : atoms[j - 1][1]])
            j = i
        return out[::-1]

    def _separate(self, text: str, atoms: list) -> list[bool]:
        """Whether the weak delimiter before each atom separates because all atoms of its block are whole names."""
        out, i = [False] * len(atoms), 0
        while self.spec.complete and i < len(atoms):
            j = i + 1
            while j < len(atoms) and atoms[j][3] and atoms[j][2] is None and atoms[j - 1][2] is None:
                j += 1
            if j - i > 1 and all(_whole_name(text[a:b]) for a, b, *_ in atoms[i:j]):
                out[i:j] = [True] * (j - i)
            i = j
        return out


def split_packed(text: str | None, spec: PackedField) -> list[str]:
    return [] if text is None else Splitter(spec)(text)


def _splitter_udf(spec: PackedField):
    @F.pandas_udf(T.ArrayType(T.StringType()))
    def split(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        f = Splitter(spec)
        for texts in batches:
            known = {v: f(v) for v in texts.dropna().unique()}
            yield texts.map(known.get)

    return split


def with_known(spec: PackedField, values: DataFrame | Iterable[str]) -> PackedField:
    """``spec`` with a dictionary: the distinct non-null values of a one-column table, or of a sequence."""
    if isinstance(values, DataFrame):
        c = values.columns[0]
        values = [r[0] for r in values.filter(F.col(c).isNotNull()).distinct().limit(MAX_KNOWN + 1).collect()]
    values = tuple(sorted(set(values)))
    if len(values) > MAX_KNOWN:
        raise ValueError(f"more than {MAX_KNOWN} known values for {spec.name}")
    return PackedField(spec.name, spec.strong, spec.weak, spec.complete, values)


def with_delimiters(values: DataFrame, spec: PackedField) -> DataFrame:
    """Of a one-column table the distinct values that a delimiter of ``spec`` would cut: only these need a dictionary."""
    c = values.columns[0]
    return values.select(F.trim(F.col(c)).alias(c)).filter(F.col(c).rlike("|".join(p for p in (spec.strong, spec.weak) if p))).distinct()


def explode_packed(rows: DataFrame, key: str, specs: list[PackedField]) -> DataFrame:
    """(<key>, field_name, pos, val): every value of the fields of every row, positions from 1. No shuffle."""
    split = rows.select(F.col(key), *[_splitter_udf(s)(F.col(s.name)).alias(f"v{i}") for i, s in enumerate(specs)])
    fields = F.array(*[F.struct(F.lit(s.name).alias("field_name"), F.col(f"v{i}").alias("vals")) for i, s in enumerate(specs)])
    one = split.select(key, F.explode(fields).alias("f")).filter(F.size("f.vals") > 0)
    return one.select(key, "f.field_name", F.posexplode("f.vals").alias("pos", "val")).withColumn("pos", (F.col("pos") + 1).cast("int"))
