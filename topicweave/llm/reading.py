"""Problem 8: reading level of each document, by a pairwise ranker learned from graded texts.

Words are taken in windows of ``WINDOW``; a document's features are medians over its windows, so single sentences of another level
or foreign passages do not move them. Syntax features: words per sentence (median and upper quartile over the sentences, as logarithms, so
that a missing full stop or a list moves them little), clauses per sentence, commas, subordinating and function words, letters
and syllables per word and long words. A sentence ends at . ! ? before a blank, or at a line break. Vocabulary features: for each level the mean log-probability of the window's words, against the mean of
all levels, from the words of the graded texts (learned on other folds than the text itself while training).

The ranker is linear: logistic loss on differences of standardised features over all pairs of texts with different levels, full batch
gradient descent with L2. Its scores become levels by isotonic regression (pool adjacent violators) and rounding.

The model is fitted on the driver from at most ``MAX_GRADED`` graded texts and is a few thousand numbers; the documents are scored
where they lie, without a shuffle. Null and empty texts, and texts below ``min_pieces`` pieces between white space, get no level.

Vocabulary and function words are those of the graded texts' language. Documents of other languages are scored by a second ranker on form
alone (word and sentence lengths, commas); its scores are brought to the mean and spread of the graded language, language by
language, since words of different languages differ in length (``levels_by_language``).
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicweave.llm.leakage import _INLINE, _TAG
from topicweave.llm.textform import visible_form
from topicweave.operators.graph import reliable

WINDOW = 20
#: Graded texts that a model is fitted on at most; more are refused, not cut.
MAX_GRADED = 20_000
FOLDS = 8

# Words that join or subordinate clauses, and frequent function words.
SUBORDINATING = frozenset("although because before after since that though unless until when whenever where whereas whether which while who whose if as once provided notwithstanding thereby".split())
FUNCTION = frozenset("a an the and or but of to in on at by for with from into is are was were be been it its this that these those he she they we you i his her their our can could may might will would has have had do does not no so as than".split())

_WORD = re.compile(r"[^\W\d_]+(?:['’-][^\W\d_]+)*|,|[.!?](?=\s|$)|\n")
_MARKS = frozenset(",.!?\n")
#: Features of form, which any language with words and sentences has: letters, syllables, long, very long, commas, sentence lengths.
FORM = (0, 1, 2, 3, -5, -4, -3)
_VOWELS = re.compile(r"[aeiouyäöüéèíáóâêîôû]+")


def _tokens(text: str) -> list[str]:
    text = visible_form(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    return _WORD.findall(text.lower())


class _Words(dict):
    """The row of each word in ``table``: letters, syllables, long, very long, function, subordinating, level log-probabilities."""

    def __init__(self, vocabulary: dict[str, np.ndarray], levels: int) -> None:
        super().__init__()
        self.vocabulary, self.none = vocabulary, np.zeros(levels)
        self.table = np.zeros((4096, 6 + levels))

    def __missing__(self, w: str) -> int:
        n = len(w)
        own = [n, max(1, len(_VOWELS.findall(w))), n > 6, n > 9, w in FUNCTION, w in SUBORDINATING]
        if len(self) == len(self.table):
            self.table = np.vstack([self.table, np.zeros_like(self.table)])
        self[w] = i = len(self)
        self.table[i] = np.concatenate([own, self.vocabulary.get(w, self.none)])
        return i

    def rows(self, tokens: list[str]) -> np.ndarray:
        if len(self) > 300_000:
            self.clear()
        at = np.fromiter((self[t] for t in tokens), np.int64, len(tokens))
        return self.table[at]


def features(text: str, words: _Words) -> np.ndarray | None:
    """Medians over windows, then what sentences are like; null for a text without words.

    Order: the columns of ``words``, commas per word, logarithms of the median and the upper quartile of words per sentence,
    subordinating words and commas per sentence.
    """
    tokens = _tokens(text)
    real = [t for t in tokens if t not in _MARKS]
    if not real:
        return None
    per = words.rows(real)
    size = max(1, len(real) // WINDOW)
    edges = np.linspace(0, len(real), size + 1).astype(int)[:-1]
    length = np.diff(np.append(edges, len(real)))[:, None]
    means = np.add.reduceat(per, edges, axis=0) / length
    is_word = np.fromiter((t not in _MARKS for t in tokens), bool, len(tokens))
    is_comma = np.fromiter((t == "," for t in tokens), bool, len(tokens))
    before = np.cumsum(is_word)  # the words up to each token
    comma = np.bincount(np.searchsorted(edges, before[is_comma], side="right") - 1, minlength=size)[:size, None] / length
    ends = np.unique(np.append(before[~is_word & ~is_comma], len(real)))
    sentence = np.diff(np.append(0, ends[ends > 0]))
    middle, upper = np.percentile(sentence, (50, 75))
    shape = [np.log1p(middle), np.log1p(upper), min(3.0, per[:, 5].sum() / len(sentence)), min(5.0, is_comma.sum() / len(sentence))]
    return np.concatenate([np.median(np.hstack([means, comma]), axis=0), shape])


def _vocabulary(texts: list[list[str]], levels: np.ndarray, n_levels: int) -> dict[str, np.ndarray]:
    counts = [Counter() for _ in range(n_levels)]
    for t, b in zip(texts, levels, strict=True):
        counts[b].update(set(t) - _MARKS)
    size = np.array([max(1, (levels == b).sum()) for b in range(n_levels)], float)
    out = {}
    for w in set().union(*counts):
        n = np.array([c[w] for c in counts], float)
        if n.sum() >= 3:
            p = np.log((n + 0.5) / (size + 1))
            out[w] = p - p.mean()
    return out


def isotonic(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(thresholds, values) of the increasing step function nearest to y over x, by pooling adjacent violators."""
    order = np.argsort(x, kind="stable")
    blocks: list[list[float]] = []
    for i in order:
        blocks.append([y[i], 1.0, x[i]])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            v, n, at = blocks.pop()
            blocks[-1][0] = (blocks[-1][0] * blocks[-1][1] + v * n) / (blocks[-1][1] + n)
            blocks[-1][1] += n
    # each block begins at its smallest score
    return np.array([b[2] for b in blocks]), np.array([b[0] for b in blocks])


@dataclass
class Ranker:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cuts: np.ndarray  # halfway between two blocks of the isotonic steps
    steps: np.ndarray  # the level of each block, by number
    middle: float  # mean and deviation of the graded texts' scores
    spread: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return (x - self.mean) / self.scale @ self.weights


@dataclass
class ReadingModel:
    vocabulary: dict[str, np.ndarray]
    levels: list[int]
    full: Ranker
    form: Ranker

    def words(self) -> _Words:
        return _Words(self.vocabulary, len(self.levels))

    def level(self, scores: np.ndarray) -> np.ndarray:
        return np.array(self.levels)[np.clip(self.full.steps[np.searchsorted(self.full.cuts, scores)], 0, len(self.levels) - 1)]

    def level_of_form(self, score: Column) -> Column:
        """The level of a score of form, as a column."""
        of = [self.levels[min(max(k, 0), len(self.levels) - 1)] for k in self.form.steps]
        below = F.size(F.filter(F.array(*[F.lit(float(c)) for c in self.form.cuts]), lambda c: c < score)) if len(self.form.cuts) else F.lit(0)
        return F.element_at(F.array(*[F.lit(k) for k in of]), below + 1).cast("int")


def fit(texts: list[str], levels: list[int], l2: float = 1e-3, steps: int = 400) -> ReadingModel:
    """Fit on graded texts; at least two levels are needed."""
    names = sorted(set(levels))
    if len(names) < 2:
        raise ValueError("graded texts of at least two levels are needed")
    y = np.array([names.index(b) for b in levels])
    tokens = [_tokens(t) for t in texts]
    fold = np.arange(len(texts)) % FOLDS
    x = np.zeros((len(texts), 11 + len(names)))
    for f in range(FOLDS):
        others = fold != f
        v = _Words(_vocabulary([t for t, o in zip(tokens, others, strict=True) if o], y[others], len(names)), len(names))
        for i in np.flatnonzero(~others):
            x[i] = features(texts[i], v)
    form = np.zeros(x.shape[1], bool)
    form[list(FORM)] = True
    return ReadingModel(_vocabulary(tokens, y, len(names)), names, _rank(x, y, l2, steps, np.ones_like(form)), _rank(x, y, l2, steps, form))


def _rank(x: np.ndarray, y: np.ndarray, l2: float, steps: int, used: np.ndarray) -> Ranker:
    """The pairwise ranker on the columns ``used`` and the isotonic steps of its scores."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
    z = (x - mean) / scale * used
    w = np.zeros(z.shape[1])
    level_pairs = [(np.flatnonzero(y == a), np.flatnonzero(y == b)) for b in range(y.max() + 1) for a in range(b)]
    total = sum(len(a) * len(b) for a, b in level_pairs)
    for _ in range(steps):
        s, g = z @ w, l2 * w
        for a, b in level_pairs:
            p = 1 / (1 + np.exp(np.clip(s[b][:, None] - s[a][None, :], -30, 30)))
            g = g - (p.sum(axis=1) @ z[b] - p.sum(axis=0) @ z[a]) / total
        w = w - 2.0 * g
    s = z @ w
    at, value = isotonic(s, y.astype(float))
    last = np.array([s[(s >= a) & (s < (at[i + 1] if i + 1 < len(at) else math.inf))].max() for i, a in enumerate(at)])
    return Ranker(mean, scale, w, (at[1:] + last[:-1]) / 2, np.rint(value).astype(int), float(s.mean()), float(s.std()))


def fit_graded(samples: DataFrame, text: str, level: str) -> ReadingModel:
    rows = samples.select(text, level).filter(F.col(text).isNotNull() & F.col(level).isNotNull()).limit(MAX_GRADED + 1).collect()
    if len(rows) > MAX_GRADED:
        raise ValueError(f"more than {MAX_GRADED} graded texts")
    rows = sorted((r[1], r[0]) for r in rows if _tokens(r[0]))
    return fit([t for _, t in rows], [b for b, _ in rows])


def reading_levels(docs: DataFrame, doc: str, text: str, model: ReadingModel, min_pieces: int = 1, keep: tuple[str, ...] = ()) -> DataFrame:
    """(<doc>, band, score, form, <keep>) of every document with at least ``min_pieces`` pieces between white space and a word."""
    kinds = dict(docs.dtypes)
    kept = (doc, *keep)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        words = model.words()
        for pdf in batches:
            at, xs = [], []
            for i, t in enumerate(pdf[text]):
                if t and len(t.split()) >= min_pieces and (x := features(t, words)) is not None:
                    at.append(i)
                    xs.append(x)
            if at:
                x = np.array(xs)
                s = model.full.score(x)
                yield pdf.iloc[at][list(kept)].assign(band=model.level(s).astype("int32"), score=s, form=model.form.score(x))

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in kept), "band int, score double, form double"])
    return docs.select(*kept, text).mapInPandas(run, schema)


def levels_by_language(docs: DataFrame, doc: str, text: str, lang: str, graded_lang: str, model: ReadingModel) -> DataFrame:
    """(<doc>, band, score, basis): a level for every document with a word, ``basis`` 'words' for documents in the language of the
    graded texts and 'form' for others, a null language being one of its own.

    The form scores of another language are shifted and stretched to mean and deviation of the documents in the graded language
    (of the graded texts, where there are none); two numbers a language are joined back.
    """
    tagged = docs.select(doc, text, F.coalesce(lang, F.lit("")).alias("lang_of_doc"))
    scored = reliable(reading_levels(tagged, doc, text, model, keep=("lang_of_doc",)))
    each = scored.groupBy("lang_of_doc").agg(F.avg("form").alias("m"), F.stddev_pop("form").alias("sd"))
    graded = each.filter(F.col("lang_of_doc") == graded_lang).select(F.col("m").alias("gm"), F.col("sd").alias("gsd"))
    one = docs.sparkSession.range(1).join(graded, how="left").select(F.coalesce("gm", F.lit(model.form.middle)).alias("gm"), F.coalesce("gsd", F.lit(model.form.spread)).alias("gsd"))
    each = each.join(one)  # a row per language with a table of one row
    out = scored.join(each, "lang_of_doc")
    moved = F.when(F.col("sd") > 0, (F.col("form") - F.col("m")) / F.col("sd") * F.col("gsd") + F.col("gm")).otherwise(F.col("gm"))
    same = F.col("lang_of_doc") == graded_lang
    band, score = F.when(same, F.col("band")).otherwise(model.level_of_form(moved)), F.when(same, F.col("score")).otherwise(moved)
    return out.select(doc, band.alias("band"), score.alias("score"), F.when(same, "words").otherwise("form").alias("basis"))
