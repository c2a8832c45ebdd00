"""Problem 6: evaluation passages inside a training corpus, found by winnowing.

Of every run of ``WINDOW`` consecutive k-grams of words the one with the smallest hash is a fingerprint of the text. With k-grams of
``GRAM`` words any shared span of ``GRAM + WINDOW - 1`` = ``SPAN`` words holds a whole window, so both texts choose the same
k-gram of it: no such span is missed. A fingerprint travels with the word hashes ``SPAN - GRAM`` to either side, which is all that is
needed to extend a hit and to tell whether the span really has ``SPAN`` words; the texts themselves never move.

Words are runs of letters and digits of the folded form (problem 4) after markup is taken out, so letter case, punctuation, line
breaks, markup and look-alike characters do not matter. Null, empty and shorter texts have no cases; copies are cases each.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.llm.textform import folded_form

SPAN, GRAM = 12, 6
WINDOW = SPAN - GRAM + 1
#: Up to so many test fingerprints (8 bytes each) go to the tasks, which then send on only fingerprints that the tests have.
MAX_SENT = 2_000_000

_INLINE = re.compile(r"</?(?:a|abbr|b|cite|code|em|font|i|mark|q|s|small|span|strong|sub|sup|tt|u)(?:\s[^<>]*)?/?>")
_TAG = re.compile(r"<[a-z/!][^<>]{0,200}>")
_ENTITY = re.compile(r"&(?:#\d{1,7}|#x[0-9a-f]{1,6}|[a-z]{2,8});")
_COMMAND = re.compile(r"\\(?:text\w*|emph|mathrm|mathbf)\{([^{}]*)\}")
_WORD = re.compile(r"[^\W_]+")
_MULT = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str) -> list[str]:
    text = text.lower() if text.isascii() else folded_form(text)
    if "<" in text:
        text = _TAG.sub(" ", _INLINE.sub("", text))
    if "&" in text:
        text = _ENTITY.sub(" ", text)
    if "\\" in text:
        text = _COMMAND.sub(r"\1", text)
    return _WORD.findall(text)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


def fingerprints(words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the winnowed k-grams of a sequence of word hashes; empty below ``SPAN`` words."""
    if len(words) < SPAN:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    n = len(words) - GRAM + 1
    h = np.zeros(n, np.uint64)
    for j in range(GRAM):
        h = h * _MULT + words[j : j + n]
        h ^= h >> np.uint64(29)
    low, at = h[: n - WINDOW + 1].copy(), np.arange(n - WINDOW + 1)
    for j in range(1, WINDOW):
        later = h[j : n - WINDOW + 1 + j]
        better = later <= low
        low[better] = later[better]
        at[better] = np.flatnonzero(better) + j
    pos = at[np.concatenate([[True], at[1:] != at[:-1]])]
    return pos, h[pos].view(np.int64)


def _emit(key: str, text: str, pad: int, wanted: np.ndarray | None):
    """Texts of a batch are laid end to end with ``SPAN - GRAM`` pads between: a k-gram that holds a pad belongs to no text."""
    side = SPAN - GRAM

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = _Hashes()
        for pdf in batches:
            keys, sizes, words = [], [], []
            for k, t in zip(pdf[key], pdf[text], strict=True):
                w = words_of(t) if t else ()
                if len(w) >= SPAN:
                    keys.append(k)
                    sizes.append(len(w))
                    words += [known[x] for x in w]
            if not keys:
                continue
            size = np.array(sizes)
            place = np.arange(size.sum()) + np.repeat(np.arange(1, len(size) + 1) * side, size)
            flat = np.full(len(place) + (len(size) + 1) * side, pad, np.uint64)
            flat[place] = np.array(words, np.uint64)
            owner = np.full(len(flat), -1)
            owner[place] = np.repeat(np.arange(len(size)), size)
            pos, h = fingerprints(flat)
            inside = (owner[pos] >= 0) & (owner[pos] == owner[pos + GRAM - 1])
            if wanted is not None:
                inside &= wanted[np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)] == h
            pos, h = pos[inside], h[inside]
            if len(pos):
                context = flat[pos[:, None] + np.arange(-side, GRAM + side)].view(np.int64)
                yield pd.DataFrame({"key": [keys[i] for i in owner[pos]], "print": h, "context": list(context)})

    return run


def _prints(rows: DataFrame, key: str, text: str, pad: int, wanted: np.ndarray | None = None) -> DataFrame:
    kind = dict(rows.dtypes)[key]
    return rows.select(key, text).mapInPandas(_emit(key, text, pad, wanted), f"key {kind}, print bigint, context array<bigint>")


def leaks(corpus: DataFrame, doc: str, text: str, tests: DataFrame, item: str, passage: str) -> DataFrame:
    """(<doc>, <item>): documents that hold at least ``SPAN`` consecutive words of an item's passage, once per pair.

    Test fingerprints are counted first. While they are at most ``MAX_SENT`` the tasks over the corpus get them, sorted, and
    send on nothing else; beyond it all fingerprints are joined by shuffle. Copies of a passage or of a document are compared
    by distinct context, so a fingerprint shared by many copies meets itself once.
    """
    t = _prints(tests, item, passage, 1)
    t_distinct = t.select("print").distinct()
    wanted = None
    if t_distinct.count() <= MAX_SENT:
        wanted = np.sort(t_distinct.toArrow().column("print").to_numpy())
        if not len(wanted):
            wanted = np.array([0], np.int64)
    c = _prints(corpus, doc, text, 2, wanted)
    t_places = t.groupBy("print", "context").agg(F.collect_set("key").alias("items"))
    c_kinds = c.select("print", F.col("context").alias("c")).distinct()
    side = SPAN - GRAM
    same = F.zip_with("c", "context", lambda x, y: x == y)
    left = F.aggregate(F.reverse(F.slice(same, 1, side)), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), _step, lambda s: s["n"])
    right = F.aggregate(F.slice(same, side + GRAM + 1, side), F.struct(F.lit(0).alias("n"), F.lit(True).alias("on")), _step, lambda s: s["n"])
    gram = F.forall(F.slice(same, side + 1, GRAM), lambda x: x)
    hits = c_kinds.join(t_places, "print").filter(gram & (left + right + GRAM >= SPAN)).select("print", "c", F.explode("items").alias("item"))
    return c.join(hits.withColumnRenamed("c", "context"), ["print", "context"]).select(F.col("key").alias(doc), F.col("item").alias(item)).distinct()


def _step(s, x):
    on = s["on"] & x
    return F.struct((s["n"] + on.cast("int")).alias("n"), on.alias("on"))


def leak_report(found: DataFrame, doc: str, item: str, tests: DataFrame) -> DataFrame:
    """(<item>, documents): every test item with the number of documents that leak it, 0 included."""
    n = found.groupBy(item).agg(F.count(F.lit(1)).alias("documents"))
    return tests.select(item).distinct().join(n, item, "left").select(item, F.coalesce("documents", F.lit(0)).alias("documents"))
