"""Permutations of years against whole texts (C13, DS2_A2): every phrase of a record is read once, not once per replicate.

The year that a record gets in a replicate follows from the hash of (seed, replicate, record) and the hashes that end each year of its
topic, so any task can tell it by itself. Records meet their texts in slices of a topic; there the phrases of many records are summed up
into counts by replicate and year, those of few keep the numbers of their records. Parts of the vocabulary are then compared.
"""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict
from itertools import chain

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.operators import indicators as I
from topicweave.operators.graph import reliable

#: Records of a slice; a phrase of more records of a slice is sent as counts, another with the records' numbers.
SLICE, FEW = 8192, 15
#: Hashes are below it, as those of ``resample.permuted_years``.
TOP = 2**53 - 111
_P1, _P2, _P3, _P4, _P5 = (np.uint64(x) for x in (0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5))


def _rotate(x: np.ndarray, n: int) -> np.ndarray:
    return (x << np.uint64(n)) | (x >> np.uint64(64 - n))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _P2
    x = (x ^ (x >> np.uint64(29))) * _P3
    return x ^ (x >> np.uint64(32))


def hash_int(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """Spark's xxhash64 of an int after what ``seed`` is the hash of; arrays of uint64."""
    return _mixed(_rotate((seed + _P5 + np.uint64(4)) ^ ((x & np.uint64(0xFFFFFFFF)) * _P1), 23) * _P2 + _P3)


def hash_long(x: np.ndarray, seed: np.ndarray) -> np.ndarray:
    """The same of a long."""
    return _mixed(_rotate((seed + _P5 + np.uint64(8)) ^ (_rotate(x * _P2, 31) * _P1), 27) * _P1 + _P4)


def draws(uid: np.ndarray, rep: int, seed: int) -> np.ndarray:
    """pmod(xxhash64(seed, rep, uid), TOP) of int64 numbers."""
    start = hash_int(np.array([rep], np.uint64), hash_int(np.array([seed], np.uint64), np.array([42], np.uint64)))
    return hash_long(uid.view(np.uint64), start).view(np.int64) % TOP


def _cells(sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Cuts of the hashes into cells, and which cells may hold the last record of a year: those within eight deviations of its place."""
    n, c = sizes.sum(), np.cumsum(sizes)[:-1]
    p = c / (n + 1)
    m = 8 * np.sqrt(p * (1 - p) / n) + 40 / n
    low, high = (np.clip(x * TOP, 0, TOP).astype(np.int64) for x in (p - m, p + m))
    cuts = np.unique(np.concatenate([low, high, [0, TOP]]))
    near = ((low[:, None] <= cuts[:-1]) & (cuts[1:] <= high[:, None])).any(axis=0)
    return cuts, np.concatenate([[False], near, [False]])


def _near(seed: int):
    def f(docs: pd.DataFrame, info: pd.DataFrame) -> pd.DataFrame:
        if docs.empty or info.empty:
            return pd.DataFrame(columns=["phase", "topic", "rep", "sizes", "n", "h", "uid"])
        i, uid, out = info.iloc[0], docs["uid"].to_numpy(np.int64), []
        sizes = np.asarray(i["sizes"], np.int64)
        cuts, near = _cells(sizes)
        for rep in range(1, int(i["reps"]) + 1):
            h = draws(uid, rep, seed)
            cell = np.searchsorted(cuts, h, "right")
            keep = near[cell]
            out.append((i["phase"], i["topic"], rep, sizes.tobytes(), np.bincount(cell, minlength=len(near)).tobytes(), h[keep].tobytes(), uid[keep].tobytes()))
        return pd.DataFrame(out, columns=["phase", "topic", "rep", "sizes", "n", "h", "uid"])

    return f


def _last(rows: pd.DataFrame) -> pd.DataFrame:
    """The hash and the number of the last record of each year but the latest, in one replicate of a topic."""
    first = rows.iloc[0]
    sizes = np.frombuffer(first["sizes"], np.int64)
    _, near = _cells(sizes)
    n = sum(np.frombuffer(x, np.int64) for x in rows["n"])
    h, uid = (np.frombuffer(b"".join(rows[c]), np.int64) for c in ("h", "uid"))
    order = np.lexsort((uid, h))
    upto, kept, rank = np.cumsum(n), np.cumsum(n * near), np.cumsum(sizes)[:-1]
    cell = np.searchsorted(upto, rank)
    if not near[cell].all():
        raise ValueError("the last record of a year lies more than eight deviations from its place")
    at = order[kept[cell] - n[cell] + rank - (upto[cell] - n[cell]) - 1]
    return pd.DataFrame([(first["phase"], first["topic"], first["rep"], h[at].tobytes(), uid[at].tobytes())], columns=["phase", "topic", "rep", "h", "uid"])


def _places(uid: np.ndarray, ends, seed: int) -> np.ndarray:
    """Per replicate the place of each record's year among the topic's years."""
    out = np.empty((len(ends), len(uid)), np.int32)
    for k, e in enumerate(sorted(ends, key=lambda e: e["rep"])):
        h, last, who = draws(uid, int(e["rep"]), seed), np.frombuffer(e["h"], np.int64), np.frombuffer(e["uid"], np.int64)
        at = np.searchsorted(last, h)
        for j in np.flatnonzero(last[np.minimum(at, len(last) - 1)] == h):  # the last records themselves, and equal hashes
            while at[j] < len(last) and last[at[j]] == h[j] and who[at[j]] < uid[j]:
                at[j] += 1
        out[k] = at
    return out


def phrase_postings(texts, stop: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(phrase as a hash, number of the text) of every different phrase of each text, in this order: words and neighbouring pairs of
    content runs, as ``functions.text.phrases`` has them, of texts that ``functions.text.marked`` made."""
    ids: defaultdict = defaultdict()
    ids.default_factory = ids.__len__
    breaks = len([ids[w] for w in dict.fromkeys(["|", *stop])])
    split = [t.split() for t in texts]
    word = np.fromiter(map(ids.__getitem__, chain.from_iterable(split)), np.int64)
    text = np.repeat(np.arange(len(split)), [len(s) for s in split])
    long = np.fromiter((i < breaks or len(w) > 1 for i, w in enumerate(ids)), bool, len(ids))
    code = np.frombuffer(b"".join(hashlib.blake2b(w.encode(), digest_size=8).digest() for w in ids), np.uint64)
    keep = long[word]
    word, text = word[keep], text[keep]
    content = word >= breaks
    pair = np.flatnonzero(content[:-1] & content[1:] & (text[:-1] == text[1:]))
    term = np.concatenate([code[word[content]], hash_long(code[word[pair + 1]], code[word[pair]])])
    terms, k = np.unique(term, return_inverse=True)
    n = max(len(split), 1)
    both = np.unique(k * n + np.concatenate([text[content], text[pair]]))
    return terms[both // n], both % n


def _counted(seed: int, stop: list[str]):
    columns = ["phase", "topic", "part", "terms", "n", "uids", "seen", "dense", "counts"]

    def f(texts: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        about = side["ends"].notna()
        docs = side[~about]
        if docs.empty or not about.any():
            return pd.DataFrame(columns=columns)
        i = side[about].iloc[0]
        years, parts, reps = np.asarray(i["years"], np.int64), int(i["parts"]), len(i["ends"]) + 1
        j = docs[["row", "uid", "year"]].merge(texts[["row", "text"]], on="row")
        uid = j["uid"].to_numpy(np.int64)
        place = np.vstack([np.searchsorted(years, j["year"].to_numpy(np.int64))[None, :].astype(np.int32), _places(uid, i["ends"], seed)])
        term, doc = phrase_postings(j["text"], stop)
        y = len(years)
        total = np.bincount(doc, minlength=len(j))
        out = [(i["phase"], i["topic"], -1, *[None] * 5, np.stack([np.bincount(p, total, y) for p in place]).astype(np.int64).tobytes())]
        terms, at, n = np.unique(term, return_index=True, return_counts=True)
        many = n > FEW
        some = np.repeat(many, n)
        d, k = doc[some], np.repeat(np.arange(many.sum()), n[many]) * y
        cells = int(many.sum()) * y
        counts = np.empty((int(many.sum()), reps, y), np.uint32)
        for r, p in enumerate(place):
            counts[:, r] = np.bincount(k + p[d], minlength=cells).reshape(-1, y)
        few, n, who, seen = terms[~many], n[~many], uid[doc[~some]], place[0, doc[~some]].astype(np.uint16)
        part, dense = (few % np.uint64(parts)).astype(np.int64), terms[many]
        dense_part = (dense % np.uint64(parts)).astype(np.int64)
        by, dense_by = np.argsort(part, kind="stable"), np.argsort(dense_part, kind="stable")
        of = np.argsort(np.repeat(part, n), kind="stable")
        few, who, seen, n = few[by], who[of], seen[of], n[by].astype(np.uint8)
        ends, who_ends, dense_ends = (np.concatenate([[0], np.cumsum(np.bincount(p, w, parts))]).astype(np.int64) for p, w in ((part, None), (part[by], n), (dense_part, None)))
        for b in range(parts):
            s, u, c = (slice(e[b], e[b + 1]) for e in (ends, who_ends, dense_ends))
            if s.start == s.stop and c.start == c.stop:
                continue
            x = counts[dense_by[c]]
            x = x.astype(np.min_scalar_type(int(x.max(initial=0))))
            out.append((i["phase"], i["topic"], b, few[s].tobytes(), n[s].tobytes(), who[u].tobytes(), seen[u].tobytes(), dense[dense_by[c]].tobytes(), bytes([x.itemsize]) + zlib.compress(x.tobytes(), 1)))
        return pd.DataFrame(out, columns=columns)

    return f


def _totals(rows: pd.DataFrame) -> pd.DataFrame:
    first = rows.iloc[0]
    return pd.DataFrame([(first["phase"], first["topic"], sum(np.frombuffer(x, np.int64) for x in rows["counts"]).tobytes())], columns=["phase", "topic", "totals"])


def _shared(seed: int):
    columns = ["phase", "topic", "rep", "pair", "m"]

    def f(rows: pd.DataFrame, side: pd.DataFrame) -> pd.DataFrame:
        if rows.empty or side.empty:
            return pd.DataFrame(columns=columns)
        i = side.iloc[0]
        reps, y = len(i["ends"]) + 1, len(i["years"])
        total = np.frombuffer(i["totals"], np.int64).reshape(reps, y)
        few, n, who, seen, dense = (np.frombuffer(b"".join(rows[c]), t) for c, t in (("terms", np.uint64), ("n", np.uint8), ("uids", np.int64), ("seen", np.uint16), ("dense", np.uint64)))
        # a phrase of one record is in one year only and has no part in any minimum
        terms, k, places = np.unique(np.concatenate([few, dense]), return_inverse=True, return_counts=True)
        single = np.zeros(len(terms), bool)
        single[k[: len(few)]] = (n == 1) & (places[k[: len(few)]] == 1)
        number = np.cumsum(~single) - 1
        term = np.repeat(k[: len(few)], n)
        keep = ~single[term]
        term, who, seen = number[term[keep]], who[keep], seen[keep]
        ids, back = np.unique(who, return_inverse=True)
        place = _places(ids, i["ends"], seed)
        many = number[k[len(few) :]]
        blobs, start = [], 0
        for d, c in zip(rows["dense"], rows["counts"], strict=True):
            size = len(d) // 8
            if size:
                blobs.append((many[start : start + size], np.frombuffer(zlib.decompress(c[1:]), f"u{c[0]}").reshape(size, reps, y)))
            start += size
        kinds, out = int((~single).sum()), []
        for r in range(reps):
            x = np.bincount(term * y + (place[r - 1][back] if r else seen), minlength=kinds * y).reshape(kinds, y)
            for at, c in blobs:
                x[at] += c[:, r]
            share = x / np.maximum(total[r], 1)
            m = np.minimum(share[:, :-1], share[:, 1:]).sum(axis=0)
            out += [(i["phase"], i["topic"], r, p, m[p]) for p in range(y - 1) if total[r, p] and total[r, p + 1]]
        return pd.DataFrame(out, columns=columns)

    return f


def phrase_time_distances(docs: DataFrame, texts: DataFrame, stop: list[str], reps: int = 50, seed: int = 42) -> DataFrame:
    """(phase, topic, rep, d): mean Ruzicka distance of the phrases of neighbouring years of each topic with three years or more, in
    replicate 0 as they are, in 1 to ``reps`` with the years of its records permuted as ``resample.permuted_years`` does.

    ``docs`` has (phase, topic, uid, row, year), a row per record; ``texts`` (phase, topic, row, text) with texts that
    ``functions.text.marked`` made; texts of no record are left out. ``uid`` and ``row`` are numbers.
    """
    docs = reliable(docs.filter("year IS NOT NULL AND phase IS NOT NULL AND topic IS NOT NULL"))
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}
    keys = ", ".join(f"{k} {kinds[k]}" for k in I.KEYS)
    info = docs.groupBy(*I.KEYS, "year").agg(F.count(F.lit(1)).alias("n")).groupBy(*I.KEYS).agg(F.sort_array(F.collect_list(F.struct("year", "n"))).alias("y")).filter("size(y) >= 3")
    parts = F.ceil(F.aggregate("y", F.lit(0).cast("bigint"), lambda a, x: a + x["n"]) / SLICE).cast("int")
    info = reliable(info.select(*I.KEYS, F.col("y")["year"].alias("years"), F.col("y")["n"].alias("sizes"), parts.alias("parts"), F.lit(reps).alias("reps")))
    # only topics of several slices: at most a row per SLICE records
    large = F.broadcast(info.filter("parts > 1").select(*I.KEYS, "parts"))
    sliced = lambda df: df.join(large, I.KEYS, "left").withColumn("slice", F.pmod(F.xxhash64("row"), F.coalesce("parts", F.lit(1))).cast("int")).drop("parts")
    # columns of their own: both sides of a pair of groups may come from one table
    own = lambda df: df.select(*[F.col(c).alias(c) for c in df.columns])
    spread = lambda df: own(df).withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = [*I.KEYS, "slice"]

    near = sliced(docs).select(*by, "uid").groupBy(*by).cogroup(spread(info).groupBy(*by)).applyInPandas(_near(seed), f"{keys}, rep int, sizes binary, n binary, h binary, uid binary")
    ends = near.groupBy(*I.KEYS, "rep").applyInPandas(_last, f"{keys}, rep int, h binary, uid binary")
    ends = ends.groupBy(*I.KEYS).agg(F.collect_list(F.struct("rep", "h", "uid")).alias("ends"))
    info = reliable(info.drop("sizes", "reps").join(ends, I.KEYS))

    # no null numbers: pandas would round them
    about = spread(info).select(*by, *[F.lit(0).cast("bigint").alias(c) for c in ("row", "uid", "year")], "years", "parts", "ends")
    side = sliced(docs).select(*by, "row", "uid", F.col("year").cast("bigint").alias("year")).unionByName(about, allowMissingColumns=True)
    counted = sliced(own(texts)).select(*by, "row", "text").groupBy(*by).cogroup(side.groupBy(*by)).applyInPandas(_counted(seed, stop), f"{keys}, part int, terms binary, n binary, uids binary, seen binary, dense binary, counts binary")
    counted = reliable(counted)
    totals = counted.filter("part = -1").select(*I.KEYS, "counts").groupBy(*I.KEYS).applyInPandas(_totals, f"{keys}, totals binary")
    side = info.join(totals, I.KEYS).withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = [*I.KEYS, "part"]
    m = counted.filter("part >= 0").groupBy(*by).cogroup(side.groupBy(*by)).applyInPandas(_shared(seed), f"{keys}, rep int, pair int, m double")
    m = m.groupBy(*I.KEYS, "rep", "pair").agg(F.sum("m").alias("m"))
    return m.groupBy(*I.KEYS, "rep").agg(F.avg(1.0 - F.col("m") / (2.0 - F.col("m"))).alias("d"))
