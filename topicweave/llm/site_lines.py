"""Problem 2: lines that one source repeats over its documents.

Method: numbers, dates and names are masked; the distinct masked lines of a source, its *kinds*, meet by locality-sensitive hashing
(MinHash over shingles of five words, banded for a similarity of 0.8), are compared by their shingles and grouped by
connected components; a group that many documents of its source use is boilerplate.

A *line* is a piece between line feeds, counted from 1. Its *letters* are its folded form without anything that is no letter; lines of a
source with the same letters are of one group whatever their words. A line without letters, a null text and a null or blank source
give nothing; a null record counts for no line, but its lines are found.

The texts are read once, in Python batches; what moves afterwards are hashes, and shingles only of kinds that share a bucket.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicweave.llm.textform import folded_form
from topicweave.operators.graph import connected_components, reliable

SHINGLE, BANDS, ROWS, SIMILAR = 5, 8, 4, 0.8
#: A bucket chooses a leader so many times, then its other pairs are looked up; its members come back over so many salts.
LEADERS, SALTS = 3, 8
#: Jaccard distances obey the triangle inequality: a kind less like a leader than this is similar to none of the leader's star.
NEAR = 2 * SIMILAR - 1 - 1e-6
#: At least so many different records of one source must have a line.
MIN_RECORDS = 5

# Months by their English names and short forms.
MONTHS = frozenset("jan feb mar apr may jun jul aug sep sept oct nov dec january february march april june july august september october november december".split())
_NO_LETTER = bytes(c for c in range(128) if not chr(c).isalpha())
_MULT = np.uint64(0x9E3779B97F4A7C15)


def letters_of(line: str) -> str:
    """The letters of the folded form of a line."""
    if line.isascii():
        return line.encode().lower().translate(None, _NO_LETTER).decode()
    return "".join(c for c in folded_form(line) if c.isalpha())


def mask_word(word: str) -> str:
    """A word without punctuation in lower case; ``#`` for numbers, dates and months, ``@`` for a capitalised name."""
    bare = word.strip(".,;:!?()[]{}<>\"'-–—©*")
    if not bare or any(c.isdigit() for c in bare) or bare.lower() in MONTHS:
        return "#" if bare else ""
    return "@" if bare[0].isupper() and not bare.isupper() else bare.lower()


class _Masked(dict):
    """Hash of the masked form of each word; the first word of a line is looked up in lower case."""

    def __missing__(self, word: str) -> int:
        if len(self) > 300_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(mask_word(word))
        return h


def masked_words(line: str, known: _Masked) -> list[int]:
    """Hashes of the masked words of a line; its first word counts as written in lower case."""
    w = (line if line.isascii() else folded_form(line)).split()
    return [known[w[0].lower()], *map(known.__getitem__, w[1:])] if w else [0]


def shingles(lines: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """(hash, number of the line) of every shingle of ``SHINGLE`` words; a line of fewer words is one shingle."""
    size = np.array([len(w) for w in lines])
    flat = np.fromiter((h for w in lines for h in w), np.uint64, size.sum())
    start = np.concatenate([[0], np.cumsum(size)[:-1]])
    padded = np.concatenate([flat, np.zeros(SHINGLE, np.uint64)])
    h = np.zeros(len(flat), np.uint64)
    place = np.arange(len(flat)) - np.repeat(start, size)
    left = np.repeat(size, size) - place
    for j in range(SHINGLE):
        h = h * _MULT + np.where(left > j, padded[j : j + len(flat)], np.uint64(0))
        h ^= h >> np.uint64(31)
    keep = (left >= SHINGLE) | (place == 0)
    return h[keep] * _MULT, np.repeat(np.arange(len(lines)), size)[keep]


def signatures(h: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """MinHash of each line from its shingles, one row of ``BANDS * ROWS`` values each; ``owner`` ascends without gaps."""
    start = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    out = np.empty((len(start), BANDS * ROWS), np.uint64)
    for i in range(BANDS * ROWS):
        x = (h ^ np.uint64((i + 1) * 0x9E3779B97F4A7C15 % 2**64)) * np.uint64(((i + 7) * 0xC2B2AE3D27D4EB4F | 1) % 2**64)
        x ^= x >> np.uint64(32)
        out[:, i] = np.minimum.reduceat(x * _MULT, start)
    return out


def band_values(sig: np.ndarray) -> np.ndarray:
    """One value per band of each signature."""
    bands = np.zeros((len(sig), BANDS), np.uint64)
    for r in range(ROWS):
        bands = (bands ^ sig[:, r::ROWS][:, :BANDS]) * _MULT
        bands ^= bands >> np.uint64(29)
    return (bands + np.arange(BANDS, dtype=np.uint64) * np.uint64(7919)).view(np.int64)


def _lists(values: np.ndarray, sizes: np.ndarray, null: np.ndarray) -> pa.Array:
    offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32))
    return pa.ListArray.from_arrays(offsets, pa.array(values), mask=pa.array(null))


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = _Masked()
    digest = xxhash.xxh64_intdigest
    for batch in batches:
        at_row, numbers, at_line, sites = [], [], [], {}
        lines: dict[tuple[str, str], int] = {}  # (site, line) of this batch -> its place among nodes and kinds
        nodes, kinds, words, first, of_site = [], [], [], [], []
        seen: set[int] = set()
        records = [None if r is None else digest(r) - 2**63 for r in batch.column(1).to_pylist()]
        for i, (text, source) in enumerate(zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)):
            if not text or not source:
                continue
            site = sites.get(source)
            if site is None:
                site = sites[source] = "".join(source.lower().split())
            if not site:
                continue
            for number, line in enumerate(text.split("\n"), 1):
                at = lines.get((site, line))
                if at is None:
                    letters = letters_of(line)
                    at = lines[site, line] = len(nodes) if letters else -1
                    if letters:
                        w = masked_words(line, known)
                        kind = digest(f"{site}\n{w}") - 2**63
                        nodes.append(digest(f"{site}\n{letters}") - 2**63)
                        kinds.append(kind)
                        first.append(kind not in seen)
                        if first[-1]:
                            seen.add(kind)
                            words.append(w)
                            of_site.append(digest(site) - 2**63)
                if at >= 0:
                    at_row.append(i)
                    numbers.append(number)
                    at_line.append(at)
        if not at_row:
            continue
        h, owner = shingles(words)
        bands = np.column_stack([band_values(signatures(h, owner)), np.array(of_site, np.int64)])
        small = (h >> np.uint64(32)).astype(np.uint32).view(np.int32)
        order = np.lexsort((small, owner))
        small, owner = small[order], owner[order]
        fresh = np.concatenate([[True], (small[1:] != small[:-1]) | (owner[1:] != owner[:-1])])
        small, sizes = small[fresh], np.bincount(owner[fresh], minlength=len(words))
        # the first row of a kind in this batch brings its bands, behind them its site, and shingles; kinds are numbered as they come
        at_line = np.array(at_line)
        brings = np.zeros(len(at_line), bool)
        _, firsts = np.unique(at_line, return_index=True)
        brings[firsts[np.array(first)]] = True
        size = np.zeros(len(at_line), np.int64)
        size[brings] = sizes
        yield pa.RecordBatch.from_arrays([
            batch.column(0).take(pa.array(at_row)), pa.array(numbers, pa.int32()), pa.array(records, pa.int64()).take(pa.array(at_row)),
            pa.array(np.array(nodes)[at_line]), pa.array(np.array(kinds)[at_line]), _lists(bands.reshape(-1), brings * (BANDS + 1), ~brings), _lists(small, size, ~brings),
        ], ["row", "line_no", "record", "node", "kind", "bands", "shingles"])


def source_key(source: Column) -> Column:
    """Sources are the same apart from letter case and spacing."""
    return F.regexp_replace(F.lower(source), r"[\s\p{Z}]+", "")


class SiteLines:
    """The lines of a table of texts, read once and kept in the checkpoint folder as hashes."""

    def __init__(self, rows: DataFrame, row: str, record: str, text: str, source: str, min_records: int = MIN_RECORDS) -> None:
        self.rows, self.row, self.text, self.source, self.min_records = rows, row, text, source, min_records
        kind = dict(rows.dtypes)[row]
        schema = f"row {kind}, line_no int, record bigint, node bigint, kind bigint, bands array<bigint>, shingles array<int>"
        raw = rows.select(F.col(row), F.col(record).cast("string"), F.col(text), F.col(source)).filter(F.col(text).isNotNull() & F.col(source).isNotNull())
        self.lines = reliable(raw.mapInArrow(_read, schema))

    def links(self) -> DataFrame:
        """(a, b): kinds whose shingles have a Jaccard similarity of at least ``SIMILAR``; they connect all such pairs of a bucket.

        In each bucket a leader, its least or greatest kind by the bucket's parity, is compared with the others; those unlike it
        choose a leader again, ``LEADERS`` times. A bucket's rows are never brought together: leaders are a partial aggregate
        and come back by a join salted by kind, so a bucket may hold a third of all rows, and copies of a kind meet nobody.
        Pairs that met no leader together are left to ``_other_pairs``: kinds that stay open, and a star with the kinds ``NEAR`` its leader.
        """
        told = self.lines.filter("bands IS NOT NULL")
        open_ = told.select("kind", F.posexplode(F.slice("bands", 1, BANDS)).alias("band", "value")).select("kind", F.xxhash64("value", "band").alias("bucket"))
        found = sets = sides = None
        for _ in range(LEADERS):
            heads = open_.groupBy("bucket").agg(F.min("kind").alias("low"), F.max("kind").alias("high")).filter("low <> high")
            head = F.when(F.col("bucket").bitwiseAND(F.lit(1)) == 0, F.col("low")).otherwise(F.col("high"))
            heads = heads.select("bucket", head.alias("head"), F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
            met = open_.withColumn("salt", F.pmod("kind", F.lit(SALTS)).cast("int")).join(heads, ["bucket", "salt"]).select("kind", "head", "bucket")
            met = reliable(met.filter("kind <> head").distinct())
            if sets is None:  # the kinds of later rounds are among these
                asked = met.select("kind").unionByName(met.select(F.col("head").alias("kind"))).distinct()
                sets = reliable(told.select("kind", "shingles").join(asked, "kind", "left_semi").dropDuplicates(["kind"]))
            pairs = met.join(sets, "kind").join(sets.select(F.col("kind").alias("head"), F.col("shingles").alias("of_head")), "head")
            common = F.size(F.array_intersect("shingles", "of_head"))
            union = F.size("shingles") + F.size("of_head") - common
            pairs = reliable(pairs.select("kind", "head", "bucket", (common >= SIMILAR * union).alias("like"), (common >= NEAR * union).alias("near")))
            side = pairs.filter("near").select(F.xxhash64("bucket", "head").alias("group"), "kind", F.col("like").alias("left"), (~F.col("like")).alias("right"))
            sides = side if sides is None else sides.unionByName(side)
            like, open_ = pairs.filter("like").select("kind", "head"), pairs.filter("NOT like").select("kind", "bucket")
            found = like if found is None else found.unionByName(like)
            if open_.isEmpty():
                break
        sides = sides.unionByName(open_.select(F.xxhash64("bucket").alias("group"), "kind", F.lit(True).alias("left"), F.lit(True).alias("right")))
        return found.select(F.col("kind").alias("a"), F.col("head").alias("b")).unionByName(self._other_pairs(sides, sets)).distinct()

    @staticmethod
    def _other_pairs(sides: DataFrame, sets: DataFrame) -> DataFrame:
        """(a, b): similar kinds of one group, one from its left and one from its right side, exactly.

        Sets of that similarity share a shingle among the first ones of both in any one order; with the rarest first,
        the kinds of a full bucket that only have common shingles in common do not meet.
        """
        full = sides.groupBy("group").agg(F.count_if("left").alias("l"), F.count_if("right").alias("r"), F.count(F.lit(1)).alias("n")).filter("l > 0 AND r > 0 AND n > 1")
        sides = reliable(sides.join(full.select("group"), "group"))
        told = sets.join(sides.select("kind").distinct(), "kind", "left_semi").select("kind", F.size("shingles").alias("size"), F.explode("shingles").alias("shingle"))
        often = told.groupBy("shingle").agg(F.count(F.lit(1)).alias("often"))
        told = told.join(often, "shingle").withColumn("rank", F.row_number().over(Window.partitionBy("kind").orderBy("often", "shingle")))
        told = reliable(told.filter(F.col("rank") <= F.col("size") - F.ceil(SIMILAR * F.col("size") - 1e-6) + 1).select("kind", "size", "shingle"))
        left = sides.filter("left").select("group", "kind").join(told, "kind").select("group", "shingle", F.col("kind").alias("a"), F.col("size").alias("m"))
        right = sides.filter("right").select("group", "kind").join(told, "kind").select("group", "shingle", F.col("kind").alias("b"), F.col("size").alias("n"))
        met = left.join(right, ["group", "shingle"]).filter(F.col("a") != F.col("b")).filter(F.least("m", "n") >= SIMILAR * F.greatest("m", "n") - 1e-6)
        met = met.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        of = lambda k: sets.select(F.col("kind").alias(k), F.col("shingles").alias(f"of_{k}"))
        common = F.size(F.array_intersect("of_a", "of_b"))
        alike = common >= SIMILAR * (F.size("of_a") + F.size("of_b") - common)
        return met.join(of("a"), "a").join(of("b"), "b").filter(alike).select("a", "b")

    def clusters(self) -> DataFrame:
        """(row, line_no, record, node, cluster): every line with its near-duplicate group.

        Kinds are linked by similarity, and by lines with the same letters. Only kinds that have a link are labelled by components;
        each other is its own group. What several sources write alike is a group of each of them.
        """
        spelled = self.lines.groupBy("node").agg(F.min("kind").alias("a"), F.max("kind").alias("z")).filter("a <> z").select("node", "a")
        spelled = self.lines.select("node", "kind").join(spelled, "node").filter("a <> kind").select("a", F.col("kind").alias("b"))
        member = connected_components(self.links().unionByName(spelled), "a", "b").withColumnRenamed("node", "kind")
        site = self.lines.filter("bands IS NOT NULL").select("kind", F.element_at("bands", BANDS + 1).alias("site")).distinct()
        member = member.join(site, "kind").select("kind", F.xxhash64("site", "component").alias("component"))
        lines = self.lines.select("row", "line_no", "record", "node", "kind").join(member, "kind", "left")
        return lines.select("row", "line_no", "record", "node", F.coalesce("component", "kind").alias("cluster"))

    def used(self, lines: DataFrame, group: str) -> DataFrame:
        """(<group>, records): groups that at least ``min_records`` different records have. Distinct first: it combines on the map side
        and spreads by record, so a group that a third of all rows use is no hot key."""
        seen = lines.filter("record IS NOT NULL").select(group, "record").distinct()
        return seen.groupBy(group).agg(F.count(F.lit(1)).alias("records")).filter(F.col("records") >= self.min_records)

    def found(self, exact: bool = True) -> DataFrame:
        """(<row>, line_no, cluster, records): the lines whose group is used by at least ``min_records`` records of its source.

        With ``exact`` the groups are candidates only, and a line of them counts if ``min_records`` records share its very letters;
        without, near-duplicates count together, and ``records`` are those of the group.
        """
        lines = reliable(self.clusters())
        found = lines.join(self.used(lines, "cluster"), "cluster")
        if exact:
            found = found.drop("records")
            found = found.join(self.used(found, "node"), "node")
        return found.select(F.col("row").alias(self.row), "line_no", "cluster", "records")

    def report(self) -> DataFrame:
        """(source_key, cluster, sample, records): the repeated groups of each source, with one way they are written."""
        first = self.found(exact=False).groupBy("cluster", "records").agg(F.min(F.struct(F.col(self.row).alias("row"), "line_no")).alias("at"))
        texts = self.rows.select(F.col(self.row).alias("row"), F.col(self.text).alias("text"), source_key(F.col(self.source)).alias("source_key"))
        out = first.select("cluster", "records", "at.row", "at.line_no").join(texts, "row")
        return out.select("source_key", "cluster", F.element_at(F.split("text", "\n"), F.col("line_no")).alias("sample"), "records")

    def without(self) -> DataFrame:
        """(<row>, <text>, removed): every row's text without the repeated lines and the number of lines taken out.

        Near-duplicates count together. Rows without repeated lines keep their text, a null text stays null. ``row`` identifies a
        row; only line numbers are gathered per row, so a group is bounded by one text.
        """
        gone = self.found(exact=False).groupBy(self.row).agg(F.collect_set("line_no").alias("gone"))
        out = self.rows.select(self.row, self.text).join(gone, self.row, "left")
        kept = F.filter(F.split(self.text, "\n"), lambda x, i: ~F.coalesce(F.array_contains("gone", i + 1), F.lit(False)))
        text = F.when(F.col("gone").isNull(), F.col(self.text)).otherwise(F.array_join(kept, "\n"))
        return out.select(self.row, text.alias(self.text), F.coalesce(F.size("gone"), F.lit(0)).alias("removed"))
