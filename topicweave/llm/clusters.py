"""Problem 1: records grouped into clusters of mutually similar ones by Markov clustering.

*Names*. What a record is about are the things that its texts name: a modifier before a *productive head*, a word before which ever new
modifiers stand (a device noun after invented names). Heads are learned from all records by counting, by a measure that does not
depend on the number of records (``productive_heads``).

*Graph*. Records are joined if they share at least ``SHARED`` names and the cosine of their name sets is at least ``SIMILAR``; a name
weighs 1, however many records treat its subject, and a record mentions some of its subject's names only, so two records of seven names
are joined if they share three. A phrase that names nothing weighs less, down to 0 for one in all records: it is in
more than ``COMMON`` of them, and two nodes that hold it share in the mean fewer than ``ALSO_SHARED`` other names. A pair that shares ``SHARED`` names
shares one outside each record's ``SHARED - 1`` most frequent names, so only the other ones are joined (prefix filter), and a pair
is kept at the rarest name that it meets at. Records with the same names are one node. All nodes of a name are compared; those of
a name of more than ``HOT`` nodes in blocks of about ``HOT_HEADS``, spread by hash, each with all nodes of the name, so that no task
gets all its pairs. The pairs of a subject grow with the square of its different nodes.

*Clusters*. Flow on the graph: the column-stochastic matrix is squared, inflated and freed of small entries until it stays; the row
to which most of a column's flow goes is its attractor, and columns with one attractor are a cluster. Squaring never crosses a
connected component, so components of at most ``BLOCK`` nodes are squared as dense blocks, many per task, and larger ones as
a distributed sparse matrix: a join and a sum per squaring, the entries of a hub spread over tasks. Both give the same clusters; a
matrix that still moves after ``ROUNDS`` squarings is an error.

Records with null or blank texts have no names and stay alone, as do records without similar ones. Rows of one record are one.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from topicweave.llm.textform import folded_form
from topicweave.operators.graph import connected_components, reliable

SHARED, SIMILAR, COMMON, ALSO_SHARED = 3, 0.4, 0.01, 1.0
#: What the records of a phrase share else is a mean over at least so many of them; it decides for all tables of over 5,000 records alike.
FEWEST = 50.0
#: A head follows at least so many different modifiers, and of ``DRAWS`` of its uses at least this part would be different ones.
MIN_MODIFIERS, DRAWS, PRODUCTIVE = 40, 200, 0.33
HOT, HOT_HEADS = 1000, 64
INFLATION, SMALL, ROUNDS, BLOCK = 2.0, 1e-3, 60, 1500
#: A step of the distributed squaring that so many entries meet is split.
HOT_STEP = 20_000
#: Heads are sent to the tasks; more are refused.
MAX_HEADS = 100_000

# Prepositions and auxiliaries, which are no heads.
NO_HEADS = frozenset("about above across after against along among around before behind below beneath beside between beyond despite during except inside like near off once onto out outside over past since through throughout toward towards under unlike until up upon versus within without can could may might must shall should will would".split())
# Function words that stand before a noun without naming it.
PLAIN_MODIFIERS = frozenset("a an the this that these those its their our his her each every both all any no some such same other another of in on at by for with from into as to and or but nor via per using which how what when where than then there here is are was were be been has have had do does did not only also more most less least one two three four five six seven eight nine ten first second third last next new".split())
_BEYOND = re.compile(r"[^\x00-\x7f]")
_ASCII_SIGNS = bytes(ord("\n") if c < 128 and re.match(r"[^\w\s-]", chr(c)) else c for c in range(256))


def _letter_or_break(m: re.Match) -> str:
    c = m[0]
    return c if c.isalnum() or c.isspace() else "\n"




def _tokens(text: str) -> list[str]:
    """Words and, for every sign or line break between them, a full stop; folded."""
    if not text.isascii():
        text = _BEYOND.sub(_letter_or_break, folded_form(text))
        return text.encode().translate(_ASCII_SIGNS).decode().replace("\n", " . ").split()
    return text.encode().lower().translate(_ASCII_SIGNS).decode().replace("\n", " . ").split()


def _is_modifier(word: str) -> bool:
    return word not in PLAIN_MODIFIERS and word.replace("-", "").isalpha()


def _count_bigrams(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Uses of each pair of neighbouring words in a batch; pairs are tested once when they leave, not once per use."""
    for pdf in batches:
        words = [w for c in pdf.columns for t in pdf[c] if t for w in (*_tokens(t), ".")]
        if len(words) < 2:
            continue
        number = {w: i for i, w in enumerate(dict.fromkeys(words))}
        at = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
        names = list(number)
        pairs, n = np.unique(at[:-1] * len(names) + at[1:], return_counts=True)
        good = np.array([_is_modifier(w) for w in names])
        head = good & np.array([len(w) > 2 and w not in NO_HEADS for w in names])
        left, right = pairs // len(names), pairs % len(names)
        keep = good[left] & head[right]
        if keep.any():
            yield pd.DataFrame({"head": [names[i] for i in right[keep]], "modifier": [names[i] for i in left[keep]], "n": n[keep]})


def productive_heads(texts: DataFrame) -> DataFrame:
    """(head, modifiers, uses): words before which ever new modifiers stand, by counts over all texts.

    The most frequent modifier of a word is left out (a set phrase, or a subject that very many records treat). Of the others, the
    expected number of different ones among ``DRAWS`` random uses decides: Σ 1 - (1 - n/N)^DRAWS over modifiers of n of N uses.
    It depends on the shares of the modifiers and not on the size of the corpus, nor on how often records are delivered; the part
    of new modifiers among all uses, in contrast, sinks with every record. A word used more rarely is drawn as often as it is used.
    """
    pairs = texts.mapInPandas(_count_bigrams, "head string, modifier string, n long")
    pairs = pairs.groupBy("head", F.xxhash64("modifier").alias("modifier")).agg(F.sum("n").alias("n"))
    # modifiers of equal counts are one row: a word has few different counts
    counts = pairs.groupBy("head", "n").agg(F.count(F.lit(1)).cast("double").alias("k"))
    every = counts.groupBy("head").agg(F.max("n").alias("top"), F.sum("k").alias("modifiers"), F.sum(F.col("n") * F.col("k")).alias("uses"))
    counts = counts.join(every.filter(F.col("modifiers") > MIN_MODIFIERS), "head")
    k = F.when(F.col("n") == F.col("top"), F.col("k") - 1).otherwise(F.col("k"))
    rest = F.col("uses") - F.col("top")
    draws = F.least(F.lit(float(DRAWS)), rest)
    new = k * (1.0 - F.pow(1.0 - F.col("n") / rest, draws))
    heads = counts.filter(rest > 0).groupBy("head", "modifiers", "uses", "top").agg(F.sum(new).alias("new"))
    heads = heads.filter(F.col("new") >= PRODUCTIVE * F.least(F.lit(float(DRAWS)), F.col("uses") - F.col("top")))
    return heads.select("head", F.col("modifiers").cast("long").alias("modifiers"), F.col("uses").cast("long").alias("uses"))


def record_names(rows: DataFrame, record: str, fields: list[str], heads: set[str]) -> DataFrame:
    """(<record>, name): what each record names, as hashes, each once."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keys, names = [], []
            for key, *texts in zip(pdf[record], *(pdf[f] for f in fields), strict=True):
                own = set()
                for t in texts:
                    if t:
                        w = _tokens(t)
                        own.update(f"{w[i - 1]} {w[i]}" for i, x in enumerate(w) if x in heads and i and _is_modifier(w[i - 1]))
                keys += [key] * len(own)
                names += sorted(own)
            if keys:
                yield pd.DataFrame({record: keys, "name": names})

    kind = dict(rows.dtypes)[record]
    named = rows.select(record, *fields).mapInPandas(run, f"`{record}` {kind}, name string")
    return named.select(record, F.xxhash64("name").alias("name")).distinct()


class RecordClusters:
    """Markov clusters of the records of a table."""

    def __init__(self, rows: DataFrame, record: str, fields: list[str], needed: str) -> None:
        rows = rows.filter(F.col(record).isNotNull() & (F.length(F.trim(F.col(needed))) > 0))
        self.rows, self.record, self.fields = rows, record, fields
        heads = [r[0] for r in productive_heads(rows.select(*fields)).select("head").limit(MAX_HEADS + 1).collect()]
        if len(heads) > MAX_HEADS:
            raise ValueError(f"more than {MAX_HEADS} productive heads")
        self.names = record_names(rows, record, fields, set(heads))

    def nodes(self) -> DataFrame:
        """(<record>, node, names): records by their sorted set of names; ``node`` is a hash of the set."""
        sets = self.names.groupBy(self.record).agg(F.sort_array(F.collect_set("name")).alias("names"))
        return sets.filter(F.size("names") >= SHARED).withColumn("node", F.xxhash64("names"))

    def edges(self, members: DataFrame) -> DataFrame:
        """(a, b, similarity) of similar nodes, a < b."""
        nodes = reliable(members.groupBy("node").agg(F.first("names").alias("names"), F.count(F.lit(1)).alias("copies")))
        named = nodes.select("node", "copies", "names", F.explode("names").alias("name"))
        # nodes decide what is joined, records what is common
        df = named.groupBy("name").agg(F.count(F.lit(1)).alias("df"), F.sum("copies").alias("records"))
        df = reliable(df.filter("df > 1"))  # a name of one node links nothing and weighs 1
        total = members.count()
        common = max(COMMON * total, FEWEST)
        # a common name counts less only if the nodes that hold it have little else in common; there are few, so their nodes bring their names along
        met = named.join(df.filter(F.col("records") > common).select("name"), "name").select(F.col("name").alias("common"), F.explode("names").alias("name"))
        met = met.filter(F.col("name") != F.col("common")).groupBy("common", "name").agg(F.count(F.lit(1)).cast("double").alias("c"))
        shared = met.groupBy(F.col("common").alias("name")).agg(F.sum(F.col("c") * (F.col("c") - 1)).alias("shared"))
        df = df.join(shared, "name", "left")
        phrase = (F.col("records") > common) & (F.coalesce("shared", F.lit(0.0)) < ALSO_SHARED * F.col("df") * (F.col("df") - 1.0))
        weight = F.when(phrase, F.log(total / F.col("records")) / np.log(max(total / common, 1.0001))).otherwise(1.0)
        named = named.select("node", "name", F.size("names").alias("k")).join(df, "name").withColumn("w", F.greatest(F.lit(0.0), weight))
        # rarest first; the names of one node alone count in the norm
        entry = F.struct("df", "name", "w")
        sets = named.groupBy("node", "k").agg(F.sort_array(F.collect_list(entry)).alias("set")).filter(F.size("set") >= SHARED)
        sets = sets.withColumn("norm", F.aggregate("set", (F.col("k") - F.size("set")).cast("double"), lambda s, x: s + x["w"] * x["w"]))
        sets = sets.select("node", "norm", F.transform("set", lambda x: x["name"]).alias("ids"), F.transform("set", lambda x: x["w"]).alias("ws"), F.transform("set", lambda x: x["df"]).alias("dfs"))
        sets = sets.withColumn("indexed", F.arrays_zip("ids", "dfs")).withColumn("indexed", F.slice("indexed", F.lit(1), F.size("indexed") - (SHARED - 1)))
        post = sets.select("node", "norm", "ids", "ws", F.explode("indexed").alias("at")).select("node", "norm", "ids", "ws", F.col("at.ids").alias("name"), F.col("at.dfs").alias("df"))
        blocks = F.when(F.col("df") > HOT, F.ceil(F.col("df") / HOT_HEADS)).otherwise(F.lit(1)).cast("int")
        a = post.select("name", F.pmod(F.xxhash64("node", "name"), blocks).cast("int").alias("block"), *[F.col(c).alias(f"{c}_a") for c in ("node", "norm", "ids", "ws")])
        b = post.select("name", F.explode(F.sequence(F.lit(0), blocks - 1)).alias("block"), *[F.col(c).alias(f"{c}_b") for c in ("node", "norm", "ids")])
        pairs = a.join(b, ["name", "block"]).filter("node_a < node_b")
        both = F.array_intersect("ids_a", "ids_b")
        pairs = pairs.withColumn("both", both).filter((F.size("both") >= SHARED) & (F.col("both")[0] == F.col("name")))
        dot = F.aggregate(F.zip_with("ids_a", "ws_a", lambda i, w: F.when(F.array_contains("both", i), w * w).otherwise(F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
        pairs = pairs.withColumn("similarity", dot / F.sqrt(F.col("norm_a") * F.col("norm_b"))).filter(F.col("similarity") >= SIMILAR)
        return pairs.groupBy(F.least("node_a", "node_b").alias("a"), F.greatest("node_a", "node_b").alias("b")).agg(F.max("similarity").alias("similarity"))

    def assign(self) -> DataFrame:
        """(<record>, cluster, flow): every record that names something with its cluster, the node of the attractor, or its own
        node if it stands alone; ``flow`` is the share of its flow that the attractor gets."""
        members = reliable(self.nodes())
        edges = reliable(self.edges(members))
        found = markov_clusters(edges)
        out = members.select(self.record, "node").join(found, "node", "left")
        return out.select(self.record, F.coalesce("cluster", "node").alias("cluster"), F.coalesce("flow", F.lit(1.0)).alias("flow"), "node")


def _dense_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Markov clusters of whole components, one row (component, edge lists) each."""
    for pdf in batches:
        out = []
        for a, b, s in zip(pdf["a"], pdf["b"], pdf["s"], strict=True):
            ids, at = np.unique(np.concatenate([a, b]), return_inverse=True)
            n = len(ids)
            m = np.zeros((n, n), np.float32)
            i, j = at[: len(a)], at[len(a) :]
            m[i, j] = m[j, i] = s
            m[np.arange(n), np.arange(n)] = m.max(axis=0)
            m /= m.sum(axis=0)
            for _ in range(ROUNDS):
                last, m = m, m @ m
                m = m**INFLATION
                m /= m.sum(axis=0)
                m[m < SMALL * m.max(axis=0)] = 0
                m /= m.sum(axis=0)
                if np.abs(m - last).max() < 1e-4:
                    break
            else:
                raise RuntimeError(f"the flow of {n} nodes still moves after {ROUNDS} squarings")
            to = m.argmax(axis=0)
            out.append(pd.DataFrame({"node": ids, "cluster": ids[to], "flow": m[to, np.arange(n)].astype(float)}))
        if out:
            yield pd.concat(out)


def _columns(m: DataFrame) -> DataFrame:
    """Entries (row, col, x) scaled so that each column sums to 1, without those below ``SMALL`` of the column's largest."""
    top = m.groupBy("col").agg(F.max("x").alias("top"))
    m = m.join(top, "col").filter(F.col("x") >= SMALL * F.col("top")).drop("top")
    total = m.groupBy("col").agg(F.sum("x").alias("total"))
    return m.join(total, "col").select("row", "col", (F.col("x") / F.col("total")).alias("x"))


def sparse_flow(edges: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """(node, cluster, flow) of a graph of any size: distributed squaring, inflation and pruning of sparse entries."""
    both = edges.select(F.col("a").alias("row"), F.col("b").alias("col"), F.col("similarity").alias("x"))
    both = both.unionAll(both.select(F.col("col").alias("row"), F.col("row").alias("col"), "x"))
    loops = both.groupBy("col").agg(F.max("x").alias("x")).select(F.col("col").alias("row"), "col", "x")
    m = reliable(_columns(both.unionByName(loops)))
    for _ in range(rounds):
        right = m.select(F.col("row").alias("k"), "col", F.col("x").alias("y"))
        left = m.select("row", F.col("col").alias("k"), "x")
        hubs = right.groupBy("k").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > HOT_STEP).select("k", F.ceil(F.col("n") / HOT_STEP).cast("int").alias("parts"))
        parts = F.coalesce("parts", F.lit(1))
        right = right.join(hubs, "k", "left").select("k", "col", "y", F.pmod(F.xxhash64("col"), parts).cast("int").alias("part"))
        left = left.join(hubs, "k", "left").select("row", "k", "x", F.explode(F.sequence(F.lit(0), parts - 1)).alias("part"))
        squared = left.join(right, ["k", "part"]).groupBy("row", "col").agg(F.sum(F.col("x") * F.col("y")).alias("x"))
        new = reliable(_columns(squared.withColumn("x", F.pow("x", F.lit(INFLATION)))))
        moved = new.withColumnRenamed("x", "n").join(m, ["row", "col"], "full").agg(F.max(F.abs(F.coalesce("n", F.lit(0.0)) - F.coalesce("x", F.lit(0.0))))).first()[0]
        m = new
        if moved is None or moved < 1e-4:
            break
    else:
        raise RuntimeError(f"the flow still moves after {rounds} squarings")
    best = m.groupBy("col").agg(F.max(F.struct("x", "row")).alias("m"))
    return best.select(F.col("col").alias("node"), F.col("m.row").alias("cluster"), F.col("m.x").alias("flow"))


def markov_clusters(edges: DataFrame, block: int = BLOCK) -> DataFrame:
    """(node, cluster, flow) of every node that has an edge.

    A component that is gathered as one row has at most ``block`` nodes, so at most ``block``² / 2 edges; the nodes of every
    component are counted before, and larger ones are never gathered.
    """
    component = connected_components(edges, "a", "b")
    sizes = component.groupBy("component").agg(F.count(F.lit(1)).alias("size"))
    component = reliable(component.join(sizes, "component"))
    edges = edges.join(component.select(F.col("node").alias("a"), "component", "size"), "a")
    small = edges.filter(F.col("size") <= block).groupBy("component").agg(F.collect_list(F.struct("a", "b", "similarity")).alias("e"))
    small = small.select(F.col("e.a").alias("a"), F.col("e.b").alias("b"), F.col("e.similarity").alias("s"))
    out = small.mapInPandas(_dense_blocks, "node long, cluster long, flow double")
    large = edges.filter(F.col("size") > block)
    if large.limit(1).count():
        out = out.unionByName(sparse_flow(large.select("a", "b", "similarity")))
    return out


def cluster_pairs(assigned: DataFrame, record: str) -> DataFrame:
    """(<record>_a, <record>_b): different records of one cluster, smaller first: what a list of cases asks for."""
    several = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").drop("n")
    rows = assigned.select(record, "cluster").join(several, "cluster", "left_semi")
    a, b = rows.withColumnRenamed(record, f"{record}_a"), rows.withColumnRenamed(record, f"{record}_b")
    return a.join(b, "cluster").filter(F.col(f"{record}_a") < F.col(f"{record}_b")).select(f"{record}_a", f"{record}_b")


def cluster_report(assigned: DataFrame, record: str, members: int = 3) -> DataFrame:
    """(cluster, size, typical): clusters of at least two records with their most typical ones, those with most flow to the
    attractor, the attractor first. Per cluster only the best ``members`` are kept while aggregating."""
    rank = Window.partitionBy("cluster", "part").orderBy(F.desc(F.col("node") == F.col("cluster")), F.desc("flow"), record)
    parts = assigned.withColumn("part", F.pmod(F.xxhash64(record), F.lit(64)))
    best = parts.withColumn("k", F.row_number().over(rank)).filter(F.col("k") <= members)
    again = Window.partitionBy("cluster").orderBy(F.desc(F.col("node") == F.col("cluster")), F.desc("flow"), record)
    best = best.withColumn("k", F.row_number().over(again)).filter(F.col("k") <= members)
    typical = best.groupBy("cluster").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", record))), lambda x: x[record]).alias("typical"))
    size = assigned.groupBy("cluster").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    return size.join(typical, "cluster").select("cluster", "size", F.array_join("typical", ", ").alias("typical"))
