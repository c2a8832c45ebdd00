"""Problem 7: records of several sources mixed so that each source gives its target share of all tokens.

Systematic sampling. Every document of a source has the same expected number of copies; the documents are laid end to end by size, the
prefix sums of expected copies get one random offset per source, and a document is taken once per integer it crosses. So each is taken
the expected number of times rounded down or up, never more often than its source allows, and since neighbours are of like size the
tokens of a source come out close to its share.

The total is stated or defaults to the tokens that the target sources have. A source that cannot reach its share of it within its
repeats gives all its documents ``max_repeats`` times; what it lacks is spread over the others in proportion to their shares, as water
fills vessels, until each of them is full or the total is reached. Shares of sources without documents are spread likewise and
reported as 0, so the size of the mixture never hangs on the smallest source. Null, empty and token-free texts and rows of
sources without a target take no part; a null, zero or negative target share and repeats below 1 take a source out.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Documents of one source and one token count are ranked in slices of about so many rows.
SLICE = 50_000


def default_tokenizer() -> tuple[str, str]:
    """(path of the rank file, split pattern) of the installed public byte-level tokenizer."""
    import public_tokenizers as tokenizers

    return str(tokenizers.path("byte_bpe_50k.tiktoken")), tokenizers.PATTERN


@lru_cache(maxsize=2)
def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def token_counter(path: str | None = None, pattern: str | None = None):
    """A column function: number of tokens of a text, null for null. The tokenizer's file must exist on every executor."""
    if path is None or pattern is None:
        path, pattern = (a or b for a, b in zip((path, pattern), default_tokenizer(), strict=True))

    @F.pandas_udf(T.LongType())
    def count(texts: pd.Series) -> pd.Series:
        e = _encoding(path, pattern)
        return texts.map(lambda t: None if t is None else len(e.encode_ordinary(t))).astype("Int64")

    return count


def source_plan(sized: DataFrame, targets: DataFrame, source: str, total_tokens: float | None = None) -> DataFrame:
    """(<source>, target_share, max_repeats, share, documents, tokens, copies, full): one row per target.

    ``copies`` are the expected copies of each document, ``full`` says that the source is at its cap, ``share`` is its part of
    the planned mixture. Sources fill in the order of cap / target share: with the caps of those before it and the shares of those
    from it on, the level of a source is what the rest of the total comes to per unit of share; the first source whose level lies
    below its own cap fixes the level of all (levels only sink after it, so it is the largest of those), and those before it are full. Repeated targets of a source are the caller's error.
    """
    sized = sized.select(source, "n_tokens")
    have = sized.groupBy(source).agg(F.count(F.lit(1)).alias("documents"), F.sum("n_tokens").alias("tokens"))
    usable = "target_share > 0 AND max_repeats >= 1 AND tokens > 0"
    p = targets.select(source, "target_share", "max_repeats").join(have, source, "left").withColumn("usable", F.coalesce(F.expr(usable), F.lit(False)))
    p = p.withColumn("want", F.when(F.col("usable"), F.col("target_share"))).withColumn("cap", F.when(F.col("usable"), F.col("max_repeats") * F.col("tokens").cast("double")))
    one_group = Window.partitionBy(F.lit(1))  # one row per target source
    every = one_group.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    filling = one_group.orderBy(F.asc_nulls_last(F.col("cap") / F.col("want")), source)
    asked = F.lit(float(total_tokens)) if total_tokens is not None else F.sum(F.when(F.col("usable"), F.col("tokens").cast("double"))).over(every)
    spent = F.coalesce(F.sum("cap").over(filling.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    open_shares = F.sum("want").over(filling.rowsBetween(0, Window.unboundedFollowing))
    p = p.withColumn("level", F.when(F.col("usable"), (asked - spent) / open_shares))
    level = F.max(F.when(F.col("level") <= F.col("cap") / F.col("want"), F.col("level"))).over(every)
    p = p.withColumn("planned", F.when(F.col("usable"), F.least(F.coalesce(level * F.col("want"), F.col("cap")), F.col("cap"))))
    p = p.withColumn("share", F.col("planned") / F.sum("planned").over(every)).withColumn("full", F.col("usable") & (F.col("planned") >= F.col("cap")))
    copies = F.when(F.col("full"), F.col("max_repeats").cast("double")).otherwise(F.col("planned") / F.col("tokens"))
    return p.select(source, "target_share", "max_repeats", "share", F.coalesce("documents", F.lit(0)).alias("documents"), F.coalesce("tokens", F.lit(0)).alias("tokens"), F.coalesce(copies, F.lit(0.0)).alias("copies"), "full")


def mix_sources(docs: DataFrame, doc: str, source: str, targets: DataFrame, total_tokens: float | None = None, seed: int = 7) -> DataFrame:
    """(the columns of ``docs``, copy): the mixture, ``copy`` counting the copies of a document from 1.

    ``docs`` has ``n_tokens``. Rank within a source: slices of one token count (a large one split further by hash of the
    document) are counted, the slices of a source summed up, and rows ranked inside their slice alone. No task ever holds a
    source, only its distinct sizes, or a slice of about ``SLICE`` rows.
    """
    docs = docs.filter((F.col("n_tokens") > 0) & F.col(source).isNotNull())
    plan = source_plan(docs, targets, source, total_tokens).filter("copies > 0").select(source, F.col("copies").alias("_copies"), F.col("max_repeats").alias("_most"))
    docs = docs.join(plan, source)
    count = docs.groupBy(source, "n_tokens").agg(F.count(F.lit(1)).alias("_n"))
    parts = count.select(source, "n_tokens", F.greatest(F.lit(1), F.ceil(F.col("_n") / SLICE)).cast("int").alias("_parts"))
    # the join key is a size, which a third of all rows may share: the small side is measured and broadcast, or the skewed side is split
    docs = docs.join(parts, [source, "n_tokens"]).withColumn("_slice", F.pmod(F.xxhash64(doc, F.lit(seed)), F.col("_parts"))).drop("_parts")
    slices = docs.groupBy(source, "n_tokens", "_slice").agg(F.count(F.lit(1)).alias("_rows"))
    before = F.sum("_rows").over(Window.partitionBy(source).orderBy("n_tokens", "_slice").rowsBetween(Window.unboundedPreceding, -1))
    slices = slices.select(source, "n_tokens", "_slice", F.coalesce(before, F.lit(0)).alias("_before"))
    ranked = docs.withColumn("_rank", F.row_number().over(Window.partitionBy(source, "n_tokens", "_slice").orderBy(F.xxhash64(doc), doc)))
    ranked = ranked.join(slices, [source, "n_tokens", "_slice"])
    offset = F.pmod(F.xxhash64(source, F.lit(seed)), F.lit(1_000_003)) / 1_000_003.0
    upto = lambda n: F.floor(n * F.col("_copies") + offset + 1e-9)
    taken = F.least(upto(F.col("_before") + F.col("_rank")) - upto(F.col("_before") + F.col("_rank") - 1), F.col("_most")).cast("int")
    out = ranked.withColumn("_taken", taken).filter("_taken > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "_taken")))
    return out.drop("_copies", "_most", "_slice", "_rank", "_before", "_taken")


def mixture_report(mixture: DataFrame, docs: DataFrame, source: str, targets: DataFrame, total_tokens: float | None = None) -> DataFrame:
    """(<source>, target_share, planned_share, full, documents, taken, tokens, share_reached, most_copies): what each target source gave.

    ``share_reached`` is over the tokens of the whole mixture, 0 for a source without documents; ``full`` marks a source that
    its repeats keep below its target.
    """
    got = mixture.groupBy(source).agg(F.count(F.lit(1)).alias("taken"), F.sum("n_tokens").alias("got"), F.max("copy").alias("most"))
    plan = source_plan(docs.filter("n_tokens > 0"), targets, source, total_tokens).join(got, source, "left")
    all_rows = Window.partitionBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)  # one row per target source
    share = F.coalesce(F.col("got") / F.sum("got").over(all_rows), F.lit(0.0))
    zero = lambda c: F.coalesce(c, F.lit(0))
    return plan.select(source, "target_share", F.coalesce("share", F.lit(0.0)).alias("planned_share"), "full", "documents", zero("taken").alias("taken"), zero("got").alias("tokens"), share.alias("share_reached"), zero("most").alias("most_copies"))
