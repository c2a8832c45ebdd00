"""Density clustering of vectors into topics and noise (M1-M3), substitutes where the usual libraries are missing.

M1 embeddings are an input. M2 is a principal component projection in place of a neighbour embedding. M3 links records that are
mutually dense: the core distance of a record is its distance to its k-th neighbour, two records are linked if both core distances
and their distance are at most the radius, components of core records of at least the minimum size are clusters, other
records within the radius of a core record join its cluster, the rest is noise (-1).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicweave.operators.graph import connected_components, reliable

#: Vectors per block of the similarity join.
BLOCK = 1024


def project(vectors: DataFrame, key: str, vec: str, dims: int) -> DataFrame:
    """M2: (key, reduced): the first principal components; the covariance is summed by Spark, dims² numbers reach the driver."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    v = vectors.select(key, array_to_vector(F.col(vec)).alias("_v"))
    model = PCA(k=dims, inputCol="_v", outputCol="_p").fit(v)
    return model.transform(v).select(key, vector_to_array("_p").alias("reduced"))


def _packed(v: DataFrame, parts: int) -> DataFrame:
    return v.withColumn("b", F.pmod(F.xxhash64("id"), F.lit(parts))).groupBy("b").agg(F.collect_list(F.struct("id", "v")).alias("rows"))


def block_pairs(v: DataFrame, total: int) -> DataFrame:
    """(ra, rb): blocks of at most about ``BLOCK`` vectors, every block with every block once in either order."""
    parts = max(1, -(-total // BLOCK))
    p = _packed(v, parts)
    other = F.explode(F.sequence(F.lit(0), F.lit(parts - 1)))
    a = p.select(F.col("b").alias("ba"), F.col("rows").alias("ra")).withColumn("bb", other)
    return a.join(p.select(F.col("b").cast("int").alias("bb"), F.col("rows").alias("rb")), "bb")


def _distances(ra, rb) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x, y = np.array([r["v"] for r in ra], float), np.array([r["v"] for r in rb], float)
    d = np.sqrt(np.maximum((x**2).sum(1)[:, None] + (y**2).sum(1)[None, :] - 2 * x @ y.T, 0))
    return np.array([r["id"] for r in ra]), np.array([r["id"] for r in rb]), d


def density_clusters(vectors: DataFrame, key: str, vec: str, k: int = 8, radius: float | None = None, least: int = 25) -> DataFrame:
    """M3: (key, cluster) with -1 for noise; ``radius`` defaults to the median core distance. Equal vectors are one node."""
    nodes = reliable(vectors.select(F.col(key).alias("key"), F.col(vec).cast("array<double>").alias("v")).withColumn("id", F.xxhash64("v")))
    v = nodes.groupBy("id").agg(F.first("v").alias("v"), F.count(F.lit(1)).alias("n"))
    total = v.count()
    if not total:
        return nodes.select(F.col("key").alias(key), F.lit(-1).cast("bigint").alias("cluster"))
    pairs = reliable(block_pairs(v, total))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ra, rb in zip(pdf["ra"], pdf["rb"], strict=True):
                a, _, d = _distances(ra, rb)
                m = min(k + 1, d.shape[1])
                yield pd.DataFrame({"id": a, "d": list(np.partition(d, m - 1, axis=1)[:, :m])})

    near = pairs.mapInPandas(nearest, "id long, d array<double>").groupBy("id").agg(F.sort_array(F.flatten(F.collect_list("d"))).alias("d"))
    core = reliable(near.select("id", F.get("d", F.least(F.lit(k), F.size("d") - 1)).alias("core")))
    if radius is None:
        radius = core.agg(F.percentile("core", 0.5)).first()[0]

    def within(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for ra, rb in zip(pdf["ra"], pdf["rb"], strict=True):
                a, b, d = _distances(ra, rb)
                i, j = np.nonzero(d <= radius)
                yield pd.DataFrame({"a": a[i], "b": b[j], "d": d[i, j]})

    links = reliable(pairs.mapInPandas(within, "a long, b long, d double").filter("a <> b"))
    dense = core.filter(F.col("core") <= radius).select("id")
    core_links = links.join(dense.withColumnRenamed("id", "a"), "a", "left_semi").join(dense.withColumnRenamed("id", "b"), "b", "left_semi")
    comp = connected_components(core_links, "a", "b")
    comp = dense.join(comp.withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("cluster"))
    rim = links.join(dense.withColumnRenamed("id", "a"), "a", "left_anti").join(comp.withColumnRenamed("id", "b"), "b")
    rim = rim.groupBy("a").agg(F.min(F.struct("d", "cluster")).alias("m")).select(F.col("a").alias("id"), F.col("m.cluster").alias("cluster"))
    found = comp.unionByName(rim)
    size = found.join(v.select("id", "n"), "id").groupBy("cluster").agg(F.sum("n").alias("size")).filter(F.col("size") >= least).select("cluster")
    found = found.join(size, "cluster", "left_semi")
    return nodes.select("key", "id").join(found, "id", "left").select(F.col("key").alias(key), F.coalesce("cluster", F.lit(-1)).alias("cluster"))
