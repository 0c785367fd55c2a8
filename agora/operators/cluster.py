"""Dimension reduction (V6) and density clustering (V7).

V6: MLlib PCA on the vectors (linear; stands in for a non-linear manifold
embedding, so distances differ from it).

V7: density clustering on the mutual-reachability graph (Campello, Moulavi,
Sander 2013), exact and built from Spark stages:

1. core distance = distance to the (min_samples - 1)-th other point (the point
   itself counts as one sample), with block pairs pruned by pivot balls
   (``balls``);
2. minimum spanning forests of the block pairs that can hold a tree edge, and
   one minimum spanning tree of their union by Boruvka rounds (``tree``);
3. the condensed tree from the tree's true weights and the choice of clusters
   by excess of mass (``tree``); the root is never a cluster.

Noise is -1; cluster ids 0..k-1 follow the smallest member id.
"""

from __future__ import annotations

from pyspark.ml.feature import PCA
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..params import TRENDING, cluster_sizes
from ..session import materialise
from .balls import blocks_of, core_distances, tree_candidates
from .tree import condensed, labelled, spanning_tree

NAME_END = "\x00"


def reduce_dims(vecs: DataFrame, k: int = TRENDING.reduced_dims) -> DataFrame:
    """V6: (thread_id, embedding) -> (thread_id, embedding of k PCA components)."""
    df = vecs.select("thread_id", array_to_vector("embedding").alias("_v"))
    dim = len(vecs.select("embedding").first()[0])
    model = PCA(k=min(k, dim), inputCol="_v", outputCol="_p").fit(df)
    return model.transform(df).select("thread_id", vector_to_array("_p").alias("embedding"))


def topic_clusters(vecs: DataFrame, reduce: bool = True, dims: int = TRENDING.reduced_dims,
                   min_cluster_size: int | None = None, min_samples: int | None = None,
                   block_size: int = 4096) -> DataFrame:
    """V7: (thread_id, embedding) -> (thread_id, topic_id), -1 = noise.  Rows that repeat a thread_id are points of their
    own; rows without one are points that get no result."""
    nth = F.row_number().over(Window.partitionBy("thread_id").orderBy("embedding"))
    src = vecs.select(F.col("thread_id").cast("string").alias("thread_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    # row n of an id under a name of its own, in place right behind the id
    name = F.when((F.col("_n") == 1) & F.col("thread_id").isNotNull(), F.col("thread_id")).otherwise(
        F.concat(F.coalesce("thread_id", F.lit(NAME_END)), F.lit(NAME_END), F.col("_n").cast("string")))
    src = materialise(src.withColumn("_n", nth).select(name.alias("thread_id"), "embedding"), "clusters-source")
    x = materialise(reduce_dims(src, dims), "clusters-reduced") if reduce else src
    n = x.count()
    sizes = cluster_sizes(n)
    least, samples = min_cluster_size or sizes[0], min_samples or sizes[1]
    if n < max(least, 2):
        return _named(x.select("thread_id", F.lit(-1).alias("topic_id")))
    blocks, balls = blocks_of(x, block_size)
    points, _ = core_distances(blocks, balls, samples - 1)
    edges, _ = tree_candidates(points, balls)
    homes, clusters = condensed(spanning_tree(edges), points, least)
    return _named(labelled(homes, clusters))


def _named(labels: DataFrame) -> DataFrame:
    return labels.filter(~F.col("thread_id").startswith(NAME_END)).withColumn("thread_id", F.substring_index("thread_id", NAME_END, 1))
