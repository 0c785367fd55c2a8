"""Exact top-k inner products by block-at-a-time pruning.

Vectors are turned to integers and dealt into shards by a hash of id and vector, so shards are even whatever the ids
are; a shard is sorted by id and cut into document-range blocks. Each block keeps the maximum and minimum of every term. For a query, a block's bound is the sum over the terms of the
query's weight times whichever of the two is greater. Queries take the blocks of a shard in falling order of bounds and
score them through the block's rows until the next bound lies below their kth score; then a shard gives at most k rows
for each query, and a last ranking merges shards. Query batches (of ``BATCH``) meet every shard, so a task holds one
shard and one batch, whatever the table's size.

Defined results: rows with a null id, a null vector or null or non-finite components take no part; vectors meet only
vectors of their own length; rows that repeat id and vector count once; of several vectors with a query's id the least
is the query, and none of them is a candidate for it; ties go to the smaller id; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import cut

SHARD, BLOCK, BATCH = 16_384, 256, 4_096


def block_topk(ids: np.ndarray, rows: np.ndarray, qids: np.ndarray, queries: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, int]:
    """(ids, scores) of each query's best k (id -1: none), and how many block scorings there were. ids rise."""
    exact = float(np.abs(rows).max(initial=0)) * float(np.abs(queries).max(initial=0)) * rows.shape[1] < 2 ** 53
    kind = np.float64 if exact else np.int64
    rows, queries = rows.astype(kind), queries.astype(kind)
    low = np.iinfo(np.int64).min if kind is np.int64 else -np.inf
    cuts = np.arange(0, len(ids), BLOCK)
    top, least = np.maximum.reduceat(rows, cuts), np.minimum.reduceat(rows, cuts)
    bound = np.maximum(queries, 0) @ top.T + np.minimum(queries, 0) @ least.T
    order = np.argsort(-bound, axis=1, kind="stable")
    best, who = np.full((len(qids), k), low, dtype=kind), np.full((len(qids), k), -1, dtype=np.int64)
    live, scored = np.arange(len(qids)), 0
    for r in range(len(cuts)):
        nxt = order[live, r]
        live, nxt = (x[(bound[live, nxt] >= best[live, -1]) | (who[live, -1] < 0)] for x in (live, nxt))
        if not len(live):
            break
        for b in np.unique(nxt):
            q = live[nxt == b]
            mine = slice(cuts[b], cuts[b] + BLOCK)
            s = queries[q] @ rows[mine].T
            own = qids[q][:, None] == ids[mine][None, :]
            s[own] = low
            scored += 1
            s = np.concatenate([best[q], s], axis=1)
            i = np.concatenate([who[q], np.where(own, -1, ids[mine][None, :])], axis=1)
            i[i < 0] = np.iinfo(np.int64).max if (ids >= 0).all() else -1
            pick = np.lexsort((i, -s), axis=1)[:, :k]
            best[q] = np.take_along_axis(s, pick, 1)
            i = np.take_along_axis(i, pick, 1)
            who[q] = np.where(best[q] == low, -1, i)
    return who, best, scored


def _score(k: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame({"query_id": [], "vec_id": [], "score": []}, dtype="int64")
        if not len(left) or not len(right):
            return out
        left = left.sort_values("vec_id", kind="stable")
        ids, qids = left["vec_id"].to_numpy(), right["query_id"].to_numpy()
        who, best, _ = block_topk(ids, np.stack(left["v"].to_list()), qids, np.stack(right["v"].to_list()), k)
        q, r = np.nonzero(np.isfinite(best.astype(np.float64)) & (best.astype(np.float64) > np.iinfo(np.int64).min))
        return pd.DataFrame({"query_id": qids[q], "vec_id": who[q, r], "score": best[q, r].astype(np.int64)})
    return run


def top_k(vectors: DataFrame, k: int = 5, every: int = 50, scale: float = 256.0, vec: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: queries are the rows whose vec_id is divisible by ``every``."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    clean = vectors.filter(F.col("vec_id").isNotNull() & F.col(vec).isNotNull() & F.forall(vec, fine) & (F.size(vec) > 0))
    ints = cut(clean.select("vec_id", F.transform(vec, lambda x: F.floor(x.cast("double") * scale).cast("long")).alias("v")).distinct(), "ints")
    queries = cut(ints.filter(F.col("vec_id") % every == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v")), "queries")
    shards, batches = max(1, -(-ints.count() // SHARD)), max(1, -(-queries.count() // BATCH))
    dim = F.size("v").alias("dim")
    left = ints.select("vec_id", "v", dim, F.pmod(F.xxhash64("vec_id", "v"), F.lit(shards)).cast("int").alias("shard"),
                       F.explode(F.sequence(F.lit(0), F.lit(batches - 1))).alias("batch"))
    right = queries.select("query_id", "v", dim, F.explode(F.sequence(F.lit(0), F.lit(shards - 1))).alias("shard"),
                           F.pmod(F.xxhash64("query_id"), F.lit(batches)).cast("int").alias("batch"))
    keys = ["dim", "shard", "batch"]
    near = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInPandas(_score(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_topk(spark, sf_dir: str) -> DataFrame:
    return top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


OP4_SQL = """
WITH v AS (SELECT DISTINCT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM s)
SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 5
"""
