"""Vector operators (J5, V3, V4, V5, query centroids).

Cosine top-K (V4) is a distributed scan: a query batch within
``MAX_QUERY_BYTES`` is a broadcast variable; every vector partition scores in
bounded blocks of NumPy mat-muls and emits its local top-k per query with the
vectors (ties broken by id, so local and global orders agree); a
``row_number`` window with a partial ``WindowGroupLimit`` then keeps the
global top-k.  Larger batches never reach the driver: they are dealt into
batches that meet shards of the vectors in co-groups.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import SEARCH
from ..session import materialise
from .ranking import top_k_per_group

MAX_QUERY_BYTES = 16 << 20
SCORE_BYTES = 32 << 20
SHARD_ROWS = 16_384


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body) -> Column:
    return F.element_at(F.transform(F.array(value), body), 1)


def dot(a, b) -> Column:
    return F.aggregate(F.zip_with(_c(a), _c(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def l2_norm(v) -> Column:
    return F.sqrt(F.aggregate(_c(v), F.lit(0.0), lambda s, x: s + x * x))


def l2_normalize(v) -> Column:
    """V3: unit vector; a zero vector stays as it is."""
    v = _c(v)
    return _let(l2_norm(v), lambda n: F.when(n > 0, F.transform(v, lambda x: x / n)).otherwise(
        F.transform(v, lambda x: x.cast("double"))))


def active_embeddings(docs: DataFrame, store: DataFrame, strict: bool = False) -> DataFrame:
    """Vectors of the given threads; ids without a vector drop (inner join).

    ``strict=True`` raises when nothing is left (one small action).
    """
    out = docs.select("thread_id").join(store.select("thread_id", "embedding"), "thread_id")
    if strict and out.isEmpty():
        raise ValueError("no active thread has a vector in the embedding store")
    return out


def dropped_ids(docs: DataFrame, store: DataFrame) -> DataFrame:
    """Threads that had no vector (anti-join report)."""
    return docs.select("thread_id").join(store.select("thread_id"), "thread_id", "left_anti")


def centroids(vectors: DataFrame, key: str, id_prefix: str = "") -> DataFrame:
    """Mean vector per ``key``, unit length: (query_id, query_text, embedding).

    Component means are a grouped aggregate over (key, position) with
    map-side partial sums; only #keys x dim rows are shuffled.
    """
    comp = vectors.select(key, F.posexplode("embedding").alias("pos", "x"))
    mean = comp.groupBy(key, "pos").agg(F.avg("x").alias("x"))
    vec = mean.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "x"))),
                                            lambda p: p["x"]).alias("embedding"))
    label = F.concat(F.lit(id_prefix), F.col(key).cast("string"))
    return vec.select(label.alias("query_id"), label.alias("query_text"), l2_normalize("embedding").alias("embedding"))


def _merge(best: tuple, ids: np.ndarray, x: np.ndarray, q: np.ndarray, k: int) -> tuple:
    """``best`` (query, row, score, ids, vectors of the rows) after more rows: the k best (score desc, id asc) of each
    query. Scores are made in blocks of ``SCORE_BYTES``; only vectors that some query still holds are kept."""
    qi, row, score, pool, vecs = best
    base = len(pool)
    pool, vecs = np.concatenate([pool, ids]), np.concatenate([vecs, x])
    code = np.unique(pool, return_inverse=True)[1]
    step = max(k, SCORE_BYTES // (8 * len(q)))
    for a in range(0, len(ids), step):
        block = x[a:a + step] @ q.T
        at = max(len(block) - k, 0)
        r, c = np.nonzero(block >= np.partition(block, at, axis=0)[at])
        qi, row, score = np.concatenate([qi, c]), np.concatenate([row, r + a + base]), np.concatenate([score, block[r, c]])
        order = np.lexsort((code[row], -score, qi))
        qi, row, score = qi[order], row[order], score[order]
        keep = np.arange(len(qi)) - np.searchsorted(qi, qi) < k
        qi, row, score = qi[keep], row[keep], score[keep]
    used, row = np.unique(row, return_inverse=True)
    return qi, row, score, pool[used], vecs[used]


def _topk_frames(frames, query_ids: np.ndarray, q: np.ndarray, k: int, id_col: str):
    best = np.empty(0, int), np.empty(0, int), np.empty(0), np.empty(0, object), np.empty((0, q.shape[-1]))
    for pdf in frames:
        if len(pdf) and len(q):
            best = _merge(best, pdf[id_col].to_numpy(), np.stack(pdf["embedding"].to_numpy()), q, k)
    qi, row, score, pool, vecs = best
    for a in range(0, len(qi), 10_000):
        b = slice(a, a + 10_000)
        yield pd.DataFrame({"query_id": query_ids[qi[b]], id_col: pool[row[b]], "score": score[b], "embedding": list(vecs[row[b]])})


def cosine_topk(queries: DataFrame, vectors: DataFrame, k: int = SEARCH.top_k_threads, id_col: str = "thread_id",
                normalize_queries: bool = True, with_vectors: bool = False) -> DataFrame:
    """V4: per query, the k stored vectors with the largest dot product.

    Queries are normalised; stored rows are assumed unit length (not
    re-normalised).  Null vectors, null components and vectors of another
    length than the queries' take no part.  Returns (query_id, id, score,
    rank), rank 1 = best, and with ``with_vectors`` the stored ``embedding``,
    so that no caller joins the store again.
    """
    spark = vectors.sparkSession
    qcol = l2_normalize("embedding") if normalize_queries else F.col("embedding")
    whole = F.forall("embedding", lambda x: x.isNotNull())
    q = materialise(queries.where(whole).select(F.col("query_id").cast("string").alias("query_id"), qcol.cast("array<double>").alias("embedding")), "queries")
    n, dim = q.agg(F.count(F.lit(1)), F.coalesce(F.max(F.size("embedding")), F.lit(0))).first()
    v = vectors.where(whole & (F.size("embedding") == dim)).select(
        F.col(id_col).cast("string").alias(id_col), F.col("embedding").cast("array<double>").alias("embedding"))
    schema = f"query_id string, {id_col} string, score double, embedding array<double>"
    if 8 * n * dim <= MAX_QUERY_BYTES:
        rows = q.orderBy("query_id").collect()  # within MAX_QUERY_BYTES
        batch = spark.sparkContext.broadcast((np.array([r[0] for r in rows], dtype=object),
                                              np.array([r[1] for r in rows], dtype=float).reshape(n, dim)))
        local = v.mapInPandas(lambda frames: _topk_frames(frames, *batch.value, k, id_col), schema)
    else:
        local = _topk_in_groups(q, v, k, id_col, schema, -(-16 * n * dim // MAX_QUERY_BYTES))
    top = top_k_per_group(local, ["query_id"], [F.col("score").desc(), F.col(id_col)], k)
    return top.select("query_id", id_col, "score", "rank", *(["embedding"] if with_vectors else []))


def _topk_in_groups(q: DataFrame, v: DataFrame, k: int, id_col: str, schema: str, batches: int) -> DataFrame:
    """Query batches beyond the broadcast bound: every (shard of vectors, batch of queries) is one co-group."""
    shards = max(1, -(-v.count() // SHARD_ROWS))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = v.withColumn("_s", F.pmod(F.xxhash64(id_col), F.lit(shards)).cast("int")).withColumn("_b", each(batches))
    right = q.withColumn("_b", F.pmod(F.xxhash64("query_id", "embedding"), F.lit(batches)).cast("int")).withColumn("_s", each(shards))

    def run(rows: pd.DataFrame, batch: pd.DataFrame) -> pd.DataFrame:
        empty = pd.DataFrame({"query_id": [], id_col: [], "score": [], "embedding": []}, dtype=object)
        if not len(rows) or not len(batch):
            return empty
        found = _topk_frames([rows], batch["query_id"].to_numpy(), np.stack(batch["embedding"].to_numpy()), k, id_col)
        return pd.concat([*found], ignore_index=True)

    return left.groupBy("_s", "_b").cogroup(right.groupBy("_s", "_b")).applyInPandas(run, schema)


def greedy_dedup(cands: DataFrame, threshold: float = SEARCH.dedup_threshold, id_col: str = "thread_id") -> DataFrame:
    """V5: walk each query's candidates in rank order, dropping a candidate whose
    cosine with any *kept* one is strictly above ``threshold`` (no refill).

    ``cands``: (query_id, id, score, rank, embedding).  The walk is an
    ``aggregate`` over the query's rank-sorted candidate array (bounded by k).
    """
    item = F.struct(F.col("rank"), F.col(id_col), F.col("score"), l2_normalize("embedding").alias("u"))
    per_q = cands.groupBy("query_id").agg(F.array_sort(F.collect_list(item)).alias("c"))
    empty = F.filter(F.col("c"), lambda x: F.lit(False))

    def step(acc, x):
        dup = F.exists(acc, lambda y: dot(x["u"], y["u"]) > F.lit(threshold))
        return F.when(dup, acc).otherwise(F.concat(acc, F.array(x)))

    kept = per_q.select("query_id", F.aggregate("c", empty, step).alias("k"))
    return kept.select("query_id", F.inline("k")).drop("u")
