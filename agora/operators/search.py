"""Batch search (X2, X4, J7, J8, K3, K8): queries -> top-K threads -> near-dup
removal -> matched threads and comments -> context, summary and thread cards.

The matched-id table has at most #queries x K rows. It is written once; the
thread and comment scans take it by broadcast where its counted rows are within
the bound, by a shuffle join beyond it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import sentiment as se
from ..functions import text as tx
from ..params import SEARCH
from ..session import broadcast_if_small, materialise
from ..sources.html import page_main_text
from . import cards as cd
from .activity import with_bodies
from .ranking import top_k_per_group
from .vectors import cosine_topk, greedy_dedup

SERVING_URL_ORDER = ("thread_url", "external_url", "permalink")
#: Word sets of the leading texts of so many queries are broadcast; of more they travel to the comments by a shuffle.
MAX_SEED_QUERIES = 1000


def matched_threads(queries: DataFrame, vectors: DataFrame, k: int = SEARCH.top_k_threads,
                    threshold: float = SEARCH.dedup_threshold) -> DataFrame:
    """V4 + V5: (query_id, thread_id, score, rank) kept after near-duplicate removal."""
    top = cosine_topk(queries, vectors, k, with_vectors=True)
    return materialise(greedy_dedup(top, threshold), "matched")


def matched_rows(matched: DataFrame, threads: DataFrame, comments: DataFrame, bodies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Threads and comments (with their texts) of the matched threads, written once for all branches that read them."""
    ids = broadcast_if_small(matched.select("thread_id").distinct())
    return (materialise(threads.join(ids, "thread_id", "left_semi"), "matched-threads"),
            materialise(with_bodies(comments.join(ids, "thread_id", "left_semi"), bodies), "matched-comments"))


def query_context(queries: DataFrame, matched: DataFrame, threads: DataFrame, comments: DataFrame,
                  k_comments: int = SEARCH.top_k_comments, cap: int = SEARCH.query_context_chars,
                  bodies: DataFrame | None = None) -> DataFrame:
    """(query_id, context).  Threads in thread_id order; per thread its top
    comments by score; blank comment snippets skipped; capped at ``cap``.
    Keyed comments come with ``bodies``."""
    ids = broadcast_if_small(matched.select("query_id", "thread_id"))
    mt = threads.join(ids, "thread_id")
    mc = with_bodies(comments.join(ids, "thread_id"), bodies).withColumn("line", tx.snippet("body", 200, "after")).drop("body")  # cut before the ranking
    top = _top_comments(mc, k_comments)
    clines = top.where(F.col("line") != "").groupBy("query_id", "thread_id").agg(
        cd.ordered_join(F.col("rank"), F.concat(F.lit("  - "), F.col("line")), "\n").alias("clines"))
    blocks = mt.join(clines, ["query_id", "thread_id"], "left").select(
        "query_id", "thread_id",
        F.concat_ws("\n", F.concat(F.lit("Thread: "), tx.snippet("title_and_selftext", 300, "after")),
                    F.col("clines"), F.lit("")).alias("block"))
    body = blocks.groupBy("query_id").agg(cd.ordered_join(F.col("thread_id"), F.col("block"), "\n").alias("body"))
    header = F.concat(F.lit("USER QUERY: "), F.coalesce(F.col("query_text"), F.lit("")), F.lit("\n\nRELEVANT REDDIT THREADS:\n"))
    q = queries.select("query_id", "query_text").join(body, "query_id", "left")
    ctx = F.when(F.col("body").isNull(), header).otherwise(F.concat(header, F.lit("\n"), F.col("body")))
    return q.select("query_id", F.substring(ctx, 1, cap).alias("context"))


def _top_comments(mc: DataFrame, k: int) -> DataFrame:
    return top_k_per_group(mc, ["query_id", "thread_id"], [F.col("score").desc_nulls_last(), F.col("comment_id")], k)


def comment_clusters(matched: DataFrame, comments: DataFrame, k: int = SEARCH.comment_clusters, k_reps: int = SEARCH.rep_comments) -> DataFrame:
    """(query_id, cluster_id, size, rep_comments): every comment of a query's matched threads is in one group.

    The leading texts of a query are those of its ``k`` best comments (by score, then id) with different texts that hold a
    word. A comment belongs to the leading text of the nearest word set (Jaccard; ties: the better one, cluster 0 first),
    or to cluster -1 if it shares no word with any. A group is represented by the ``k_reps`` different texts nearest to its
    leading text (which comes first), each whole and under its best comment's id. The work is one comparison of each
    comment with k texts; ``comments`` (with texts) are written before and read for each step."""
    ids = broadcast_if_small(matched.select("query_id", "thread_id"))
    mc = comments.join(ids, "thread_id").select("query_id", "comment_id", "score", F.coalesce("body", F.lit("")).alias("text"))
    mc = mc.withColumn("tk", F.md5("text")).withColumn("best", F.struct(
        F.col("score").isNull().alias("no_score"), (-F.col("score").cast("long")).alias("falling"), F.col("comment_id").isNull().alias("no_id"), "comment_id"))
    lead = mc.where(F.col("text").rlike(r"[\p{L}\p{N}']")).groupBy("query_id", "tk").agg(F.min("best").alias("best"))
    lead = top_k_per_group(lead, ["query_id"], [F.col("best"), F.col("tk")], k).select("query_id", "tk", "rank")
    lead = broadcast_if_small(materialise(lead, "leading"))
    words = mc.select("query_id", "tk", "text").join(lead, ["query_id", "tk"]).groupBy("query_id", "rank").agg(F.max("text").alias("text"))
    seeds = words.select("query_id", F.struct("rank", F.array_distinct(se.tokens("text")).alias("words")).alias("s"))
    seeds = broadcast_if_small(materialise(seeds.groupBy("query_id").agg(F.collect_list("s").alias("seeds")), "seeds"), MAX_SEED_QUERIES)

    def nearest(words):
        def alike(s):
            both = F.size(F.array_intersect(words, s["words"]))
            return F.struct((both / (F.size(words) + F.size(s["words"]) - both)).alias("sim"), (-s["rank"]).alias("rank"))
        return F.array_max(F.transform("seeds", alike))

    near = mc.join(seeds, "query_id", "left").select("query_id", "tk", "best", se._let(F.array_distinct(se.tokens("text")), nearest).alias("near"))
    found = F.col("near.sim") > 0
    near = near.select("query_id", "tk", "best", F.when(found, -F.col("near.rank") - 1).otherwise(-1).alias("cluster_id"),
                       F.when(found, F.col("near.sim")).otherwise(0.0).alias("sim"))
    near = materialise(near.groupBy("query_id", "cluster_id", "sim", "tk").agg(F.count(F.lit(1)).alias("n"), F.min("best").alias("best")), "clusters")
    reps = top_k_per_group(near, ["query_id", "cluster_id"], [F.col("sim").desc(), F.col("best"), F.col("tk")], k_reps)
    reps = broadcast_if_small(materialise(reps.select("query_id", "cluster_id", "tk", "rank", "best.comment_id"), "representatives"))
    texts = mc.select("query_id", "tk", "text").join(reps, ["query_id", "tk"]).groupBy("query_id", "cluster_id", "rank", "comment_id").agg(F.max("text").alias("text"))
    rep = F.struct(F.coalesce("comment_id", F.lit("")).alias("comment_id"), "text")
    nested = texts.groupBy("query_id", "cluster_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct("rank", rep.alias("c")))), lambda x: x["c"]).alias("rep_comments"))
    sizes = near.groupBy("query_id", "cluster_id").agg(F.sum("n").alias("size"))
    return sizes.join(nested, ["query_id", "cluster_id"]).select("query_id", "cluster_id", "size", "rep_comments")


def listed_threads(matched: DataFrame, threads: DataFrame) -> DataFrame:
    """(query_id, thread_id, title, url) of the matched threads, title and url as on their cards."""
    t = tx.resolve_url(threads, list(SERVING_URL_ORDER), out="_url")
    return t.join(broadcast_if_small(matched.select("query_id", "thread_id")), "thread_id").select(
        "query_id", "thread_id", tx.snippet("title_and_selftext", 200, "none").alias("title"), F.col("_url").alias("url"))


def linked_articles(listed: DataFrame, pages: DataFrame) -> DataFrame:
    """(query_id, thread_id, url, text), the text of each page of a listed thread's url ('' without a page or text).
    Only pages of these urls are parsed."""
    linked = materialise(listed.where("url <> ''").select("query_id", "thread_id", "url").distinct(), "linked")
    urls = broadcast_if_small(linked.select("url").distinct())
    text = pages.join(urls, "url", "left_semi").select("url", F.coalesce(page_main_text("html"), F.lit("")).alias("text")).distinct()
    return linked.join(text, "url", "left").select("query_id", "thread_id", "url", F.coalesce("text", F.lit("")).alias("text"))


def thread_cards(matched: DataFrame, threads: DataFrame, comments: DataFrame, lexicon=None, bodies: DataFrame | None = None) -> DataFrame:
    """X4 cards: one row per (query, matched thread) with stats, nested dist/timeline (keyed comments: with ``bodies``)."""
    ids = broadcast_if_small(matched.select("query_id", "thread_id", F.col("score").alias("_sim")))
    t = tx.resolve_url(threads, list(SERVING_URL_ORDER), out="_url")
    mt = t.join(ids, "thread_id")
    mc = cd.scored_comments(with_bodies(comments.join(ids.drop("_sim"), "thread_id"), bodies), lexicon)
    stats = mc.groupBy("query_id", "thread_id").agg(*se.dist_aggs(), se.avg_agg())
    daily = mc.where(F.col("created_utc").isNotNull()).groupBy(
        "query_id", "thread_id", F.date_format("created_utc", "yyyy-MM-dd").alias("date")).agg(
        F.count(F.lit(1)).alias("count"))
    tl = daily.groupBy("query_id", "thread_id").agg(
        F.array_sort(F.collect_list(F.struct("date", "count"))).alias("comment_timeline"))
    zero = F.lit(0).cast("long")
    out = mt.join(stats, ["query_id", "thread_id"], "left").join(tl, ["query_id", "thread_id"], "left")
    return out.select(
        "query_id", "thread_id",
        tx.snippet("title_and_selftext", 200, "none").alias("title"),
        F.col("_url").alias("url"),
        F.coalesce(t["score"], F.lit(0)).alias("score"),
        F.coalesce("num_comments", F.lit(0)).alias("num_comments"),
        F.round(F.coalesce(F.col("_sim"), F.lit(0.0)), 3).alias("similarity"),
        F.coalesce("sentiment_avg", F.lit(0.0)).alias("sentiment_avg"),
        F.struct(*[F.coalesce(c, zero).alias(c) for c in ("positive", "neutral", "negative")]).alias("sentiment_dist"),
        F.coalesce("comment_timeline", F.array().cast("array<struct<date:string,count:bigint>>")).alias("comment_timeline"),
    )


def search(queries: DataFrame, vectors: DataFrame, threads: DataFrame, comments: DataFrame,
           k: int = SEARCH.top_k_threads, threshold: float = SEARCH.dedup_threshold, lexicon=None,
           summariser=None, bodies: DataFrame | None = None) -> DataFrame:
    """One row per query: summary + cards sorted by similarity (then rank); keyed comments come with ``bodies``."""
    matched = matched_threads(queries, vectors, k, threshold)
    threads, comments = matched_rows(matched, threads, comments, bodies)
    ctx = query_context(queries, matched, threads, comments)
    if summariser is None:
        summ = ctx.select("query_id", tx.query_summary("context").alias("summary"))
    else:
        def run(batches):
            for pdf in batches:
                yield summariser(pdf[["query_id", "context"]])[["query_id", "summary"]]
        summ = ctx.mapInPandas(run, "query_id string, summary string")
    cards = thread_cards(matched, threads, comments, lexicon).join(
        matched.select("query_id", "thread_id", "rank"), ["query_id", "thread_id"])
    nested = cards.groupBy("query_id").agg(F.transform(
        F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("_s"), F.col("rank").alias("_r"),
                                             F.struct(*[c for c in cards.columns if c not in ("query_id", "rank")]).alias("card")))),
        lambda x: x["card"]).alias("threads"))
    return queries.select("query_id", "query_text").join(summ, "query_id", "left").join(nested, "query_id", "left") \
        .withColumn("threads", F.coalesce("threads", F.array()))
