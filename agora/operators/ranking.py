"""First-k-per-group, top-k and ordering operators (K1-K9).

Every ordering carries an explicit id tie-breaker, because Spark has no input
order.  ``row_number() <= k`` over a window lets Catalyst insert a partial
``WindowGroupLimit`` *before* the shuffle, so a hot group (one thread holding a
third of all comments) is cut to k rows per map task before it moves.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int,
                    rank_col: str = "rank") -> DataFrame:
    """Rows ranked 1..k within each group of ``keys`` by ``order``."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank_col, F.row_number().over(w)).where(F.col(rank_col) <= F.lit(k))


def first_ranks_per_group(df: DataFrame, keys: Sequence[str], order: Sequence[Column], k: int) -> DataFrame:
    """Rows of rank 1..k within each group, with all rows that tie for the last: holds ``top_k_per_group`` of any tie-break."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.rank().over(w)).where(F.col("_rank") <= F.lit(k)).drop("_rank")


def dedupe_threads(threads: DataFrame) -> DataFrame:
    """K1: keep the highest-score row per thread (nulls last; ties -> earliest, then url)."""
    order = [F.col("score").desc_nulls_last(), F.col("created_utc").asc_nulls_last(),
             F.col("external_url").asc_nulls_last(), F.col("title").asc_nulls_last(),
             F.col("selftext").asc_nulls_last()]
    return top_k_per_group(threads, ["thread_id"], order, 1, "_rn").drop("_rn")


def top_comments_by_score(comments: DataFrame, k: int = 5) -> DataFrame:
    """K3: top-k comments per thread by score (desc, nulls last), tie -> comment_id."""
    if "score" not in comments.columns:
        return comments.limit(0).withColumn("rank", F.lit(0))
    order = [F.col("score").desc_nulls_last(), F.col("comment_id")]
    return top_k_per_group(comments, ["thread_id"], order, k)


def priority_order() -> list[Column]:
    return [F.col("comment_priority").desc_nulls_last(), F.col("comment_id")]


def top_comments_by_priority(comments: DataFrame, k: int = 5) -> DataFrame:
    """K2: top-k comments per thread by ``comment_priority``."""
    return top_k_per_group(comments, ["thread_id"], priority_order(), k)


def latest_threads_per_topic(scored: DataFrame, k: int = 5) -> DataFrame:
    """K4: newest k threads per topic (created_utc desc), tie -> thread_id."""
    order = [F.col("created_utc").desc_nulls_last(), F.col("thread_id")]
    return top_k_per_group(scored, ["topic_id"], order, k)


def top_threads_by_trend(scored: DataFrame, k: int = 5) -> DataFrame:
    """K5: k highest trend_score threads per topic, tie -> thread_id."""
    order = [F.col("trend_score").desc_nulls_last(), F.col("thread_id")]
    return top_k_per_group(scored, ["topic_id"], order, k)


def top_topics(trends: DataFrame, n: int = 3) -> DataFrame:
    """K6: n best topics; orderBy + limit plans as TakeOrderedAndProject."""
    return trends.orderBy(F.col("topic_trend_score").desc_nulls_last(), F.col("topic_id")).limit(n)


def recent_points(timeline: DataFrame, n: int = 14, date_col: str = "date") -> DataFrame:
    """K7: the last n points of a flat (date, ...) timeline, ascending."""
    return timeline.orderBy(F.col(date_col).desc()).limit(n).orderBy(date_col)


def recent_slice(arr, n: int = 14) -> Column:
    """K7 on a nested timeline array: last n elements (whole array when shorter)."""
    a = F.col(arr) if isinstance(arr, str) else arr
    return F.when(F.size(a) > n, F.slice(a, -n, n)).otherwise(a)
