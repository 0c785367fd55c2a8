"""Topic trend scoring (M2, J4, F4, A3) and its flagship query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import trend_score
from .activity import active_threads, window_end, windowed_comments


def score_topic_threads(active: DataFrame, topics: DataFrame, as_of: Column) -> DataFrame:
    """J4 + F4 + M2: attach topics (inner), drop noise (-1), score each thread."""
    return (
        active.join(topics.select("thread_id", "topic_id"), "thread_id")
        .where(F.col("topic_id") != -1)
        .withColumn("trend_score", trend_score("score", "num_comments", "created_utc", as_of))
    )


def aggregate_trends(scored: DataFrame) -> DataFrame:
    """A3: sum(trend)/sqrt(n) per topic (all-null sum -> 0), thread count, last activity.

    A plain grouped aggregate: partial sums per map task, so a topic holding a
    third of all threads costs one row per task in the shuffle.
    """
    n = F.count("thread_id")
    return scored.groupBy("topic_id").agg(
        (F.coalesce(F.sum("trend_score"), F.lit(0.0)) / F.sqrt(n)).alias("topic_trend_score"),
        n.alias("thread_count"),
        F.max("created_utc").alias("last_activity"),
    )


def topic_trends(threads: DataFrame, comments: DataFrame, topics: DataFrame, days: int = 14,
                 as_of: Column | None = None) -> DataFrame:
    """Trailing-window topic trends, best first."""
    end = window_end(comments, threads)
    as_of = end if as_of is None else as_of
    active = active_threads(threads, windowed_comments(comments, threads, days, end))
    trends = aggregate_trends(score_topic_threads(active, topics, as_of))
    return trends.orderBy(F.col("topic_trend_score").desc_nulls_last(), F.col("topic_id"))
