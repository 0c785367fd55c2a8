"""Topic contexts, summaries and topic cards.

Cards are built from two independent grouped aggregates over the comments of
the listed threads (sentiment counts; daily counts), joined on ``topic_id``
and nested at the very end.  The listed-thread set is bounded by
``n_topics * k`` rows, so it is broadcast to the comment scan.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import sentiment as se
from ..functions import text as tx
from ..functions.scoring import day_label
from ..params import TRENDING
from .activity import with_bodies
from .ranking import latest_threads_per_topic, top_threads_by_trend


def ts_text(c) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return F.date_format(c, "yyyy-MM-dd HH:mm:ssxxx")


def ordered_join(rank: Column, value: Column, sep: str) -> Column:
    """Aggregate: values joined by ``sep`` in ``rank`` order (bounded groups only)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank.alias("r"), value.alias("v")))),
                                    lambda x: x["v"]), sep)


def topic_context(scored_docs: DataFrame, k: int = TRENDING.threads_per_topic,
                  cap: int = TRENDING.topic_context_chars) -> DataFrame:
    """Per topic, '- title\\n  comments' of its k best threads joined by newline, capped."""
    line = F.concat(F.lit("- "), tx.snippet("title_and_selftext", 220, "after"), F.lit("\n  "),
                    tx.snippet("top_comments_text", 350, "after"))
    # cut before the ranking, so that no whole text is sorted and moved for it
    top = top_threads_by_trend(scored_docs.select("topic_id", "thread_id", "trend_score", line.alias("line")), k)
    return top.groupBy("topic_id").agg(F.substring(ordered_join(F.col("rank"), F.col("line"), "\n"), 1, cap).alias("context"))


Summariser = Callable[[pd.DataFrame], pd.DataFrame]


def summarise_topics(contexts: DataFrame, summariser: Summariser | None = None) -> DataFrame:
    """(topic_id, context) -> (topic_id, headline, summary).

    Default: the deterministic placeholder (JVM-side).  A user summariser maps
    a pandas frame (topic_id, context) to (topic_id, headline, summary) and runs
    in ``mapInPandas``; missing headlines default to 'Topic <id>' (T19).
    """
    if summariser is None:
        return contexts.select("topic_id", tx.topic_headline("context", "topic_id").alias("headline"),
                               tx.topic_summary_placeholder("topic_id").alias("summary"))

    def run(batches):
        for pdf in batches:
            yield summariser(pdf[["topic_id", "context"]])[["topic_id", "headline", "summary"]]

    out = contexts.select("topic_id", "context").mapInPandas(run, "topic_id int, headline string, summary string")
    return out.select(
        "topic_id",
        tx.strip_ws(F.coalesce("headline", F.concat(F.lit("Topic "), F.col("topic_id").cast("string")))).alias("headline"),
        tx.strip_ws(F.coalesce("summary", F.lit(""))).alias("summary"))


def scored_comments(comments: DataFrame, lexicon=None) -> DataFrame:
    return se.with_compound(comments, "body", lexicon)


def daily_counts(comments: DataFrame, key: str) -> DataFrame:
    """A5 (flat): dated comments per (key, UTC day)."""
    return (comments.where(F.col("created_utc").isNotNull())
            .groupBy(key, day_label("created_utc").alias("date")).agg(F.count(F.lit(1)).alias("count")))


def nest_timeline(daily: DataFrame, key: str) -> DataFrame:
    """A5 (nested): ascending [{date, count}] per key, days with data only."""
    return daily.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("date", "count"))).alias("comment_timeline"))


def listed_threads(scored_docs: DataFrame, top: DataFrame, k: int = TRENDING.threads_per_topic) -> DataFrame:
    """K4 for the chosen topics only."""
    return latest_threads_per_topic(scored_docs.join(top.select("topic_id"), "topic_id", "left_semi"), k)


def topic_card_parts(top: DataFrame, listed: DataFrame, comments: DataFrame | None, lexicon=None, bodies: DataFrame | None = None):
    """Flat parts of the cards: thread lists, sentiment/volume stats, daily counts (keyed comments: with ``bodies``)."""
    item = F.struct(
        F.col("thread_id"), F.col("title_and_selftext").alias("title"), F.col("thread_url").alias("url"),
        ts_text("created_utc").alias("created_utc"), F.col("score"), F.col("num_comments"))
    threads = listed.groupBy("topic_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct(F.col("rank").alias("r"), item.alias("t")))),
                    lambda x: x["t"]).alias("threads"))
    if comments is None:
        return threads, None, None
    ids = F.broadcast(listed.select("topic_id", "thread_id"))
    tcoms = scored_comments(with_bodies(comments.join(ids, "thread_id"), bodies), lexicon)
    stats = tcoms.groupBy("topic_id").agg(*se.dist_aggs(), F.max("created_utc").alias("last_updated"))
    daily = daily_counts(tcoms, "topic_id")
    return threads, stats, daily


def topic_cards(top: DataFrame, listed: DataFrame, comments: DataFrame | None, lexicon=None, bodies: DataFrame | None = None) -> DataFrame:
    """Nested cards; without comments -> zero counts, [] timeline, 0, null."""
    threads, stats, daily = topic_card_parts(top, listed, comments, lexicon, bodies)
    cards = top.join(threads, "topic_id", "left")
    zero = F.lit(0).cast("long")
    if stats is None:
        cards = cards.select("*", zero.alias("positive"), zero.alias("neutral"), zero.alias("negative"),
                             zero.alias("total_comments"), F.lit(None).cast("timestamp").alias("last_updated"),
                             F.lit(None).cast("array<struct<date:string,count:bigint>>").alias("comment_timeline"))
    else:
        cards = cards.join(stats, "topic_id", "left").join(nest_timeline(daily, "topic_id"), "topic_id", "left")
    return cards.select(
        "topic_id", "headline", "summary", "topic_trend_score",
        F.coalesce("threads", F.array().cast("array<struct<thread_id:string,title:string,url:string,"
                                              "created_utc:string,score:int,num_comments:int>>")).alias("threads"),
        F.struct(*[F.coalesce(c, zero).alias(c) for c in ("positive", "neutral", "negative")]).alias("sentiment_dist"),
        F.coalesce("comment_timeline", F.array().cast("array<struct<date:string,count:bigint>>")).alias("comment_timeline"),
        F.coalesce("total_comments", zero).alias("total_comments"),
        ts_text("last_updated").alias("last_updated"),
    )
