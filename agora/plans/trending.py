"""The trending batch (X7) and its reusable stages.

threads (with title_and_selftext) + comments + topic labels or an embedding
store -> docs (X1) -> topics (given, or clustered: J5 -> V6 -> V7) -> scored
threads (J4, F4, M2) -> trends (A3) -> top topics (K6) -> contexts and
summaries (X3, X5) -> listed threads (K4) -> cards (X6).
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import activity as act
from ..operators import cards as cd
from ..operators import ranking as rk
from ..operators import trends as tr
from ..params import TRENDING
from ..session import ensure_checkpoint_dir


@dataclass
class TrendingResult:
    docs: DataFrame
    scored: DataFrame
    trends: DataFrame
    top: DataFrame
    listed: DataFrame
    cards: DataFrame


def scored_docs(threads: DataFrame, comments: DataFrame, topics: DataFrame, days: int = TRENDING.days,
                as_of: Column | None = None, end: Column | None = None,
                bodies: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """X1 + J4 + F4 + M2: documents of the active threads with topic and trend score (keyed comments: with ``bodies``)."""
    end = act.window_end(act.of_known_bodies(comments, bodies), threads) if end is None else end
    as_of = end if as_of is None else as_of
    docs = act.build_docs(threads, comments, days, TRENDING.comments_per_thread, as_of, end=end, bodies=bodies)
    return docs, tr.score_topic_threads(docs, topics, as_of)


def top_topics_with_summaries(trends: DataFrame, scored: DataFrame, n: int = TRENDING.top_topics,
                              summariser=None) -> DataFrame:
    """K6 + X3 + X5: the n best topics with headline and summary."""
    top = rk.top_topics(trends, n)
    ctx = cd.topic_context(scored.join(top.select("topic_id"), "topic_id", "left_semi"))
    summ = cd.summarise_topics(ctx, summariser)
    return top.join(summ, "topic_id", "left").select(
        "topic_id", "topic_trend_score", "thread_count", "last_activity",
        F.coalesce("headline", F.concat(F.lit("Topic "), F.col("topic_id").cast("string"))).alias("headline"),
        F.coalesce("summary", F.lit("")).alias("summary"))


def trending_from_topics(threads: DataFrame, comments: DataFrame, topics: DataFrame,
                         days: int = TRENDING.days, as_of: Column | None = None, summariser=None,
                         lexicon=None, materialize: bool = True, end: Column | None = None,
                         bodies: DataFrame | None = None) -> TrendingResult:
    """Trends, top topics and cards from given topic labels.

    ``materialize`` writes the scored active-thread documents once with a
    reliable ``checkpoint()`` (shared checkpoint folder): trends, contexts and
    listed threads all read them, so the window, joins and comment ranking run
    once, and a lost executor recomputes nothing upstream of the checkpoint.
    """
    docs, scored = scored_docs(threads, comments, topics, days, as_of, end, bodies)
    if materialize:
        ensure_checkpoint_dir(scored.sparkSession)
        scored = scored.checkpoint()
    trends = tr.aggregate_trends(scored)
    top = top_topics_with_summaries(trends, scored, TRENDING.top_topics, summariser)
    listed = cd.listed_threads(scored, top, TRENDING.threads_per_topic)
    cards = cd.topic_cards(top, listed, comments, lexicon, bodies)
    return TrendingResult(docs, scored, trends, top, listed, cards)


def trending_topics(threads: DataFrame, comments: DataFrame, store: DataFrame, days: int = TRENDING.days,
                    as_of: Column | None = None, summariser=None, lexicon=None, bodies: DataFrame | None = None,
                    **cluster_kw) -> TrendingResult:
    """The full batch, topics found by clustering the active threads' vectors."""
    from ..operators.cluster import topic_clusters
    from ..operators.vectors import active_embeddings

    known = act.of_known_bodies(comments, bodies)
    end = act.window_end(known, threads)
    win = act.windowed_comments(known, threads, days, end)
    active = act.active_threads(threads, win)
    vecs = active_embeddings(active, store)
    topics = topic_clusters(vecs, **cluster_kw)
    return trending_from_topics(threads, comments, topics, days, as_of, summariser, lexicon, end=end, bodies=bodies)
