"""Workload parameters (keyword arguments everywhere, collected here).

Fixed values that must equal the analysed application's behaviour:
window 14 days, 5 comments per thread, 3 top topics, 5 threads per topic,
min_cluster_size = max(8, int(0.02 * N)), min_samples = max(4, mcs // 2),
query top-K threads 5, comments per thread 5, near-duplicate threshold 0.92
(strictly greater drops), topic context cap 2500 chars, query context cap
3000 chars, sentiment cut-offs +0.05 / -0.05 (inclusive), minimum comment
length 3 words, reduced dimensions 10, site prefix "https://www.reddit.com".
Our own: 6 groups of a query's comments besides the rest, 5 representatives of each.
"""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Trending:
    days: int = 14
    comments_per_thread: int = 5
    top_topics: int = 3
    threads_per_topic: int = 5
    reduced_dims: int = 10
    topic_context_chars: int = 2500
    comment_snippet_chars: int = 250


@dataclass(frozen=True)
class Search:
    top_k_threads: int = 5
    top_k_comments: int = 5
    dedup_threshold: float = 0.92
    query_context_chars: int = 3000
    comment_clusters: int = 6
    rep_comments: int = 5


@dataclass(frozen=True)
class Cleaning:
    min_words: int = 3


SENTIMENT_POSITIVE = 0.05
SENTIMENT_NEGATIVE = -0.05
PERMALINK_PREFIX = "https://www.reddit.com"

TRENDING = Trending()
SEARCH = Search()
CLEANING = Cleaning()


def cluster_sizes(n: int) -> tuple[int, int]:
    """(min_cluster_size, min_samples) derived from the number of points."""
    mcs = max(8, int(0.02 * n))
    return mcs, max(4, mcs // 2)
