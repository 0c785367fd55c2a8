"""Trailing-window activity and the per-thread document builder.

The window end is a data-dependent scalar (``max`` over dated comments of
known threads).  One partial/final aggregate finds it, and its single value
enters the main plan as a literal, so the window predicate can reach the scan
of the comments and row-group statistics can skip old ones.

Comments come with their texts (``body``), or with keys of texts (``body_key``)
kept in a table of their own (``bodies``: body_key, body).  In the second form
comments are filtered and ranked by their keys, and only those that are used
meet their texts; the rows are those of the joined form.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import comment_priority
from ..functions.text import resolve_url, strip_ws
from ..session import broadcast_if_small, materialise
from .ranking import first_ranks_per_group, priority_order, top_comments_by_priority


def with_bodies(comments: DataFrame, bodies: DataFrame | None) -> DataFrame:
    """The comments with their texts; keyed ones are written and counted first, so that the texts stay where they are
    read while the comments are within the bound of a broadcast."""
    if bodies is None:
        return comments
    return broadcast_if_small(materialise(comments, "keyed-comments")).join(bodies, "body_key").drop("body_key")


def of_known_bodies(comments: DataFrame, bodies: DataFrame | None) -> DataFrame:
    """Keyed comments whose text exists (each once, however often the text does)."""
    return comments if bodies is None else comments.join(broadcast_if_small(bodies.select("body_key")), "body_key", "left_semi")


def known_thread_comments(comments: DataFrame, threads: DataFrame) -> DataFrame:
    """Comments whose thread exists (semi-join: duplicates in threads never multiply comments)."""
    return comments.join(threads.select("thread_id"), "thread_id", "left_semi")


def window_end(comments: DataFrame, threads: DataFrame) -> Column:
    """A1: latest comment time over dated comments of known threads (a literal; null without such comments)."""
    known = known_thread_comments(comments, threads).where(F.col("created_utc").isNotNull())
    latest = known.agg(F.max("created_utc").cast("string")).first()[0]
    return F.lit(latest).cast(comments.schema["created_utc"].dataType)


def windowed_comments(comments: DataFrame, threads: DataFrame, days: int = 14,
                      end: Column | None = None) -> DataFrame:
    """dated comments of known threads in [end - days, end] (both ends inclusive)."""
    end = window_end(comments, threads) if end is None else end
    start = end - F.make_dt_interval(F.lit(days))
    return (
        known_thread_comments(comments, threads)
        .where(F.col("created_utc").isNotNull())
        .where(F.col("created_utc").between(start, end))
    )


def active_threads(threads: DataFrame, windowed: DataFrame) -> DataFrame:
    """Threads with at least one windowed comment and a known creation time."""
    return (
        threads.join(windowed.select("thread_id"), "thread_id", "left_semi")
        .where(F.col("created_utc").isNotNull())
    )


def top_comments_text(windowed: DataFrame, as_of: Column, k: int = 5, snippet_chars: int = 250,
                      bodies: DataFrame | None = None) -> DataFrame:
    """M1 + K2 + A2: per thread, the k highest-priority comment bodies joined by ' '.

    Bodies are flattened (newline -> space) then cut to ``snippet_chars``
    *before* the comments are ranked, so only short strings are sorted and moved.
    Keyed comments (``bodies`` given) are ranked by their keys first: the rows of
    the first k ranks, ties included, are joined to the cut texts and ranked again.
    """
    body = F.translate(F.substring(F.coalesce(F.col("body"), F.lit("")), 1, snippet_chars), "\n", " ").alias("body")
    priority = comment_priority("score", "created_utc", as_of).alias("comment_priority")
    if bodies is None:
        win = windowed.select("thread_id", "comment_id", body, priority)
    else:
        keys = windowed.select("thread_id", "comment_id", "body_key", priority)
        win = with_bodies(first_ranks_per_group(keys, ["thread_id"], priority_order(), k), bodies.select("body_key", body))
    ranked = top_comments_by_priority(win, k)
    parts = ranked.select("thread_id", F.struct("rank", "body").alias("p"))
    return parts.groupBy("thread_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list("p")), lambda x: x["body"]), " ")
        .alias("top_comments_text"))


def build_docs(threads: DataFrame, comments: DataFrame, days: int = 14, k: int = 5,
               as_of: Column | None = None, url_order=("external_url", "url", "permalink"),
               end: Column | None = None, bodies: DataFrame | None = None) -> DataFrame:
    """Active-thread documents for the trailing window.

    ``threads`` must carry ``title_and_selftext``.  ``as_of`` defaults to the
    window end (deterministic, unlike a wall clock); a known window end can be passed as ``end``.
    With ``bodies`` the keys of the windowed comments and the ids of their threads are written, so
    that the texts of other threads are not moved.
    """
    comments = of_known_bodies(comments, bodies)
    end = window_end(comments, threads) if end is None else end
    as_of = end if as_of is None else as_of
    win = windowed_comments(comments, threads, days, end)
    ids = win
    if bodies is not None:
        win = materialise(win, "windowed")
        ids = broadcast_if_small(materialise(win.select("thread_id").distinct(), "active"))
    active = resolve_url(active_threads(threads, ids), list(url_order))
    agg = top_comments_text(win, as_of, k, bodies=bodies)
    docs = active.join(agg, "thread_id", "left").withColumn(
        "top_comments_text", F.coalesce(F.col("top_comments_text"), F.lit("")))
    return docs.withColumn(
        "thread_doc",
        strip_ws(F.concat(F.coalesce(F.col("title_and_selftext"), F.lit("")), F.lit(" "), F.col("top_comments_text"))),
    ).withColumn("window_end", end)
