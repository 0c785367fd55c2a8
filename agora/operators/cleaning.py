"""Clean pipeline (X0): threads K1 -> J6 -> T8 -> T10 -> T7; comments T5 -> T7 -> F1.

Pure ``DataFrame -> DataFrame`` functions; inputs and outputs are separate
tables (write with ``sources.io``), so nothing short-circuits on existing files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..params import CLEANING
from .ranking import dedupe_threads


def with_has_image(threads: DataFrame, image_ids: DataFrame | None) -> DataFrame:
    """Existence flag against a set of image thread ids (left join on distinct ids)."""
    if image_ids is None:
        return threads.withColumn("has_image", F.lit(False))
    ids = image_ids.select(F.col("thread_id").cast("string").alias("_img")).distinct()
    return (threads.join(ids, F.col("thread_id") == F.col("_img"), "left")
            .withColumn("has_image", F.col("_img").isNotNull()).drop("_img"))


def clean_threads(threads: DataFrame, image_ids: DataFrame | None = None) -> DataFrame:
    t = with_has_image(dedupe_threads(threads), image_ids)
    if "link_flair_text" in t.columns:
        t = t.withColumn("link_flair_text", tx.flair_norm("link_flair_text"))
    else:
        t = t.withColumn("link_flair_text", F.lit("[no flair]"))
    t = t.withColumn("_pre", tx.pre_html(tx.title_and_selftext("title", "selftext")))
    return t.withColumn("title_and_selftext", tx.normalize_from_pre("_pre")).drop("_pre")


def drop_short_comments(comments: DataFrame, min_words: int = CLEANING.min_words) -> DataFrame:
    """F1 (+T9): keep comments with at least ``min_words`` words; adds ``body_len``."""
    # a filter on body_len would count all words a second time
    return comments.where(tx.has_words("body", min_words)).withColumn("body_len", tx.word_count("body"))


def clean_comments(comments: DataFrame, min_words: int = CLEANING.min_words) -> DataFrame:
    pre = comments.withColumn("_pre", tx.pre_html(tx.remove_quotes(F.coalesce(F.col("body"), F.lit("")))))
    # a generator: neither the filter nor the projection gets a copy of the chain
    kept = F.filter(F.array(tx.normalize_from_pre("_pre", with_words=True)), lambda x: x["n_words"] >= min_words)
    out = pre.withColumn("_nb", F.explode(kept)).drop("_pre")
    return out.withColumn("body", F.col("_nb.text")).withColumn("body_len", F.col("_nb.n_words")).drop("_nb")
