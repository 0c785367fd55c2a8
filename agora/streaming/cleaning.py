"""Streaming use of the column functions.

The analysed application is batch-only; its cleaning and scoring functions
are plain Column expressions, so they run unchanged on a streaming
DataFrame.  ``cleaned_comment_stream`` reads new comment files as they land
and emits cleaned, scored comments; the sink (e.g. ``foreachBatch`` into the
comment table) is the caller's choice.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sentiment as se
from ..functions import text as tx
from ..params import CLEANING
from ..schemas import COMMENTS


def cleaned_comments(comments: DataFrame, min_words: int = CLEANING.min_words, lexicon=None) -> DataFrame:
    """Quote removal, the batch's normalisation, length filter, compound score."""
    body = tx.normalize_text(tx.remove_quotes(F.coalesce(F.col("body"), F.lit(""))))
    out = comments.withColumn("body", body).withColumn("body_len", tx.word_count("body"))
    return out.where(F.col("body_len") >= min_words).withColumn("compound", se.sentiment_compound("body", lexicon))


def cleaned_comment_stream(spark: SparkSession, path: str, max_files_per_trigger: int = 100) -> DataFrame:
    src = spark.readStream.schema(COMMENTS).option("maxFilesPerTrigger", max_files_per_trigger).parquet(path)
    return cleaned_comments(src)
