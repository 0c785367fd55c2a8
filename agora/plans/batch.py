"""Ingest + embed batch (X10): raw forum tables -> cleaned tables -> embedding store."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import cleaning as cl
from ..operators import embed as em
from ..sources import io


def ingest_and_embed(spark: SparkSession, threads: DataFrame, comments: DataFrame, out_dir: str,
                     image_ids: DataFrame | None = None, encoder=None, mode: str = "ignore") -> None:
    """X0 then V1: write cleaned threads/comments and one vector per thread.

    Outputs are written to (shared) ``out_dir``; ``mode='ignore'`` leaves an
    existing output in place (S3), so a re-run after a lost executor only
    redoes the missing parts.  The embedding reads the written table, which
    also cuts the lineage.
    """
    io.write_table(cl.clean_threads(threads, image_ids), f"{out_dir}/threads", mode)
    io.write_table(cl.clean_comments(comments), f"{out_dir}/comments", mode)
    written = spark.read.parquet(f"{out_dir}/threads")
    io.write_embeddings(em.embed(written, "title_and_selftext", encoder), f"{out_dir}/embeddings",
                        "hashing-tfidf" if encoder is None else getattr(encoder, "__name__", "custom"), mode)
