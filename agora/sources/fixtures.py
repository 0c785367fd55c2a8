"""Forum-shaped views over the driver tables (see FIXTURES.md).

threads  <- documents (+ pages.url), comments <- events x documents,
topics   <- embeddings.label, planted vectors <- embeddings,
big threads/comments <- orders/lineitem (benchmark scale).

Every view is a lazy DataFrame over the parquet scans, so its work grows with
the tables.  Fixed values below are the planted patterns of FIXTURES.md.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import broadcast_if_small
from .tables import table

# Fixed values (FIXTURES.md §2): thread epoch and planted null/noise patterns.
THREAD_EPOCH = "2024-01-10 00:00:00"


def _hours_after_epoch(hours: Column) -> Column:
    return F.timestamp_add("HOUR", hours, F.lit(THREAD_EPOCH).cast("timestamp"))


def threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    # the texts stay where they are read while the urls are within the bound of a broadcast
    p = broadcast_if_small(table(spark, sf_dir, "pages").select(F.col("page_id"), F.col("url").alias("external_url")))
    title = F.split_part(F.col("text"), F.lit("\n"), F.lit(1))
    out = (
        d.join(p, F.col("page_id") == F.col("doc_id"), "left")
        .select(
            # some threads are known by another id, so that comments name absent threads
            F.concat(F.when(F.col("doc_id") % 17 == 3, "moved-").otherwise(""), F.col("doc_id").cast("string")).alias("thread_id"),
            title.alias("title"),
            F.expr("substr(text, length(split_part(text, char(10), 1)) + 2)").alias("selftext"),
            F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit(" "), F.upper("source"), F.lit(" ")))
            .alias("link_flair_text"),
            F.when(F.col("doc_id") % 13 == 5, F.lit(None).cast("timestamp"))
            .otherwise(_hours_after_epoch((F.col("doc_id") * 7 % 470).cast("int")))
            .alias("created_utc"),
            F.when(F.col("doc_id") % 11 == 0, F.lit(None).cast("int"))
            .otherwise((F.col("n_chars") % 500 - 50).cast("int"))
            .alias("score"),
            (F.col("n_chars") % 37).cast("int").alias("num_comments"),
            F.col("external_url"),
        )
    )
    return out


def planted_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document, with a link, a quoted line or an emoji and odd spaces put to its text by id; and one marker-only
    row for every seventh document."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text")
    k = F.col("doc_id") % 4
    text = (F.when(k == 1, F.concat("text", F.lit("  https://ex.org/a?b="), F.col("doc_id").cast("string"), F.lit(" www.ex.org/c end")))
            .when(k == 2, F.concat(F.lit("> quoted line\n"), F.col("text"), F.lit("\n  > another")))
            .when(k == 3, F.concat("text", F.lit(" \U0001F600  ok\u00a0\t end"))).otherwise(F.col("text")))
    marks = d.where(F.col("doc_id") % 7 == 0).select((-F.col("doc_id") - 1).alias("doc_id"), F.when(F.col("doc_id") % 2 == 0, " [deleted] ").otherwise("[removed]").alias("text"))
    return d.select("doc_id", text.alias("text")).unionByName(marks)


def model_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text inside a model response, by id in one of the three shapes or as it is."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = F.col("doc_id") % 4
    part = F.array(F.struct("text"))
    shaped = (F.when(k == 1, F.to_json(F.struct("text"))).when(k == 2, F.to_json(F.struct(F.lit(1).alias("text"), F.col("text").alias("output"))))
              .when(k == 3, F.to_json(F.struct(F.array(F.struct(F.struct(part.alias("parts")).alias("content"))).alias("candidates")))).otherwise(F.col("text")))
    return d.select("doc_id", shaped.alias("response"))


def keyed_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The comments with the keys of their texts in ``bodies``; one whose text is missing there is no comment."""
    e = table(spark, sf_dir, "events")
    n_docs = table(spark, sf_dir, "documents").agg(F.count(F.lit(1))).scalar()
    return e.select(
        F.col("event_id").cast("string").alias("comment_id"),
        F.col("user_id").cast("string").alias("thread_id"),
        (F.col("event_id") % n_docs).alias("body_key"),
        F.when(F.col("event_id") % 53 == 0, F.lit(None).cast("int"))
        .otherwise(F.floor("value").cast("int") - 30)
        .alias("score"),
        F.when(F.col("event_id") % 97 == 0, F.lit(None).cast("timestamp"))
        .otherwise(F.col("ts").cast("timestamp"))
        .alias("created_utc"),
    )


def bodies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("body_key"), F.col("text").alias("body"))


def comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return keyed_comments(spark, sf_dir).join(bodies(spark, sf_dir), "body_key").select(
        "comment_id", "thread_id", "body", "score", "created_utc")


def topics(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings")
    return v.select(
        F.concat(F.when(F.col("vec_id") % 7 == 6, "moved-").otherwise(""), F.col("vec_id").cast("string")).alias("thread_id"),
        F.when(F.col("label") == 0, F.lit(-1)).otherwise(F.col("label")).cast("int").alias("topic_id"),
    )


def planted_vectors(spark: SparkSession, sf_dir: str, alpha: float = 3.0) -> DataFrame:
    """Embeddings with ``alpha`` added on the label's coordinate, unit length."""
    v = table(spark, sf_dir, "embeddings")
    shifted = F.transform(
        "embedding",
        lambda x, i: x.cast("double") + F.when(i == F.col("label"), F.lit(float(alpha))).otherwise(F.lit(0.0)),
    )
    s = v.select("vec_id", "label", shifted.alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))
    return s.select(
        F.col("vec_id").cast("string").alias("thread_id"),
        F.col("label"),
        F.transform("v", lambda x: x / norm).alias("embedding"),
    )


def store_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shipped embedding store as (thread_id, embedding ARRAY<DOUBLE>)."""
    v = table(spark, sf_dir, "embeddings")
    return v.select(
        F.col("vec_id").cast("string").alias("thread_id"),
        F.col("embedding").cast("array<double>").alias("embedding"),
    )


def big_threads(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(
        F.col("o_orderkey").cast("string").alias("thread_id"),
        F.concat_ws(" ", "o_orderstatus", "o_orderpriority").alias("title"),
        F.lit("").alias("selftext"),
        F.col("o_orderpriority").alias("link_flair_text"),
        F.col("o_orderdate").cast("timestamp").alias("created_utc"),
        F.floor(F.col("o_totalprice") / 1000).cast("int").alias("score"),
        (F.col("o_custkey") % 37).cast("int").alias("num_comments"),
        F.lit(None).cast("string").alias("external_url"),
    )


def big_comments(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                    F.round(F.col("l_extendedprice") * 100).cast("bigint")).alias("comment_id"),
        F.col("l_orderkey").cast("string").alias("thread_id"),
        F.concat_ws(" ", "l_returnflag", "l_linestatus").alias("body"),
        (F.col("l_quantity").cast("int") - 10).alias("score"),
        F.col("l_shipdate").cast("timestamp").alias("created_utc"),
    )
