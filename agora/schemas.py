"""Explicit schemas of the forum data model."""

from pyspark.sql import types as T

THREADS = T.StructType([
    T.StructField("thread_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("selftext", T.StringType()),
    T.StructField("link_flair_text", T.StringType()),
    T.StructField("created_utc", T.TimestampType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("num_comments", T.IntegerType()),
    T.StructField("external_url", T.StringType()),
])

COMMENTS = T.StructType([
    T.StructField("comment_id", T.StringType()),
    T.StructField("thread_id", T.StringType()),
    T.StructField("body", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("created_utc", T.TimestampType()),
])

EMBEDDINGS = T.StructType([
    T.StructField("thread_id", T.StringType()),
    T.StructField("embedding", T.ArrayType(T.DoubleType())),
])

TOPICS = T.StructType([
    T.StructField("thread_id", T.StringType()),
    T.StructField("topic_id", T.IntegerType()),
])

LEXICON = T.StructType([
    T.StructField("token", T.StringType()),
    T.StructField("valence", T.DoubleType()),
])

SENTIMENT_DIST = T.StructType([
    T.StructField("positive", T.LongType()),
    T.StructField("neutral", T.LongType()),
    T.StructField("negative", T.LongType()),
])

TIMELINE = T.ArrayType(T.StructType([
    T.StructField("date", T.StringType()),
    T.StructField("count", T.LongType()),
]))

CARD_THREAD = T.StructType([
    T.StructField("thread_id", T.StringType()),
    T.StructField("title", T.StringType()),
    T.StructField("url", T.StringType()),
    T.StructField("created_utc", T.StringType()),
    T.StructField("score", T.IntegerType()),
    T.StructField("num_comments", T.IntegerType()),
])

TOPIC_CARD = T.StructType([
    T.StructField("topic_id", T.IntegerType()),
    T.StructField("headline", T.StringType()),
    T.StructField("summary", T.StringType()),
    T.StructField("topic_trend_score", T.DoubleType()),
    T.StructField("threads", T.ArrayType(CARD_THREAD)),
    T.StructField("sentiment_dist", SENTIMENT_DIST),
    T.StructField("comment_timeline", TIMELINE),
    T.StructField("total_comments", T.LongType()),
    T.StructField("last_updated", T.StringType()),
])
