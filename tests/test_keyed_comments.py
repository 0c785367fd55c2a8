"""Comments with keys of texts (``bodies``) give the rows of comments joined to their texts, and move fewer texts."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from agora.operators import activity as act
from agora.operators import cards as cd
from agora.operators import search as sr

from .conftest import SF001
from .test_plans import physical

THREADS = "thread_id string, title_and_selftext string, created_utc timestamp, score int, num_comments int, external_url string"
COMMENTS = "comment_id string, thread_id string, body_key long, score int, created_utc timestamp"


@pytest.fixture(scope="module")
def rows(spark):
    day = lambda d: datetime(2024, 1, d)
    threads = spark.createDataFrame(
        [("a", "Title a", day(2), 3, 1, "u"), ("b", "Title b", day(3), None, 2, None), ("c", "No comment", day(3), 1, 1, "x"),
         ("d", None, None, 1, 1, "y"), (None, "no id", day(1), 1, 1, "z"), ("a", "Title a again", day(4), 9, 9, "w")], THREADS)
    comments = [(f"c{i:02d}", "ab"[i % 2], i % 6, i % 4 if i % 5 else None, day(10 + i % 5)) for i in range(30)]
    comments += [("c01", "b", 1, 9, day(14))] * 3  # rows that repeat, within the first five
    comments += [(None, "a", 2, 9, day(14)), (None, "a", 3, 8, day(14)), ("e1", "a", 99, 9, day(20)), ("e2", "b", None, 9, day(19)),
                 ("e3", "gone", 1, 9, day(18)), ("e4", None, 1, 9, day(18)), ("e5", "a", 0, 9, None), ("e6", "d", 1, 1, day(14))]
    bodies = [(i, f"good text {i}\n" + "x" * 300) for i in range(4)] + [(4, None), (5, "bad"), (1, "good text 1\n" + "x" * 300), (None, "no key")]
    keyed = spark.createDataFrame(comments, COMMENTS)
    bodies = spark.createDataFrame(bodies, "body_key long, body string")
    return threads, keyed, bodies, keyed.join(bodies, "body_key").drop("body_key")


def same(one, two):
    key = lambda r: str(r)
    one, two = one.select(*two.columns).collect(), two.collect()
    assert two and sorted(one, key=key) == sorted(two, key=key)


@pytest.mark.parametrize("bound", [None, 0])
def test_keyed_comments_give_the_rows_of_joined_ones(rows, monkeypatch, bound):
    if bound is not None:  # beyond the bound of a broadcast
        monkeypatch.setattr("agora.session.MAX_BROADCAST_ROWS", bound)
    threads, keyed, bodies, joined = rows
    same(act.build_docs(threads, keyed, bodies=bodies), act.build_docs(threads, joined))
    matched = threads.where("thread_id IN ('a', 'b')").select(F.lit("q").alias("query_id"), "thread_id", F.lit(0.5).alias("score")).distinct()
    queries = matched.select("query_id", F.lit("text").alias("query_text")).distinct()
    for f in (lambda c, **kw: sr.query_context(queries, matched, threads, c, **kw), lambda c, **kw: sr.thread_cards(matched, threads, c, **kw)):
        same(f(keyed, bodies=bodies), f(joined))
    listed = matched.select(F.lit(1).alias("topic_id"), "thread_id").join(threads.drop("score"), "thread_id").select(
        "*", F.lit("u").alias("thread_url"), F.lit(1).alias("rank"), F.lit(1).alias("score"))
    top = listed.select("topic_id", F.lit("h").alias("headline"), F.lit("s").alias("summary"), F.lit(1.0).alias("topic_trend_score")).distinct()
    same(cd.topic_cards(top, listed, keyed, bodies=bodies).drop("threads"), cd.topic_cards(top, listed, joined).drop("threads"))


@pytest.mark.parametrize("name", ["topic_context", "topic_cards", "home_feed", "prompt_payloads", "trending_topics"])
def test_whole_texts_are_not_dealt_by_their_keys(spark, name):
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = physical(E.queries()[name](spark, SF001))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
    assert not [ln for ln in plan.split("\n") if "hashpartitioning(doc_id" in ln or "hashpartitioning(body_key" in ln]
