import datetime as dt
import math

from pyspark.sql import functions as F

from agora.functions import scoring as sc
from agora.functions import sentiment as se
from agora.operators import activity as act
from agora.operators import trends as tr


def test_trend_score_nulls_and_value(spark):
    df = spark.createDataFrame([(None, 3, 1.0), (-5, 3, 1.0)], "score int, nc int, h double")
    df = df.select(sc.trend_score("score", "nc", F.expr("timestamp'2024-01-01 00:00:00'"),
                                  F.expr("timestamp'2024-01-01 01:00:00'")).alias("t"))
    got = [r["t"] for r in df.collect()]
    assert got[0] is None
    assert abs(got[1] - math.log(4) / 2) < 1e-12


def test_clip0_keeps_null(spark):
    got = [r[0] for r in spark.createDataFrame([(None,), (-2,), (3,)], "x int").select(sc.clip0("x")).collect()]
    assert got == [None, 0, 3]


def test_relative_time(spark):
    df = spark.createDataFrame([("2024-01-01 11:30:00",), ("2024-01-01 02:00:00",), ("2023-12-29 12:00:00",)], "t string")
    got = [r[0] for r in df.select(sc.relative_time(F.col("t").cast("timestamp"),
                                                    F.expr("timestamp'2024-01-01 12:00:00'"))).collect()]
    assert got == ["30m ago", "10h ago", "3d ago"]


def test_active_window_edges_inclusive(spark):
    end = dt.datetime(2024, 1, 30, 12, 0, 0)
    rows = [("c0", "t", end), ("c1", "t", end - dt.timedelta(days=14)),
            ("c2", "t", end - dt.timedelta(days=14, microseconds=1)), ("c3", "t", None), ("c4", "zz", end)]
    comments = spark.createDataFrame(rows, "comment_id string, thread_id string, created_utc timestamp")
    threads = spark.createDataFrame([("t",)], "thread_id string")
    got = sorted(r[0] for r in act.windowed_comments(comments, threads).select("comment_id").collect())
    assert got == ["c0", "c1"]


def test_topic_with_all_null_scores_counts(spark):
    scored = spark.createDataFrame([(1, "a", None, dt.datetime(2024, 1, 1)), (1, "b", None, dt.datetime(2024, 1, 2))],
                                   "topic_id int, thread_id string, trend_score double, created_utc timestamp")
    r = tr.aggregate_trends(scored).first()
    assert r["topic_trend_score"] == 0.0 and r["thread_count"] == 2


def test_sentiment_bucket_boundaries(spark):
    df = spark.createDataFrame([(0.05,), (-0.05,), (0.0499,)], "c double")
    assert [r[0] for r in df.select(se.sentiment_bucket("c")).collect()] == ["positive", "negative", "neutral"]


def test_sentiment_negation_and_join_path_agree(spark):
    texts = [("a", "this is not good"), ("b", "good"), ("c", "never ever really bad"), ("d", None), ("e", "nothing")]
    df = spark.createDataFrame(texts, "id string, body string")
    direct = {r["id"]: r["c"] for r in df.select("id", se.sentiment_compound("body").alias("c")).collect()}
    lex = spark.createDataFrame(list(se.DEFAULT_LEXICON.items()), "token string, valence double")
    joined = {r["id"]: r["compound"] for r in se.compound_by_join(df, "id", "body", lex).collect()}
    for k in direct:
        assert abs(direct[k] - joined[k]) < 1e-12
    assert direct["a"] < 0 < direct["b"] and direct["c"] > 0 and direct["d"] == 0.0
    s = 1.9
    assert abs(direct["b"] - s / math.sqrt(s * s + 15)) < 1e-12
