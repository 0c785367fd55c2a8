import json
import os
import tempfile

from agora.operators import prompts as pr
from agora.sources import io


def test_community_and_article_prompts(spark):
    q = spark.createDataFrame([("q1", "housing costs"), ("q2", "transit")], "query_id string, query_text string")
    clusters = spark.createDataFrame(
        [("q1", 1, 2, [("c9", "rent is up"), ("c3", "prices")]), ("q1", 0, 1, [("c1", "same")])],
        "query_id string, cluster_id int, size int, rep_comments array<struct<comment_id:string,text:string>>")
    rows = {r.query_id: r.prompt for r in pr.community_prompts(q, clusters).collect()}
    payload = json.loads(rows["q1"][len(pr.COMMUNITY_INSTRUCTIONS):])
    assert payload["query"] == "housing costs"
    assert [c["cluster_id"] for c in payload["comment_clusters"]] == [0, 1]
    assert payload["comment_clusters"][1]["rep_comments"][0] == {"comment_id": "c9", "text": "rent is up"}
    assert json.loads(rows["q2"][len(pr.COMMUNITY_INSTRUCTIONS):]) == {"query": "transit", "comment_clusters": []}
    threads = spark.createDataFrame([("q1", "t1", "Title", "http://x")], "query_id string, thread_id string, title string, url string")
    arts = spark.createDataFrame([("q1", "t1", "http://x", "text")], "query_id string, thread_id string, url string, text string")
    a = {r.query_id: r.prompt for r in pr.article_prompts(q, threads, arts).collect()}
    p = json.loads(a["q1"][len(pr.ARTICLES_INSTRUCTIONS):])
    assert p["threads"][0]["thread_id"] == "t1" and p["articles"][0]["text"] == "text"


def test_sinks_roundtrip_and_ignore(spark):
    d = tempfile.mkdtemp(prefix="agora-sink-", dir="/tmp")
    df = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "thread_id string, embedding array<double>")
    io.write_embeddings(df, os.path.join(d, "emb"), "test-model")
    io.write_embeddings(df.limit(1), os.path.join(d, "emb"), "test-model")  # ignored: output exists
    back = io.read_embeddings(spark, os.path.join(d, "emb"))
    assert sorted((r.thread_id, list(r.embedding)) for r in back.collect()) == [("a", [1.0, 0.0]), ("b", [0.0, 1.0])]
    io.write_table(df.select("thread_id"), os.path.join(d, "t"))
    assert spark.read.parquet(os.path.join(d, "t")).count() == 2


def test_cards_json_roundtrip(spark):
    from agora.schemas import TOPIC_CARD
    d = tempfile.mkdtemp(prefix="agora-cards-", dir="/tmp")
    row = (1, "H", "S", 0.5, [("t", "title", "u", "2024-01-01 00:00:00+00:00", 3, 4)], (1, 2, 0),
           [("2024-01-01", 3)], 3, "2024-01-01 00:00:00+00:00")
    cards = spark.createDataFrame([row], TOPIC_CARD)
    io.write_cards(cards, os.path.join(d, "cards"))
    back = io.read_cards(spark, os.path.join(d, "cards")).collect()
    assert back[0].topic_id == 1 and back[0].sentiment_dist.neutral == 2 and back[0].comment_timeline[0]["count"] == 3
