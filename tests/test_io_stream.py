import os
import tempfile

from agora.sources import io
from agora.streaming.cleaning import cleaned_comments


def test_image_thread_ids(spark):
    d = tempfile.mkdtemp(prefix="agora-img-", dir="/tmp")
    for name in ["abc!!1.jpg", "abc!!2.jpg", "x9!!a.png", "noimage.txt"]:
        with open(os.path.join(d, name), "wb") as f:
            f.write(b"\x00")
    got = sorted(r.thread_id for r in io.image_thread_ids(spark, d).collect())
    assert got == ["abc", "x9"]


def test_read_cards_missing_is_empty(spark):
    assert io.read_cards(spark, "/tmp/agora-does-not-exist-xyz").count() == 0


def test_forum_csv_multiline(spark):
    d = tempfile.mkdtemp(prefix="agora-csv-", dir="/tmp")
    p = os.path.join(d, "t.csv")
    with open(p, "w") as f:
        f.write('thread_id,title\n1,"line one\nline two"\n2,"say ""hi"""\n')
    rows = {r.thread_id: r.title for r in io.read_forum_csv(spark, p).collect()}
    assert rows == {"1": "line one\nline two", "2": 'say "hi"'}


def test_streaming_cleaning_matches_batch(spark):
    d = tempfile.mkdtemp(prefix="agora-stream-", dir="/tmp")
    src = os.path.join(d, "in")
    rows = [("c1", "t", "> quoted\nthis is good stuff", 3, None), ("c2", "t", "too short", 1, None)]
    df = spark.createDataFrame(rows, "comment_id string, thread_id string, body string, score int, created_utc timestamp")
    df.write.parquet(src)
    from agora.streaming.cleaning import cleaned_comment_stream
    q = cleaned_comment_stream(spark, src).writeStream.format("memory").queryName("agora_clean") \
        .option("checkpointLocation", os.path.join(d, "ck")).start()
    q.processAllAvailable()
    q.stop()
    got = sorted((r.comment_id, r.body) for r in spark.sql("SELECT * FROM agora_clean").collect())
    want = sorted((r.comment_id, r.body) for r in cleaned_comments(df).collect())
    assert got == want == [("c1", "this is good stuff")]


def test_ingest_and_embed_writes_tables(spark):
    from agora.plans.batch import ingest_and_embed
    from agora.sources import fixtures as fx
    out = tempfile.mkdtemp(prefix="agora-batch-", dir="/tmp")
    t = fx.threads(spark, "/root/testdata/sf0.001")
    c = fx.comments(spark, "/root/testdata/sf0.001")
    ingest_and_embed(spark, t, c, out)
    v = io.read_embeddings(spark, f"{out}/embeddings")
    assert v.count() == t.count()
    assert spark.read.parquet(f"{out}/comments").where("body_len < 3").count() == 0
