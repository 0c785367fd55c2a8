"""Long texts: what is counted, scored and moved."""

from pyspark.sql import functions as F

from agora.functions import sentiment as se
from agora.functions import text as tx
from agora.operators import activity as act
from agora.operators import cards as cd
from agora.operators import cleaning as cl

ODD = ["", "   ", None, "a", "a b", " a  b\x1cc ", "a　b c\x85d", "x​y z", "one two three", "İlike it", "I liKe it", "'like this", "like", "LIKE!", "2like", "élike so", "it's good thing", "ΑΣ. good"]


def test_word_counts_agree(spark):
    d = spark.createDataFrame([(i, t) for i, t in enumerate(ODD)], "comment_id int, body string")
    for n in (0, 1, 2, 3):
        got = {r.comment_id: r.body_len for r in cl.drop_short_comments(d, n).collect()}
        assert got == {i: len((t or "").split()) for i, t in enumerate(ODD) if len((t or "").split()) >= n}
    rows = d.select(tx.normalize_from_pre(tx.pre_html("body"), html=False, with_words=True).alias("x")).select("x.*").collect()
    assert all(r.n_words == len(r.text.split()) for r in rows)


def test_unscored_texts_are_passed_by(spark):
    """The test before the scoring changes no score, and comes before the tokens are made."""
    d = spark.createDataFrame([(t,) for t in ODD], "body string")
    plain = {"zzzς": 1.0} | se.DEFAULT_LEXICON  # a word beyond a-z: no test before
    for r in se.with_compound(d, "body").withColumn("want", se.sentiment_compound("body", plain)).collect():
        assert r.compound == r.want
    plan = se.with_compound(d, "body")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index(se.PLAIN_SPLIT) < plan.index(se.TOKEN_SPLIT)


def test_texts_are_cut_before_they_are_ranked(spark):
    d = spark.createDataFrame([("t", f"c{i}", "x\n" * 5000, i, None) for i in range(3)], "thread_id string, comment_id string, body string, score int, created_utc timestamp")
    out = act.top_comments_text(d, F.lit(None).cast("timestamp"), 2)
    assert out.first().top_comments_text == " ".join(["x " * 125] * 2)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Window [") < plan.index("substring")  # below the window
    s = spark.createDataFrame([(1, "t", 0.5, "title\n" * 100, "text " * 100)], "topic_id int, thread_id string, trend_score double, title_and_selftext string, top_comments_text string")
    plan = cd.topic_context(s)._jdf.queryExecution().optimizedPlan().toString()
    assert "top_comments_text" not in plan[:plan.index("Window [")]
