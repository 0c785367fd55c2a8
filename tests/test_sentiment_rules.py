"""The Spark scorer and the DuckDB oracle agree on sentences that exercise every rule."""

import duckdb

from agora.functions import sentiment as se
from agora.plans.oracle import d_sentiment_cte

SENTENCES = [
    "this is not good", "good", "very good", "VERY GOOD day", "good but bad", "good!!!", "bad??", "bad????",
    "GOOD", "slightly bad", "the food was good but the service was terrible!", "I don't hate it", "no no no good",
    "absolutely wonderful, extremely helpful", "nicht gut", "kinda awful", "It is NOT bad at ALL", "", None,
    "love love love", "worst crisis ever!!!!!", "barely fair but totally broken?!",
]


def test_rules_agree_with_oracle(spark):
    rows = [(str(i), s) for i, s in enumerate(SENTENCES)]
    df = spark.createDataFrame(rows, "id string, body string")
    got = {r.id: r.c for r in df.select("id", se.sentiment_compound("body").alias("c")).collect()}
    con = duckdb.connect()
    con.execute("CREATE TABLE t (id VARCHAR, body VARCHAR)")
    con.executemany("INSERT INTO t VALUES (?, ?)", rows)
    want = dict(con.execute(f"SELECT id, compound FROM ({d_sentiment_cte('t', 'body')})").fetchall())
    assert set(got) == set(want)
    for k in got:
        assert abs(got[k] - want[k]) < 1e-9, (SENTENCES[int(k)], got[k], want[k])
    by = {SENTENCES[int(k)]: v for k, v in got.items()}
    assert by["very good"] > by["good"] > 0 > by["this is not good"]
    assert by["VERY GOOD day"] > by["very good"]
    assert by["good!!!"] > by["good"] and by["bad????"] < by["bad??"] < 0
    assert by["good but bad"] < 0 and by[""] == 0.0 and by[None] == 0.0


def test_join_path_agrees(spark):
    rows = [(str(i), s) for i, s in enumerate(SENTENCES)]
    df = spark.createDataFrame(rows, "id string, body string")
    direct = {r.id: r.c for r in df.select("id", se.sentiment_compound("body").alias("c")).collect()}
    lex = spark.createDataFrame(list(se.DEFAULT_LEXICON.items()), "token string, valence double")
    joined = {r.id: r.compound for r in se.compound_by_join(df, "id", "body", lex).collect()}
    assert all(abs(direct[k] - joined[k]) < 1e-12 for k in direct)


def test_large_lexicon_scores_like_the_map(spark):
    """Beyond the bound of the map literal the same texts get the same scores, whatever ids the rows have."""
    rows = [(1, "Not a GOOD idea but really great!"), (1, "Not a GOOD idea but really great!"), (2, None), (3, "plain"),
            (None, "good good bad??"), (4, "")]
    df = spark.createDataFrame(rows, "comment_id int, body string")
    lex = spark.createDataFrame(list(se.DEFAULT_LEXICON.items()), "token string, valence double")
    small = sorted(map(str, se.with_compound(df, "body", lex).collect()))
    assert sorted(map(str, se.with_compound(df, "body", lex, max_map=1).collect())) == small
    assert len(small) == len(rows)
