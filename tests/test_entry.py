import datetime as dt

import duckdb
import pandas as pd
import pytest

import __spark_entry__ as E
from agora.sources.tables import TABLES

from .conftest import SF001, SF01


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["topic_id", "topic_trend_score", "thread_count", "last_activity"]
    assert df.count() > 0


def test_oracle_keys_subset_of_queries():
    assert set(E.oracle_sql()) <= set(E.queries())


def test_topic_trends_known_rows(spark):
    rows = E.queries()["topic_trends"](spark, SF01).orderBy("topic_trend_score", ascending=False).take(3)
    got = [(r.topic_id, round(r.topic_trend_score, 6), r.thread_count, r.last_activity) for r in rows]
    assert got == [(3, 0.136675, 15, dt.datetime(2024, 1, 28, 23)), (7, 0.101275, 11, dt.datetime(2024, 1, 29, 12)),
                   (4, 0.070853, 6, dt.datetime(2024, 1, 26, 8))]


@pytest.mark.parametrize("name", ["topic_trends", "build_docs", "clean_comments", "cosine_topk", "greedy_dedup",
                                  "topic_cards", "thread_cards", "sentiment_dist", "top_comments_by_score"])
def test_oracle_agrees_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF001}/{t}.parquet')")
    d = con.execute(E.oracle_sql()[name]).fetchdf()
    s = E.queries()[name](spark, SF001).toPandas()
    assert sorted(s.columns) == sorted(d.columns)
    cols = sorted(s.columns)

    def val(v):
        if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
            return None
        if isinstance(v, float):
            return round(v, 5)
        if hasattr(v, "tolist") and not isinstance(v, str):
            return val(v.tolist())
        if isinstance(v, (list, tuple)):
            return tuple(val(x) for x in v)
        if isinstance(v, pd.Timestamp):
            return v.to_pydatetime().replace(tzinfo=None)
        return v

    def norm(df):
        return sorted((tuple(val(v) for v in r) for r in df[cols].itertuples(index=False)), key=repr)

    assert norm(s) == norm(d)
