"""A thread holding a third of all comments: results stay whole and exact, and the
hot group is cut map-side (partial WindowGroupLimit / partial aggregation)."""

import datetime as dt
import random

from pyspark.sql import functions as F

from agora.operators import cards as cd
from agora.operators import ranking as rk


def skewed(spark, n=3000):
    random.seed(7)
    rows = []
    for i in range(n):
        tid = "hot" if i % 3 == 0 else f"t{random.randint(0, 199)}"
        ts = dt.datetime(2024, 1, 1) + dt.timedelta(hours=random.randint(0, 24 * 20))
        rows.append((f"c{i:05d}", tid, f"body {i}", random.choice([None] + list(range(-5, 50))), ts))
    return spark.createDataFrame(rows, "comment_id string, thread_id string, body string, score int, created_utc timestamp") \
        .repartition(8), rows


def test_hot_thread_top_k_exact(spark):
    df, rows = skewed(spark)
    got = rk.top_comments_by_score(df, 5).where(F.col("thread_id") == "hot").orderBy("rank").collect()
    hot = [r for r in rows if r[1] == "hot"]
    hot.sort(key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
    assert [r.comment_id for r in got] == [r[0] for r in hot[:5]]
    plan = rk.top_comments_by_score(df, 5)._jdf.queryExecution().executedPlan().toString()
    assert "Partial" in plan


def test_hot_thread_timeline_whole(spark):
    df, rows = skewed(spark)
    daily = cd.daily_counts(df, "thread_id").where(F.col("thread_id") == "hot")
    total = daily.agg(F.sum("count")).first()[0]
    assert total == sum(1 for r in rows if r[1] == "hot")
    plan = daily._jdf.queryExecution().executedPlan().toString()
    assert "partial_count" in plan
