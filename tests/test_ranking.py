import random

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from agora.operators import ranking as rk


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abc"), st.one_of(st.none(), st.integers(-3, 3))), min_size=1, max_size=30))
def test_top_k_equals_sorted_prefix(spark, rows):
    data = [(g, f"c{i:03d}", s) for i, (g, s) in enumerate(rows)]
    df = spark.createDataFrame(data, "thread_id string, comment_id string, score int")
    got = sorted((r.thread_id, r.comment_id, r.rank) for r in rk.top_comments_by_score(df, 2).collect())
    want = []
    for g in sorted({d[0] for d in data}):
        grp = [d for d in data if d[0] == g]
        grp.sort(key=lambda d: (d[2] is None, -(d[2] or 0), d[1]))
        want += [(g, d[1], i + 1) for i, d in enumerate(grp[:2])]
    assert got == sorted(want)


def test_dedupe_keeps_highest_score(spark):
    df = spark.createDataFrame([("t1", 5, None, None, "a", ""), ("t1", 7, None, None, "b", ""),
                                ("t2", None, None, None, "c", ""), ("t2", 1, None, None, "d", "")],
                               "thread_id string, score int, created_utc timestamp, external_url string, title string, selftext string")
    got = {r.thread_id: r.title for r in rk.dedupe_threads(df).collect()}
    assert got == {"t1": "b", "t2": "d"}


def test_repartitioning_does_not_change_top_k(spark):
    random.seed(1)
    data = [(f"t{random.randint(0, 5)}", f"c{i}", random.randint(-5, 5)) for i in range(200)]
    df = spark.createDataFrame(data, "thread_id string, comment_id string, score int")
    a = sorted(rk.top_comments_by_score(df, 3).collect())
    b = sorted(rk.top_comments_by_score(df.repartition(7, F.col("comment_id")), 3).collect())
    assert a == b


def test_planted_duplicates_cover_renamed_threads(spark, monkeypatch):
    from agora.plans import catalog
    from tests.conftest import SF001
    whole = catalog.QUERIES["dedupe_threads"](spark, SF001).collect()
    monkeypatch.setattr(catalog.rk, "dedupe_threads", lambda t: t)
    planted = {}
    for r in catalog.QUERIES["dedupe_threads"](spark, SF001).collect():
        planted.setdefault(r.thread_id, []).append(r.score)
    assert any(k.startswith("moved-") and len(v) == 2 for k, v in planted.items())
    assert all(len(v) == 1 + (int(k.removeprefix("moved-")) % 5 == 0) for k, v in planted.items())
    best = {k: max((x for x in v if x is not None), default=None) for k, v in planted.items()}
    assert len(whole) == len(best) and {r.thread_id: r.score for r in whole} == best
