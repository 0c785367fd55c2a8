"""Plan-shape guards for scale: no pair-producing joins, top-k cut before the shuffle,
scans pruned to the columns used with filters pushed into them."""

import pytest

import __spark_entry__ as E

from .conftest import SF001

LAZY = ["topic_trends", "build_docs", "top_comments_by_priority", "top_comments_by_score", "latest_threads_per_topic",
        "top_threads_by_trend", "sentiment_dist", "daily_timeline", "clean_comments", "clean_threads",
        "dedupe_threads", "active_window", "active_threads", "comment_priority", "topic_context", "extract_json",
        "home_feed", "topic_cards", "thread_cards", "search"]


def physical(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", LAZY)
def test_no_pair_producing_joins(spark, name):
    plan = physical(E.queries()[name](spark, SF001))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_top_k_is_cut_before_the_shuffle(spark):
    df = E.queries()["top_comments_by_score"](spark, SF001)
    df.collect()
    plan = physical(df)
    assert "WindowGroupLimit" in plan and "Partial" in plan


def test_scans_are_pruned_and_filtered(spark):
    df = E.queries()["active_window"](spark, SF001)
    df.collect()
    plan = physical(df)
    events_scans = [ln for ln in plan.split("\n") if "FileScan parquet" in ln and "event_id" in ln]
    assert events_scans
    for ln in events_scans:
        assert "props" not in ln and "event_type" not in ln  # only used columns are read
    assert any("DataFilters" in ln and "doc_id" in ln for ln in plan.split("\n"))
