"""Home-feed roll-ups over topic cards.

Cards are few (top topics), but every roll-up is still a DataFrame job over
the card table: explode, group, join, no driver loop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scoring import js_round2, month_day_label
from ..functions.text import short_label


def overall_timeline(cards: DataFrame) -> DataFrame:
    """Daily comment counts summed over topics, ascending by date."""
    pts = cards.select(F.inline("comment_timeline"))
    return pts.groupBy("date").agg(F.sum("count").alias("count")).orderBy("date")


def overall_sentiment(cards: DataFrame) -> DataFrame:
    """A8 + F5: sentiment summed across topics as (name, value) rows with value > 0."""
    s = cards.agg(*[F.coalesce(F.sum(f"sentiment_dist.{k}"), F.lit(0)).alias(k)
                    for k in ("positive", "neutral", "negative")])
    long = s.select(F.expr("stack(3, 'Positive', positive, 'Neutral', neutral, 'Negative', negative) AS (name, value)"))
    return long.where(F.col("value") > 0)


def recent_activity(cards: DataFrame, n: int = 14) -> DataFrame:
    """K7 + T14: last n points of the overall timeline with 'MM-dd' labels."""
    tl = overall_timeline(cards)
    last = tl.orderBy(F.col("date").desc()).limit(n)
    return last.select(month_day_label("date").alias("date"), "count", F.col("date").alias("day")).orderBy("day").drop("day")


def trend_bars(cards: DataFrame) -> DataFrame:
    """K9: short headline label and 2-decimal score (Math.round semantics), best first."""
    return cards.select(short_label("headline").alias("name"),
                        js_round2("topic_trend_score").alias("score")).orderBy(F.col("score").desc(), "name")


def sentiment_over_time(cards: DataFrame, n: int = 14) -> DataFrame:
    """For the last n overall-timeline points, each topic's overall pos/neu/neg
    shares weighted by its comments that day; (pos - neg) / total, 2 decimals, 0 if empty."""
    last = overall_timeline(cards).orderBy(F.col("date").desc()).limit(n).select("date")
    d = cards.select(
        F.col("sentiment_dist.positive").alias("p"), F.col("sentiment_dist.neutral").alias("u"),
        F.col("sentiment_dist.negative").alias("g"), "total_comments", F.inline("comment_timeline"))
    tot = F.col("p") + F.col("u") + F.col("g")
    contrib = d.where((F.col("total_comments") > 0) & (tot > 0)).select(
        "date", (F.col("p") / tot * F.col("count")).alias("pos"), (F.col("u") / tot * F.col("count")).alias("neu"),
        (F.col("g") / tot * F.col("count")).alias("neg"))
    per_day = contrib.groupBy("date").agg(F.sum("pos").alias("pos"), F.sum("neu").alias("neu"), F.sum("neg").alias("neg"))
    j = last.join(per_day, "date", "left")
    total = F.coalesce(F.col("pos"), F.lit(0.0)) + F.coalesce(F.col("neu"), F.lit(0.0)) + F.coalesce(F.col("neg"), F.lit(0.0))
    senti = F.when(total > 0, js_round2((F.col("pos") - F.col("neg")) / total)).otherwise(F.lit(0.0))
    return j.select(month_day_label("date").alias("date"), senti.alias("sentiment"), F.col("date").alias("day")) \
        .orderBy("day").drop("day")


def home_feed(cards: DataFrame) -> DataFrame:
    """One row {topics: [cards], overall_timeline: [{date, count}]}.

    One aggregate over the (bounded) card table: the cards are collected, and
    their timelines are merged by a fold over the date-sorted points, so no
    join of the two results is needed.
    """
    pts = F.array_sort(F.flatten(F.collect_list("comment_timeline")))
    empty = F.array().cast("array<struct<date:string,count:bigint>>")

    def merge(acc, p):
        n = F.size(acc)
        last = F.element_at(acc, -1)
        same = (n > 0) & (last["date"] == p["date"])
        summed = F.struct(p["date"].alias("date"), (last["count"] + p["count"]).alias("count"))
        return F.when(same, F.concat(F.slice(acc, 1, n - 1), F.array(summed))).otherwise(F.concat(acc, F.array(p)))

    best = F.array_sort(F.collect_list(F.struct((-F.col("topic_trend_score")).alias("_s"), F.col("topic_id").alias("_t"), F.struct(*cards.columns).alias("card"))))
    return cards.agg(F.transform(best, lambda x: x["card"]).alias("topics"), pts.alias("_pts")).select(
        "topics", F.aggregate("_pts", empty, merge).alias("overall_timeline"))
