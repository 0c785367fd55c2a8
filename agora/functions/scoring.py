"""Time and score column functions (Column -> Column).

All are JVM-side expressions, so they stay inside whole-stage codegen and
also run unchanged on streaming DataFrames.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MICROS_PER_HOUR = 3.6e9


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clip0(c) -> Column:
    """max(x, 0) that keeps nulls (``greatest`` would turn null into 0)."""
    c = _c(c)
    return F.when(c < 0, F.lit(0)).otherwise(c)


def parse_ts(c) -> Column:
    """String -> TIMESTAMP (session time zone UTC); unparseable -> null."""
    return F.try_to_timestamp(_c(c))


def hours_between(as_of, ts) -> Column:
    """(as_of - ts) in fractional hours; works for TIMESTAMP and TIMESTAMP_NTZ."""
    return (F.unix_micros(_c(as_of).cast("timestamp")) - F.unix_micros(_c(ts).cast("timestamp"))) / MICROS_PER_HOUR


def comment_priority(score, ts, as_of) -> Column:
    """clip0(score) / (1 + hours since the comment)."""
    return clip0(score) / (F.lit(1.0) + hours_between(as_of, ts))


def trend_score(score, num_comments, created, as_of) -> Column:
    """ln(1 + clip0(score) + clip0(num_comments)) / (1 + hours since thread creation)."""
    return F.log1p(clip0(score) + clip0(num_comments)) / (F.lit(1.0) + hours_between(as_of, created))


def day_label(ts) -> Column:
    """UTC calendar day as 'yyyy-MM-dd'."""
    return F.date_format(_c(ts), "yyyy-MM-dd")


def month_day_label(day) -> Column:
    """'yyyy-MM-dd' -> 'MM-dd'."""
    return F.substring(_c(day), 6, 5)


def relative_time(ts, as_of) -> Column:
    """'Nm ago' below an hour, 'Nh ago' below a day, else 'Nd ago' (floored)."""
    minutes = F.floor((F.unix_micros(_c(as_of).cast("timestamp")) - F.unix_micros(_c(ts).cast("timestamp"))) / F.lit(60_000_000))
    hours = F.floor(minutes / 60)
    days = F.floor(hours / 24)
    return (
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit("m ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit("h ago")))
        .otherwise(F.concat(days.cast("string"), F.lit("d ago")))
    )


def js_round2(c) -> Column:
    """JavaScript Math.round(x * 100) / 100 (halves go toward +infinity)."""
    return F.floor(_c(c) * 100 + 0.5) / 100


def similarity_pct(c) -> Column:
    """Similarity as a whole percentage, Math.round semantics."""
    return F.floor(_c(c) * 100 + 0.5).cast("long")


def sentiment_share(pos, neu, neg) -> Column:
    """Struct of percentage shares; null when the total is 0."""
    pos, neu, neg = _c(pos), _c(neu), _c(neg)
    total = pos + neu + neg
    p = F.when(total > 0, 100.0 * pos / total)
    n = F.when(total > 0, 100.0 * neu / total)
    return F.struct(p.alias("positive_pct"), n.alias("neutral_pct"), (F.lit(100.0) - p - n).alias("negative_pct"))
