"""Connected components of an edge table by minimum-label propagation with pointer jumping, as joins.

No join is dealt by a hot key: a label that a third of all vertices share, or a vertex that a third of all edges meet,
is one of at most ``HOT`` keys with over 1 / ``HOT`` of the rows, and the rows of these keys are matched by broadcast where
they lie. Only (key, value) pairs of the others travel to their rows by a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import cut

HOT, LEAST = 1000, 100


def look_up(rows: DataFrame, table: DataFrame, key: str, total: int | None = None) -> DataFrame:
    """The inner join of ``rows`` (written before: read twice) and ``table`` (one row a key) on ``key``."""
    total = rows.count() if total is None else total
    found = rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(LEAST, total // HOT)).select(key).collect()  # under HOT keys
    if not found:
        return rows.join(table, key)
    hot = F.broadcast(rows.sparkSession.createDataFrame(found, rows.select(key).schema))
    out = rows.join(F.broadcast(table.join(hot, key)), key)
    return out.unionByName(rows.join(hot, key, "left_anti").join(table, key))


def components(edges: DataFrame, name: str = "cc") -> DataFrame:
    """(v, label): for each vertex of ``edges`` (a, b) the least vertex that it reaches. Each round is written to the
    shared folder, so a lost executor repeats one round at most. Isolated vertices are not in the result."""
    both = cut(edges.select("a", "b").union(edges.select("b", "a")).filter("a <> b").distinct(), f"{name}-edges")
    labels = cut(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), f"{name}-0")
    n_edges, n_labels = both.count(), labels.count()
    n = 0
    while n_labels:
        n += 1
        near = look_up(both, labels.select(F.col("v").alias("b"), "label"), "b", n_edges)
        near = near.select(F.col("a").alias("v"), "label", F.lit(None).cast(labels.schema["label"].dataType).alias("was"))
        jump = look_up(labels, labels.select(F.col("v").alias("label"), F.col("label").alias("up")), "label", n_labels)
        jump = jump.select("v", F.least("label", "up").alias("label"), F.col("label").alias("was"))
        step = cut(near.unionByName(jump).groupBy("v").agg(F.min("label").alias("label"), F.max("was").alias("was")), f"{name}-{n}")
        labels = step.select("v", "label")
        if step.filter("label <> was").isEmpty():
            break
    return labels
