"""One minimum spanning tree by Boruvka rounds as joins, and the condensed cluster tree from its true weights.

The condensed tree is that of Campello, Moulavi and Sander (2013): edges join components in order of weight; a component
of at least ``least`` points is a cluster, two clusters that meet become children of a new one, and smaller components
that meet a cluster are points that fall out of it there.  The edges are dealt to ranges of at most ``CHUNK``; a range
is one task over the components that its edges touch, and its outcome is joined to the points before the next range.
Clusters number at most 2 N / least, so the choice by excess of mass runs on the driver.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

CHUNK = 1_000_000


def roots(best: DataFrame) -> DataFrame:
    """(c, root) of components that each point to another one (``up``): two that point to each other meet in the smaller."""
    back = best.select(F.col("c").alias("up"), F.col("up").alias("back"))
    links = best.join(back, "up", "left").select("c", F.when((F.col("back") == F.col("c")) & (F.col("c") < F.col("up")), F.col("c")).otherwise(F.col("up")).alias("root"))
    links = materialise(links, "tree-links")
    while True:
        ahead = links.select(F.col("c").alias("root"), F.col("root").alias("next"))
        step = materialise(links.join(ahead, "root").select("c", F.col("next").alias("root"), (F.col("next") != F.col("root")).alias("moved")), "tree-links")
        links = step.select("c", "root")
        if step.filter("moved").isEmpty():
            return links


def spanning_tree(edges: DataFrame) -> DataFrame:
    """(src, dst, w): the minimum spanning forest of ``edges``, ties by src and dst; every round halves the components
    at least.  Edges may come with ``sure`` (known to be of the tree) and, for the others, the trees a and b that they join."""
    if "sure" in edges.columns:
        taken = [edges.filter("sure").select("src", "dst", "w")]
        edges = edges.filter(~F.col("sure"))
    else:
        taken, edges = [], edges.select("src", "dst", "w", F.col("src").alias("a"), F.col("dst").alias("b"))
    left = materialise(edges.select("src", "dst", "w", "a", "b").filter("a <> b"), "tree-edges")
    while not left.isEmpty():
        out = left.select(F.col("a").alias("c"), F.col("b").alias("up"), "w", "src", "dst").unionByName(left.select(F.col("b").alias("c"), F.col("a").alias("up"), "w", "src", "dst"))
        best = materialise(out.groupBy("c").agg(F.min(F.struct("w", "src", "dst", "up")).alias("e")).select("c", "e.*"), "tree-best")
        taken.append(best.select("src", "dst", "w").distinct())
        ends = roots(best.select("c", "up"))
        ra, rb = (ends.select(F.col("c").alias(x), F.col("root").alias(f"r{x}")) for x in "ab")
        left = materialise(left.join(ra, "a").join(rb, "b").filter("ra <> rb").select("src", "dst", "w", F.col("ra").alias("a"), F.col("rb").alias("b")), "tree-edges")
    tree = taken[0] if taken else edges.select("src", "dst", "w").limit(0)
    for t in taken[1:]:
        tree = tree.unionByName(t)
    return materialise(tree, "tree")


def _join_range(least: int, first_node: int):
    """Edges (w, src, dst, a, b and of both components size and node) in order of weight: what becomes of the components
    they touch (kind 0) and what happens to clusters (kind 1: born of points, 2: points fall out, 3: two meet)."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["w", "src", "dst"], kind="stable")
        up: dict = {}
        size: dict = {}
        node: dict = {}
        small: dict = {}
        home: dict = {}
        for x in "ab":
            for c, n, k in zip(pdf[x], pdf[f"n_{x}"], pdf[f"node_{x}"]):
                if c not in up:
                    up[c], size[c], node[c], small[c] = c, int(n), int(k), [c]

        def top(c):
            while up[c] != c:
                up[c] = c = up[up[c]]
            return c

        events, fresh = [], first_node
        for w, a, b in zip(pdf["w"], pdf["a"], pdf["b"]):
            a, b = top(a), top(b)
            lam = 1.0 / max(w, 1e-12)
            if size[a] < size[b]:
                a, b = b, a
            total, na, nb = size[a] + size[b], node[a], node[b]
            if na >= 0 and nb >= 0:
                events.append((3, fresh, na, nb, total, lam))
                node[a] = fresh
                fresh += 1
            elif na >= 0 or nb >= 0:
                big, few = (a, b) if na >= 0 else (b, a)
                events.append((2, node[big], -1, -1, size[few], lam))
                home.update(dict.fromkeys(small.pop(few), node[big]))
                node[a] = node[big]
            else:
                small[a] += small.pop(b)
                if total >= least:
                    events.append((1, fresh, -1, -1, total, lam))
                    home.update(dict.fromkeys(small.pop(a), fresh))
                    node[a] = fresh
                    fresh += 1
            up[b], size[a] = a, total
        rows = [(0, c, top(c), size[top(c)], node[top(c)], home.get(c, -1), -1, 0.0) for c in up]
        told = pd.DataFrame(events, columns=["kind", "id", "one", "two", "n", "lam"]) if events else pd.DataFrame({k: [] for k in ("kind", "id", "one", "two", "n", "lam")})
        mass = told.assign(mass=told["n"] * told["lam"]).groupby(["kind", "id", "one", "two"], as_index=False).agg(n=("n", "sum"), mass=("mass", "sum"), lam=("lam", "max"))
        rows += [(int(e.kind), "", "", int(e.n), int(e.id), int(e.one), int(e.two), float(e.mass if e.kind != 3 else e.lam)) for e in mass.itertuples()]
        return pd.DataFrame(rows, columns=["kind", "c", "root", "n", "node", "one", "two", "value"])
    return run


def condensed(tree: DataFrame, points: DataFrame, least: int) -> tuple[DataFrame, dict[int, dict]]:
    """(thread_id, home): the cluster each point falls out of (-1: none), and the clusters: parent, n, the density at
    which it meets its sibling (birth, 0 for a root) and the sum of its points' densities (mass)."""
    n_edges = tree.count()
    ranges = max(1, -(-n_edges // CHUNK))
    if ranges > 1:
        cuts = tree.approxQuantile("w", [k / ranges for k in range(1, ranges)], 0.1 / ranges)
        part = sum((F.when(F.col("w") > c, 1).otherwise(0) for c in sorted(set(cuts))), F.lit(0))
    else:
        part = F.lit(0)
    tree = materialise(tree.withColumn("part", part), "tree-ranges") if ranges > 1 else tree.withColumn("part", part)
    labels = points.select("thread_id", F.col("thread_id").alias("c"), F.lit(-1).cast("long").alias("home"), F.lit(1).cast("long").alias("n"), F.lit(-1).cast("long").alias("node"))
    clusters: dict[int, dict] = {}
    for k in range(ranges):
        ends = [labels.select(F.col("thread_id").alias(e), F.col("c").alias(x), F.col("n").alias(f"n_{x}"), F.col("node").alias(f"node_{x}")) for e, x in (("src", "a"), ("dst", "b"))]
        told = tree.filter(F.col("part") == k).join(ends[0], "src").join(ends[1], "dst").groupBy("part").applyInPandas(
            _join_range(least, max(clusters, default=-1) + 1), "kind int, c string, root string, n long, node long, one long, two long, value double")
        told = materialise(told, "tree-range")
        for e in told.filter("kind > 0").orderBy("kind", "node").collect():
            if e.kind != 2:
                clusters[e.node] = {"parent": None, "n": 0, "birth": 0.0, "mass": 0.0}
        for e in told.filter("kind > 0").collect():
            c = clusters[e.node]
            if e.kind == 3:
                c["n"] += e.n
                c["mass"] += e.n * e.value
                for child in (e.one, e.two):
                    clusters[child].update(parent=e.node, birth=e.value)
            else:
                c["n"] += e.n
                c["mass"] += e.value
        new = told.filter("kind = 0").select("c", "root", F.col("n").alias("new_n"), F.col("node").alias("new_node"), F.col("one").alias("new_home"))
        was = F.col("new_n").isNull()
        labels = materialise(labels.join(new, "c", "left").select(
            "thread_id", F.coalesce("root", "c").alias("c"), F.when((F.col("home") < 0) & ~was, F.col("new_home")).otherwise(F.col("home")).alias("home"),
            F.coalesce("new_n", "n").alias("n"), F.coalesce("new_node", "node").alias("node")), "tree-labels")
    return labels.select("thread_id", "home"), clusters


def chosen_clusters(clusters: dict[int, dict]) -> dict[int, int]:
    """Cluster -> the chosen cluster that holds it, by excess of mass; roots are never chosen."""
    kids: dict[int, list[int]] = {}
    for c, x in clusters.items():
        if x["parent"] is not None:
            kids.setdefault(x["parent"], []).append(c)
    best: dict[int, float] = {}
    own: set[int] = set()
    for c in sorted(clusters):  # children are numbered before their parents
        x = clusters[c]
        stability = x["mass"] - x["n"] * x["birth"]
        below = sum(best[k] for k in kids.get(c, []))
        if x["parent"] is not None and stability >= below:
            own.add(c)
            best[c] = stability
        else:
            best[c] = below
    out: dict[int, int] = {}
    for c in sorted(clusters, reverse=True):
        p = clusters[c]["parent"]
        if p is not None and p in out:
            out[c] = out[p]
        elif c in own:
            out[c] = c
    return out


def labelled(homes: DataFrame, clusters: dict[int, dict]) -> DataFrame:
    """(thread_id, topic_id): ids 0.. in order of the least thread_id, -1 for noise."""
    table = homes.sparkSession.createDataFrame(list(chosen_clusters(clusters).items()), "home long, pick long")
    picked = homes.join(F.broadcast(table), "home", "left")
    ranked = (picked.filter("pick IS NOT NULL").groupBy("pick").agg(F.min("thread_id").alias("m"))
              .select("pick", (F.row_number().over(Window.orderBy("m")) - 1).cast("int").alias("topic_id")))
    return picked.join(F.broadcast(ranked), "pick", "left").select("thread_id", F.coalesce("topic_id", F.lit(-1)).alias("topic_id"))
