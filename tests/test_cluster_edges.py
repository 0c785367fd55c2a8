"""Clustering of many points: bounds from a sample, few tree edges, rows that repeat an id."""

import numpy as np
import pytest

from agora.operators import balls as bl
from agora.operators import cluster as cu
from agora.operators import tree as tr

from .test_clusters import blobs, found, frame, plain_clusters


def test_few_edges_and_failing_bounds(spark, monkeypatch):
    """Tree edges number about one a point, and bounds from a small sample that miss are mended."""
    monkeypatch.setattr(bl, "SAMPLE", (40, 40))
    monkeypatch.setattr(bl, "SIGMAS", 0.2)
    points = blobs(5, [60, 50], 2.0)
    core, weights, _ = plain_clusters(points, 10, 12)
    blocks, balls = bl.blocks_of(frame(spark, points), 40)
    got, _ = bl.core_distances(blocks, balls, 11)
    assert {r.thread_id: r.core for r in got.collect()} == {i: c for (i, _), c in zip(points, core)}
    edges, _ = bl.tree_candidates(got, balls)
    assert edges.count() < 2 * len(points)
    assert sorted(r.w for r in tr.spanning_tree(edges).collect()) == pytest.approx(sorted(weights))


def test_repeated_and_missing_ids(spark):
    """A row that repeats an id is one more point; one without an id is a point without a result."""
    points = blobs(9, [30, 30], 0.5)
    twice = [(i, [float(v) for v in p]) for i, p in points + points[:5]] + [(None, [float(v) for v in points[40][1]])]
    df = cu.topic_clusters(spark.createDataFrame(twice, "thread_id string, embedding array<double>"), reduce=False, min_cluster_size=10, min_samples=4)
    rows = df.collect()
    assert sorted(r.thread_id for r in rows) == sorted(i for i, _ in twice if i is not None)
    want = plain_clusters([(i or "none", p) for i, p in twice], 10, 4)[2]
    assert {frozenset(x - {"none"}) for x in want} == found(df)


def test_groups_that_lie_apart_have_pivots_of_their_own_and_never_meet(spark):
    draw = np.random.default_rng(5)
    centres = draw.normal(size=(10, 8)) * 20
    points = [(f"p{i:04d}", (centres[i % 10] + draw.normal(size=8) * 0.1).tolist()) for i in range(800)]
    blocks, balls = bl.blocks_of(frame(spark, points), 40)
    assert {int(bl.distances(c[None], centres).argmin()) for c in balls.centre} == set(range(10))
    got, skipped = bl.core_distances(blocks, balls, 7)
    assert skipped >= 0.85
    d = bl.distances(*[np.array([p for _, p in points])] * 2)
    assert {r.thread_id: r.core for r in got.collect()} == {i: c for (i, _), c in zip(points, np.sort(d, axis=1)[:, 7].tolist())}


def test_blocks_of_one_tree_are_not_compared(monkeypatch):
    monkeypatch.setattr(bl, "_squares", None)
    side = {"embedding": np.zeros((3, 2)), "core": np.zeros(3), "thread_id": np.array(list("abc"), object), "tree": np.array(["t"] * 3, object)}
    assert bl._forest(0, 1, side, side).empty


def test_points_away_from_the_other_block_are_left_out_and_no_edge_within_the_limit_is_lost():
    draw = np.random.default_rng(6)
    sides = []
    for x, name in ((0.0, "a"), (6.0, "b")):
        v = draw.normal(size=(300, 5)) + np.array([x, 0, 0, 0, 0])
        sides.append({"embedding": v, "core": draw.random(300) * 4, "thread_id": np.array([f"{name}{i}" for i in range(300)], object), "tree": np.array([name] * 300, object)})
    left, right = sides
    reach = np.maximum(np.maximum(bl.distances(left["embedding"], right["embedding"]), left["core"][:, None]), right["core"])
    limit = float(np.sort(reach, axis=None)[20])
    a, b = bl._facing(left, right, limit)
    assert len(a["core"]) * len(b["core"]) < reach.size / 10
    i, j = np.nonzero(reach <= limit)
    assert set(left["thread_id"][i]) <= set(a["thread_id"]) and set(right["thread_id"][j]) <= set(b["thread_id"])
    whole, part = bl._forest(0, 1, left, right), bl._joins(limit)(0, 1, left, right)
    assert whole.values.tolist() == part.values.tolist() and len(whole) == 1
    assert bl._joins(0.01)(0, 1, left, right).empty
    assert bl._joins(float("inf"))(0, 1, left, right).values.tolist() == whole.values.tolist()
