"""Density clustering against plain Python: core distances, spanning tree, condensed tree and its choice."""

import math
import random

import numpy as np
import pytest

from agora.operators import balls as bl
from agora.operators import cluster as cu
from agora.operators import tree as tr


def frame(spark, points):
    return spark.createDataFrame([(i, [float(v) for v in p]) for i, p in points], "thread_id string, embedding array<double>").repartition(3)


def blobs(seed, sizes, spread, dims=3, step=10.0):
    r = random.Random(seed)
    out = []
    for g, n in enumerate(sizes):
        centre = [step * (g + 1) * (1 if d == g % dims else 0.1 * g) for d in range(dims)]
        out += [[c + r.gauss(0, spread) for c in centre] for _ in range(n)]
    out += [[r.uniform(-60, 60) for _ in range(dims)] for _ in range(sum(sizes) // 10)]
    return [(f"p{i:04d}", p) for i, p in enumerate(out)]


def all_distances(points):
    return bl.distances(*[np.array([p for _, p in points], float)] * 2)


def plain_clusters(points, least, samples):
    """Single linkage over mutual reachability, condensed top-down, excess of mass."""
    d = all_distances(points)
    n = len(points)
    core = np.sort(d, axis=1)[:, samples - 1]
    reach = np.maximum(np.maximum(d, core[:, None]), core[None, :])
    edges = sorted((reach[i, j], i, j) for i in range(n) for j in range(i))
    up = list(range(n))

    def top(i):
        while up[i] != i:
            i = up[i]
        return i
    tree = []
    for w, i, j in edges:
        a, b = top(i), top(j)
        if a != b:
            up[a] = b
            tree.append((w, i, j))

    def parts(members, edges):
        near = {m: [] for m in members}
        for _, i, j in edges:
            near[i].append(j)
            near[j].append(i)
        seen, out = set(), []
        for m in members:
            if m not in seen:
                stack, comp = [m], []
                seen.add(m)
                while stack:
                    v = stack.pop()
                    comp.append(v)
                    for o in near[v]:
                        if o not in seen:
                            seen.add(o)
                            stack.append(o)
                out.append(comp)
        return out

    def solve(members, edges, birth, root):
        """(stability, chosen member lists) of the cluster that holds ``members`` at its birth."""
        mass, alive, whole = 0.0, list(members), list(members)
        edges = sorted(edges)
        while edges:
            w = edges.pop()[0]
            comps = parts(alive, edges)
            big = [c for c in comps if len(c) >= least]
            gone = len(alive) - sum(map(len, big))
            mass += gone / w
            if len(big) >= 2:
                mass += sum(map(len, big)) / w
                below = [solve(c, [e for e in edges if e[1] in set(c)], 1 / w, False) for c in big]
                total = sum(s for s, _ in below)
                own = mass - len(whole) * birth
                if not root and own >= total:
                    return own, [whole]
                return total, [x for _, xs in below for x in xs]
            if not big:
                break
            alive = big[0]
            edges = [e for e in edges if e[1] in set(alive)]
        return (0.0, []) if root else (mass - len(whole) * birth, [whole])

    return core, [w for w, _, _ in tree], {frozenset(points[i][0] for i in c) for c in solve(list(range(n)), tree, 0.0, True)[1]}


def found(df):
    out = {}
    for r in df.collect():
        out.setdefault(r.topic_id, set()).add(r.thread_id)
    return {frozenset(v) for k, v in out.items() if k >= 0}


@pytest.mark.parametrize("seed,sizes,spread,block,least,samples", [
    (1, [50, 40, 30], 1.0, 40, 10, 5), (3, [60, 60], 0.5, 1000, 10, 5)])
def test_equals_plain_single_linkage(spark, monkeypatch, seed, sizes, spread, block, least, samples):
    points = blobs(seed, sizes, spread)
    core, weights, want = plain_clusters(points, least, samples)
    assert len(want) >= 2
    blocks, balls = bl.blocks_of(frame(spark, points), block)
    got, skipped = bl.core_distances(blocks, balls, samples - 1)
    assert {r.thread_id: r.core for r in got.collect()} == {i: c for (i, _), c in zip(points, core)}
    edges, left_out = bl.tree_candidates(got, balls)
    tree = tr.spanning_tree(edges)
    assert sorted(r.w for r in tree.collect()) == pytest.approx(sorted(weights))
    if block < 100:
        assert skipped > 0 and left_out >= 0
    for chunk in (1_000_000, len(points) // 2):  # one range of weights, and several
        monkeypatch.setattr(tr, "CHUNK", chunk)
        assert found(tr.labelled(*tr.condensed(tree, got, least))) == want


def test_narrow_gaps_between_clusters(spark):
    """Two pairs of groups that part at almost the same weight come out as four."""
    points = [(f"p{g}{i:02d}", [base + 0.001 * i, 0.0]) for g, base in enumerate((0.0, 1.0, 100.0, 101.0001)) for i in range(20)]
    df = cu.topic_clusters(frame(spark, points), reduce=False, block_size=16, min_cluster_size=10, min_samples=3)
    want = plain_clusters(points, 10, 3)[2]
    assert len(want) == 4 and found(df) == want


def test_long_lists_and_bins(spark, monkeypatch):
    """Many equal and many distinct distances: bins are narrowed in several rounds."""
    monkeypatch.setattr(bl, "LIST", 3)
    r = random.Random(6)
    points = [(f"q{i:03d}", [r.choice([0.0, 1.0, r.random()]), 0.0]) for i in range(150)]
    blocks, balls = bl.blocks_of(frame(spark, points), 30)
    for k in (40,):
        got, _ = bl.core_distances(blocks, balls, k)
        want = np.sort(all_distances(points), axis=1)[:, k]
        assert {x.thread_id: x.core for x in got.collect()} == {i: c for (i, _), c in zip(points, want)}
    assert {x.core for x in bl.core_distances(blocks, balls, 150)[0].collect()} == {math.inf}
