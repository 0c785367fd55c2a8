"""Exact core distances and candidate tree edges over blocks of points, pruned by pivot balls.

Points are dealt to the nearest of at most ``MAX_PIVOTS`` pivots, drawn from a bounded sample with the square of the
distance to those drawn before as weight, so that groups that lie apart have pivots of their own; a cell is parted into the points near its pivot and the
far ones (over twice the median distance), and parts of more than ``block_size`` points are split by hash.  A block is a
ball, or the shell of one: its pivot, the least and the largest distance to it.  By the triangle inequality these bound
the distances between two blocks, so pairs of blocks far apart never meet.  Blocks that meet travel as one packed row
each; a pair is one matrix product in chunks, and only values near a bound get the exact distance:

* the k-th distance of a point lies between two bounds: those of its block follow from the balls' counts, its own from
  the ranks of its distances to a bounded sample of points; a block meets only blocks that the widest of these reaches.  Nearer points are counted and the distances between the
  bounds are listed, in ascending order with their counts; where a point would list more than ``LIST``, distances are
  first counted in ``BINS`` bins, and the bin with the k-th is narrowed.  A point whose bounds prove wrong starts again
  from those of its block;
* a point with a point of lower core distance (ties by place) no farther than its own core distance has a tree edge of
  exactly that weight, its least possible one; these edges leave one root for each peak of density.  Between the trees
  of the roots the lightest edges of each pair of blocks are kept;
* a spanning tree edge between trees is never heavier than the heaviest of any connected subgraph, here along a tree of
  pivots; points and pairs of blocks whose least mutual reachability is above it are skipped, and pairs of blocks of one
  tree.  Of two blocks only the points matter whose distance to the other block along the line of their means is not
  above it: no distance is less than its projection.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialise
from .tree import roots, spanning_tree

MAX_PIVOTS, MAX_BLOCKS = 4096, 32768
BINS, LIST = 64, 4096
SAMPLE, SIGMAS = (16384, 32768), 4.5  # points of the sample that bounds the k-th distances; width of the bounds
CHUNK_VALUES, MAX_TREES = 1 << 20, 4096


@dataclass
class Balls:
    """At most 2 * MAX_PIVOTS + MAX_BLOCKS rows, whatever the table: pivot, radii and number of points of each block."""
    centre: np.ndarray
    inner: np.ndarray
    radius: np.ndarray
    count: np.ndarray
    cell: np.ndarray

    def between(self, i: int) -> tuple[np.ndarray, np.ndarray]:
        """Least and greatest possible distance of a point of block ``i`` to one of each block (with room for rounding)."""
        d, r = distances(self.centre[i:i + 1], self.centre)[0], self.radius[i] + self.radius
        slack = 1e-9 * (1.0 + d + r)
        apart = np.maximum(d - r, np.maximum(self.inner[i] - d - self.radius, self.inner - d - self.radius[i]))
        return np.maximum(apart - slack, 0.0), d + r + slack


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances, summed one dimension after the other: the same value for a pair in any block and order."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        diff = a[:, k, None] - b[None, :, k]
        out += diff * diff
    return np.sqrt(out)


def _vectors(pdf: pd.DataFrame) -> np.ndarray:
    return np.stack(pdf["embedding"].to_numpy()).astype(np.float64)


def _pivots(sample: np.ndarray, want: int) -> np.ndarray:
    """At most ``want`` rows, each drawn with the square of its distance to those drawn before as weight; fewer only if
    all the others are equal to drawn ones.  They decide what is pruned, never a result."""
    draw = np.random.default_rng(0)
    picked, near = [0], np.full(len(sample), np.inf)
    while len(picked) < want:
        near = np.minimum(near, distances(sample[picked[-1:]], sample)[0])
        upto = np.cumsum(np.where(np.isfinite(near), near, 0.0) ** 2)
        if not 0 < upto[-1] < np.inf:
            break
        picked.append(int(np.searchsorted(upto, draw.random() * upto[-1], "right")))
    return sample[picked]


def blocks_of(x: DataFrame, block_size: int) -> tuple[DataFrame, Balls]:
    """(thread_id, embedding, blk), written, and the balls."""
    spark, n = x.sparkSession, x.count()
    block_size = max(block_size, math.ceil(n / MAX_BLOCKS))
    want = min(MAX_PIVOTS, max(1, math.ceil(n / block_size)))
    some = x.orderBy(F.xxhash64("thread_id"), "thread_id").limit(SAMPLE[0]).select("embedding").collect()
    pivots = _pivots(np.array([r[0] for r in some], np.float64), want)

    def nearest(batches):
        for pdf in batches:
            d = distances(_vectors(pdf), pivots)
            cell = d.argmin(axis=1)
            yield pdf.assign(cell=cell, dist=d[np.arange(len(d)), cell])

    dealt = x.select("thread_id", "embedding").mapInPandas(nearest, "thread_id string, embedding array<double>, cell int, dist double")
    dealt = materialise(dealt, "clusters-cells")
    middles = dealt.groupBy("cell").agg(F.percentile_approx("dist", 0.5).alias("middle"))
    dealt = dealt.join(F.broadcast(middles), "cell").withColumn("far", F.col("dist") > 2 * F.col("middle")).drop("middle")
    first, rows = 0, []
    for r in dealt.groupBy("cell", "far").agg(F.count(F.lit(1)).alias("n")).orderBy("cell", "far").collect():
        rows.append((r.cell, r.far, first, math.ceil(r.n / block_size)))
        first += rows[-1][3]
    table = spark.createDataFrame(rows, "cell int, far boolean, first int, parts int")
    blk = F.col("first") + F.pmod(F.xxhash64("thread_id"), F.col("parts")).cast("int")
    dealt = materialise(dealt.join(F.broadcast(table), ["cell", "far"]).select("thread_id", "embedding", "dist", blk.alias("blk")), "clusters-blocks")
    found = {r.blk: r for r in dealt.groupBy("blk").agg(F.min("dist").alias("inner"), F.max("dist").alias("outer"), F.count(F.lit(1)).alias("n")).collect()}
    cells = [c for c, _, _, parts in rows for _ in range(parts)]
    inner, radius = (np.array([getattr(found[b], k) if b in found else 0.0 for b in range(first)]) for k in ("inner", "outer"))
    count = np.array([found[b].n if b in found else 0 for b in range(first)], np.int64)
    return dealt.select("thread_id", "embedding", "blk"), Balls(pivots[cells], inner, radius, count, np.array(cells))


def _packed(rows: DataFrame, name: str) -> DataFrame:
    """One row a block, written: thread_ids in order, vectors and further columns as bytes (strings as lists)."""
    more = [c for c in rows.columns if c not in ("thread_id", "blk", "embedding")]
    texts = [f.name for f in rows.schema if f.name in more and f.dataType.typeName() == "string"]

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("thread_id", kind="stable")
        out = {"blk": [pdf["blk"].iat[0]], "thread_id": [pdf["thread_id"].to_numpy()], "embedding": [_vectors(pdf).tobytes()]}
        for c in more:
            out[c] = [pdf[c].to_numpy() if c in texts else pdf[c].to_numpy(np.float64).tobytes()]
        return pd.DataFrame(out)

    kinds = ", ".join(f"{c} {'array<string>' if c in texts else 'binary'}" for c in more)
    schema = "blk int, thread_id array<string>, embedding binary" + (f", {kinds}" if more else "")
    return materialise(rows.groupBy("blk").applyInPandas(pack, schema), name)


def _unpacked(pdf: pd.DataFrame) -> dict:
    """The packed block of a pair as arrays."""
    row = pdf.iloc[0]
    ids = np.asarray(row["thread_id"], object)
    out = {c: np.frombuffer(row[c]) if isinstance(row[c], bytes) else np.asarray(row[c], object) for c in pdf.columns if c not in ("bi", "bj", "ki", "kj")}
    out.update(thread_id=ids, embedding=out["embedding"].reshape(len(ids), -1))
    return out


def _meet(left: DataFrame, right: DataFrame, pairs: DataFrame, run, schema: str) -> DataFrame:
    """``run`` on the packed blocks bi (left) and bj (right) of each pair: (bi, bj, arrays, arrays)."""
    def side(df, blk, keys):
        p = pairs.select(*(F.col(c).alias(k) for c, k in zip(("bi", "bj"), keys)))
        rows = df.select(F.col("blk").alias("_blk"), *(F.col(c).alias(c) for c in df.columns if c != "blk"))
        return rows.join(p, F.col("_blk") == F.col(blk)).drop("_blk").groupBy(*keys)

    empty = pd.DataFrame({f.strip().split()[0]: pd.Series([], dtype=object) for f in schema.split(",")})

    def both(key, l: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        return run(int(key[0]), int(key[1]), _unpacked(l), _unpacked(r)) if len(l) and len(r) else empty

    return side(left, "bi", ("bi", "bj")).cogroup(side(right, "kj", ("ki", "kj"))).applyInPandas(both, schema)


def _squares(a: np.ndarray, b: np.ndarray):
    """Squared distances of chunks of rows of ``a`` to all of ``b`` by a matrix product, as (first row, values), and
    the greatest error of a value."""
    na, nb = (a * a).sum(axis=1), (b * b).sum(axis=1)
    left = np.hstack([-2.0 * a, na[:, None], np.ones((len(a), 1))])
    right = np.vstack([b.T, np.ones((1, len(b))), nb[None]])
    step = max(1, CHUNK_VALUES // max(len(b), 1))
    slack = 1e-15 * (16 + 4 * a.shape[1]) * float(na.max(initial=0.0) + nb.max(initial=0.0))
    return ((s, left[s:s + step] @ right) for s in range(0, len(a), step)), slack


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """``distances`` of each row of ``a`` to the same row of ``b``."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        diff = a[:, k] - b[:, k]
        out += diff * diff
    return np.sqrt(out)


def _near(left: dict, right: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each left row the number of right rows nearer than ``lo``; and (row, distance) of those within lo and hi, in order."""
    a, b, lo, hi = left["embedding"], right["embedding"], left["lo"], left["hi"]
    chunks, slack = _squares(a, b)
    under, rows, found = np.zeros(len(a), np.int64), [], []
    for s, d2 in chunks:
        e = s + len(d2)
        at = np.flatnonzero(d2 <= (hi[s:e] ** 2 + slack)[:, None])
        r, c = at // len(b), at % len(b)
        near = d2.ravel()[at] >= (lo[s:e] ** 2 - slack)[r]
        under[s:e] += np.bincount(r[~near], minlength=e - s)
        r, c = r[near] + s, c[near]
        d = _exact(a[r], b[c])
        under += np.bincount(r[d < lo[r]], minlength=len(a))
        keep = (d >= lo[r]) & (d <= hi[r])
        r, d = r[keep], d[keep]
        order = np.lexsort((d, r))
        rows.append(r[order])
        found.append(d[order])
    return under, np.concatenate(rows), np.concatenate(found)


def _runs(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where runs of equal sorted keys begin, and their lengths."""
    new = np.ones(len(keys[0]), bool)
    if len(new):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    at = np.flatnonzero(new)
    return at, np.diff(np.append(at, len(new)))


def _count_bins(bi: int, bj: int, left: dict, right: dict) -> pd.DataFrame:
    under, rows, d = _near(left, right)
    lo, hi = left["lo"], left["hi"]
    width = np.where(np.isfinite(hi) & (hi > lo), hi - lo, 1.0)
    share = np.minimum((d - lo[rows]) / width[rows], 1.0)
    if len(d) and not np.all(np.isfinite(hi)):  # no upper bound yet
        share = np.where(np.isfinite(hi[rows]), share, d / (1.0 + d))
    bins = 1 + np.minimum(share * BINS, BINS - 1).astype(np.int64)
    at, n = _runs(rows, bins)
    some = np.flatnonzero(under)
    ids = left["thread_id"]
    high = d[at + n - 1] if len(at) else d
    return pd.DataFrame({"thread_id": pd.Series(np.concatenate([ids[some], ids[rows[at]]]), dtype=object), "bin": np.concatenate([np.zeros(len(some), np.int64), bins[at]]),
                         "n": np.concatenate([under[some], n]), "low": np.concatenate([np.zeros(len(some)), d[at]]), "high": np.concatenate([lo[some], high])})


def _list_values(bi: int, bj: int, left: dict, right: dict) -> pd.DataFrame:
    under, rows, d = _near(left, right)
    at, n = _runs(rows, d)
    many = n.astype(np.int32).tobytes() if len(n) and n.max() > 1 else b""
    return pd.DataFrame({"blk": [bi], "under": [under.tobytes()], "row": [rows[at].astype(np.int32).tobytes()], "value": [d[at].tobytes()], "n": [many]})


def core_distances(x: DataFrame, balls: Balls, k: int) -> tuple[DataFrame, float]:
    """(thread_id, blk, embedding, core), written: the distance to the k-th other point (infinity if there are fewer);
    and the share of block pairs whose distances were never computed."""
    spark, blocks, rank, total = x.sparkSession, len(balls.count), k + 1, int(balls.count.sum())  # the point itself is the first

    def bounds(batches):
        for pdf in batches:
            for i in pdf["id"].tolist():
                low, up = balls.between(i)

                def reach(v):
                    order = np.argsort(v, kind="stable")
                    at = int(np.searchsorted(np.cumsum(balls.count[order]), rank))
                    return float(v[order[at]]) if at < blocks else math.inf
                lo, hi = reach(low), reach(up)
                meets = np.flatnonzero((low <= hi) & (up >= lo) & (balls.count > 0))
                yield pd.DataFrame({"bi": i, "bj": meets, "low": low[meets], "lo": lo, "hi": hi, "inside": int(balls.count[up < lo].sum())})

    if total < rank:
        return x.withColumn("core", F.lit(math.inf)), 0.0
    pairs = materialise(spark.range(blocks).mapInPandas(bounds, "bi int, bj int, low double, lo double, hi double, inside long"), "clusters-pairs")
    limits = pairs.groupBy(F.col("bi").alias("blk")).agg(F.first("lo").alias("lo"), F.first("hi").alias("hi"), F.first("inside").alias("inside"))
    right = _packed(x, "clusters-packed")
    size = total if total <= SAMPLE[0] else min(SAMPLE[1], max(SAMPLE[0], total // 6))
    some = np.array([r[0] for r in x.orderBy(F.xxhash64("thread_id", F.lit(1)), "thread_id").limit(size).select("embedding").collect()], np.float64)
    mean = rank * size / total
    spread = 0.0 if size == total else SIGMAS * math.sqrt(mean) + 1
    first, last = math.floor(mean - spread), math.ceil(mean + spread)

    def ranked(batches):
        for pdf in batches:
            v = _vectors(pdf)
            lo, hi = pdf["lo"].to_numpy(np.float64).copy(), pdf["hi"].to_numpy(np.float64).copy()
            chunks, slack = _squares(v, some)
            for s, d2 in chunks:
                e, ranks = s + len(d2), [r for r in (first, last) if 1 <= r <= size]
                part = np.partition(d2.astype(np.float32), [r - 1 for r in ranks], axis=1).astype(np.float64) if ranks else d2
                if 1 <= first:
                    lo[s:e] = np.maximum(lo[s:e], np.sqrt(np.maximum(part[:, first - 1] * (1 - 1e-6) - slack, 0.0)))
                if last <= size:
                    hi[s:e] = np.minimum(hi[s:e], np.sqrt(np.maximum(part[:, last - 1] * (1 + 1e-6) + slack, 0.0)))
            yield pdf.assign(lo=lo, hi=np.maximum(hi, lo))

    whole = x.join(F.broadcast(limits), "blk").select("thread_id", "blk", "embedding", "inside", "lo", "hi")
    state = materialise(whole.mapInPandas(ranked, "thread_id string, blk int, embedding array<double>, inside long, lo double, hi double"), "clusters-bounds")
    # what no point of a block reaches is neither counted nor listed
    reach = state.groupBy(F.col("blk").alias("bi")).agg(F.max("hi").alias("reach"))
    near = materialise(pairs.join(F.broadcast(reach), "bi").filter("low <= reach").select("bi", "bj"), "clusters-near")
    skipped = 1.0 - near.count() / blocks ** 2
    narrow = (last - max(first, 0)) / size * total > LIST if last <= size else total > LIST
    kept = []
    while True:
        while narrow:
            counts = _meet(_packed(state, "clusters-packed"), right, near, _count_bins, "thread_id string, bin int, n long, low double, high double")
            counts = counts.groupBy("thread_id", "bin").agg(F.sum("n").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
            bins = counts.groupBy("thread_id").agg(F.array_sort(F.collect_list(F.struct("bin", "n", "low", "high"))).alias("bins"))  # at most BINS + 1 of a point
            held = state.select("thread_id", "blk", "embedding", "inside", F.col("lo").alias("was_lo"), F.col("hi").alias("was_hi")).join(bins, "thread_id")
            upto = F.aggregate("bins", F.struct(F.col("inside").alias("sum"), F.lit(None).cast("double").alias("lo"), F.lit(None).cast("double").alias("hi"), F.lit(0).cast("long").alias("n")),
                               lambda a, b: F.when(a["lo"].isNull() & (a["sum"] + b["n"] >= rank), F.struct(a["sum"].alias("sum"), b["low"].alias("lo"), b["high"].alias("hi"), b["n"].alias("n")))
                               .otherwise(F.struct((a["sum"] + F.when(a["lo"].isNull(), b["n"]).otherwise(F.lit(0).cast("long"))).alias("sum"), a["lo"].alias("lo"), a["hi"].alias("hi"), a["n"].alias("n"))))
            hit = held.withColumn("hit", upto)
            state = materialise(hit.select("thread_id", "blk", "embedding", "inside", F.coalesce("hit.lo", "was_lo").alias("lo"), F.coalesce("hit.hi", "was_hi").alias("hi"), F.coalesce("hit.n", F.lit(0)).alias("held")), "clusters-bounds")
            narrow = not state.filter((F.col("held") > LIST) & (F.col("lo") < F.col("hi"))).isEmpty()
            state = state.drop("held")
        packed = _packed(state, "clusters-packed")
        # only pairs with rows on both sides
        asked = near.join(packed.select(F.col("blk").alias("bi")), "bi", "left_semi").select("bi", "bj")
        listed = _meet(packed, right, asked, _list_values, "blk int, under binary, row binary, value binary, n binary")

        def chosen(key, block: pd.DataFrame, lists: pd.DataFrame) -> pd.DataFrame:
            left = _unpacked(block)
            lists = lists.sort_values("row", kind="stable")
            rows, values = (np.concatenate([np.frombuffer(b, t) for b in lists[c]]) for c, t in (("row", np.int32), ("value", np.float64)))
            n = np.concatenate([np.frombuffer(m, np.int32) if m else np.ones(len(r) // 4, np.int32) for m, r in zip(lists["n"], lists["row"])])
            under = np.sum([np.frombuffer(u, np.int64) for u in lists["under"]], axis=0)
            order = np.lexsort((values, rows))
            rows, values, upto = rows[order], values[order], np.cumsum(n[order], dtype=np.int64)
            ends = np.concatenate([[0], upto])[np.searchsorted(rows, np.arange(len(under) + 1))]
            want = rank - left["inside"].astype(np.int64) - under
            ok = (want > 0) & (ends[:-1] + want <= ends[1:])
            at = np.minimum(np.searchsorted(upto, ends[:-1] + want), max(len(values) - 1, 0))
            core = pd.Series(values[at] if len(values) else 0.0, index=range(len(ok)), dtype="float64").where(ok)  # null: bounds missed it
            return pd.DataFrame({"thread_id": pd.Series(left["thread_id"], dtype=object), "blk": int(key[0]), "embedding": list(left["embedding"]), "core": core})

        done = packed.groupBy("blk").cogroup(listed.groupBy("blk")).applyInPandas(chosen, "thread_id string, blk int, embedding array<double>, core double")
        done = materialise(done, "clusters-core")
        kept.append(done.filter("core IS NOT NULL"))
        wrong = done.filter("core IS NULL")
        if wrong.isEmpty():
            break
        if len(kept) > 1:  # the bounds of a block hold for all finite vectors
            raise ValueError("a vector holds a value that is not finite")
        state = materialise(whole.join(wrong.select("thread_id").distinct(), "thread_id", "left_semi").select(*state.columns), "clusters-bounds")
        narrow, near = True, pairs.select("bi", "bj")
    out = kept[0]
    for more in kept[1:]:
        out = out.unionByName(more)
    return out, skipped


def _lower(bi: int, bj: int, left: dict, right: dict) -> pd.DataFrame:
    """Of each left row the right row of least (core, block, place) among those no farther than its core distance and
    before it in that order: an edge of its least possible weight."""
    order = np.argsort(right["core"], kind="stable")
    a, b, core, sorted_core = left["embedding"], right["embedding"][order], left["core"], right["core"][order]
    chunks, slack = _squares(a, b)
    out = []
    for s, d2 in chunks:
        e = s + len(d2)
        hit = d2 <= (core[s:e] ** 2 + slack)[:, None]
        at = hit.argmax(axis=1)
        r = np.arange(s, e)
        before = (sorted_core[at] < core[r]) | ((sorted_core[at] == core[r]) & ((bj < bi) | ((bj == bi) & (order[at] < r))))
        ok = hit[np.arange(e - s), at] & before
        r, at = r[ok], at[ok]
        ok = _exact(a[r], b[at]) <= core[r]
        out.append((r[ok], at[ok]))
    r, at = (np.concatenate(v) for v in zip(*out))
    return pd.DataFrame({"src": pd.Series(left["thread_id"][r], dtype=object), "dst": pd.Series(right["thread_id"][order[at]], dtype=object), "w": core[r], "low": sorted_core[at], "blk": bj, "place": order[at]})


def _facing(left: dict, right: dict, limit: float) -> tuple[dict, dict]:
    """The points of two blocks that can be part of an edge between them of at most ``limit``: distances along the line
    of the blocks' means are never above the true ones."""
    axis = right["embedding"].mean(axis=0) - left["embedding"].mean(axis=0)
    size = float(np.sqrt((axis * axis).sum()))
    if not (0 < size < np.inf and limit < np.inf):
        return left, right
    a, b = left["embedding"] @ (axis / size), right["embedding"] @ (axis / size)
    limit += 1e-9 * (1.0 + limit + float(np.abs(a).max() + np.abs(b).max()))
    mine = (left["core"] <= limit) & (b.min() - a <= limit)
    other = (right["core"] <= limit) & (b - a[mine].max(initial=-np.inf) <= limit)
    mine &= b[other].min(initial=np.inf) - a <= limit
    return {k: v[mine] for k, v in left.items()}, {k: v[other] for k, v in right.items()}


def _joins(limit: float):
    """``_forest`` of a pair, without points that only edges above ``limit`` have."""
    def run(bi: int, bj: int, left: dict, right: dict) -> pd.DataFrame:
        return _forest(bi, bj, *((left, right) if bi == bj else _facing(left, right, limit)))
    return run


def _forest(bi: int, bj: int, left: dict, right: dict) -> pd.DataFrame:
    """Edges that hold a minimum spanning forest of the mutual reachability edges within a block, or between two, that
    join different trees: the lightest of each two trees, or where these are many the whole forest (Prim)."""
    trees, code = np.unique(np.concatenate([left["tree"], right["tree"]]), return_inverse=True)
    if len(trees) < 2 or not len(left["tree"]) or not len(right["tree"]):
        return pd.DataFrame({"src": [], "dst": [], "w": []}, dtype=object)
    sides = []
    for side, c in ((left, code[:len(left["tree"])]), (right, code[len(left["tree"]):])):
        order = np.argsort(c, kind="stable")
        at, n = _runs(c[order])
        sides.append((side["embedding"][order], side["core"][order], side["thread_id"][order], c[order], at, n))
    (a, ca, ia, ta, sa, na), (b, cb, ib, tb, sb, nb) = sides
    if len(sa) * len(sb) > MAX_TREES:
        return _prim(bi == bj, left, right)
    best: dict = {}
    chunks, slack = _squares(a, b)
    for s, d2 in chunks:
        e = s + len(d2)
        w = np.maximum(np.maximum(d2, (ca[s:e] ** 2)[:, None]), (cb ** 2)[None])
        least = np.minimum.reduceat(w, sb, axis=1)
        first = int(np.searchsorted(sa, s, side="right")) - 1
        for p in range(first, len(sa)):
            u, v = max(int(sa[p]), s) - s, min(int(sa[p] + na[p]), e) - s
            if u >= v:
                break
            low = least[u:v].min(axis=0)
            for q in range(len(sb)):
                one, two = int(ta[sa[p]]), int(tb[sb[q]])
                known = best.get((min(one, two), max(one, two)))
                if one == two or (known is not None and known[0] ** 2 + slack < low[q]):
                    continue
                cut = w[u:v, sb[q]:sb[q] + nb[q]]
                i, j = np.nonzero(cut <= low[q] + 2 * slack)
                i, j = i + s + u, j + sb[q]
                reach = np.maximum(np.maximum(_exact(a[i], b[j]), ca[i]), cb[j])
                i, j = i[reach == reach.min()], j[reach == reach.min()]
                mine = min((reach.min(), *sorted((ia[x], ib[y]))) for x, y in zip(i, j))
                if known is None or mine < known:
                    best[min(one, two), max(one, two)] = mine
    return pd.DataFrame([(x, y, w) for w, x, y in best.values() if math.isfinite(w)], columns=["src", "dst", "w"], dtype=object)


def _prim(within: bool, left: dict, right: dict) -> pd.DataFrame:
    a, core, ids = (left[c] if within else np.concatenate([left[c], right[c]]) for c in ("embedding", "core", "thread_id"))
    n = len(a)
    side = np.arange(n) < len(left["core"])
    inside, best, parent = np.zeros(n, bool), np.full(n, np.inf), np.full(n, -1)
    src, dst, weight, v = [], [], [], 0
    for _ in range(n):
        inside[v] = True
        w = np.maximum(np.maximum(distances(a[v:v + 1], a)[0], core[v]), core)
        closer = ~inside & (w < best) & (within | (side != side[v]))
        best[closer], parent[closer] = w[closer], v
        left_best = np.where(inside, np.inf, best)
        v = int(left_best.argmin())
        if not np.isfinite(left_best[v]):
            break
        src.append(ids[parent[v]])
        dst.append(ids[v])
        weight.append(left_best[v])
    return pd.DataFrame({"src": src, "dst": dst, "w": weight}, dtype=object)


def tree_candidates(points: DataFrame, balls: Balls) -> tuple[DataFrame, float]:
    """(src, dst, w, sure, a, b), written: edges that hold a minimum spanning tree of mutual reachability over (thread_id,
    blk, embedding, core); ``sure`` ones belong to it and make trees, whose roots a and b the others join; and the share
    of block pairs that were skipped."""
    spark, count = points.sparkSession, len(balls.count)
    most = {r.blk: (r.low, r.high) for r in points.groupBy("blk").agg(F.min("core").alias("low"), F.max("core").alias("high")).collect()}  # one row a block
    live = sorted(most)
    core = np.array([most[b][0] if b in most else math.inf for b in range(count)])
    empty = spark.createDataFrame([], "src string, dst string, w double, sure boolean, a string, b string")
    if not any(math.isfinite(most[b][0]) for b in live):
        return empty, 0.0
    edge, packed = "src string, dst string, w double, low double, blk int, place int", _packed(points, "clusters-packed")
    own = spark.createDataFrame([(b, b) for b in live], "bi int, bj int")
    sure = materialise(_meet(packed, packed, own, _lower, edge), "clusters-lower")
    open_ = _packed(points.join(sure.select(F.col("src").alias("thread_id")), "thread_id", "left_anti").select(*points.columns), "clusters-open")

    def in_reach(batches):
        for pdf in batches:
            for i in pdf["blk"].tolist():
                low, _ = balls.between(i)
                meets = np.flatnonzero((low <= most[i][1]) & (core <= most[i][1]) & (balls.count > 0) & (np.arange(count) != i))
                yield pd.DataFrame({"bi": np.full(len(meets), i, np.int32), "bj": meets.astype(np.int32)})

    asked = materialise(open_.select("blk").mapInPandas(in_reach, "bi int, bj int"), "clusters-asked")
    more = _meet(open_, packed, asked, _lower, edge).groupBy("src").agg(F.min(F.struct("low", "blk", "place", "dst", "w")).alias("e"))
    sure = materialise(sure.select("src", "dst", "w").unionByName(more.select("src", "e.dst", "e.w")), "clusters-sure")
    ups = points.select(F.col("thread_id").alias("c")).join(sure.select(F.col("src").alias("c"), F.col("dst").alias("up")), "c", "left")
    trees = roots(ups.select("c", F.coalesce("up", "c").alias("up"))).select(F.col("c").alias("thread_id"), F.col("root").alias("tree"))
    sure = sure.select("src", "dst", "w", F.lit(True).alias("sure"), F.col("src").alias("a"), F.col("src").alias("b"))
    points = materialise(points.join(trees, "thread_id"), "clusters-trees")
    if points.select("tree").distinct().count() == 1:
        return sure, 1.0
    # blocks of a cell in a row, and the first blocks of the cells along a tree of their pivots
    tied = [(b, b) for b in live]
    firsts: dict[int, int] = {}
    last: dict[int, int] = {}
    for b in live:
        c = int(balls.cell[b])
        if c in last:
            tied.append((last[c], b))
        firsts.setdefault(c, b)
        last[c] = b
    heads = list(firsts.values())
    reach, near = np.full(len(heads), np.inf), np.zeros(len(heads), np.int64)
    done, v = np.zeros(len(heads), bool), 0
    for _ in range(len(heads) - 1):
        done[v] = True
        d = distances(balls.centre[heads[v]][None], balls.centre[heads])[0]
        closer = ~done & (d < reach)
        reach[closer], near[closer] = d[closer], v
        v = int(np.where(done, np.inf, reach).argmin())
        tied.append(tuple(sorted((heads[near[v]], heads[v]))))
    held = set(tied)
    packed = _packed(points, "clusters-packed")

    def joined(edges):
        ends = [trees.select(F.col("thread_id").alias(e), F.col("tree").alias(t)) for e, t in (("src", "a"), ("dst", "b"))]
        return edges.join(ends[0], "src").join(ends[1], "dst").filter("a <> b").select("src", "dst", "w", F.lit(False).alias("sure"), "a", "b")

    edges = joined(materialise(_meet(packed, packed, spark.createDataFrame(list(held), "bi int, bj int"), _forest, "src string, dst string, w double"), "clusters-forest"))
    edges = materialise(edges, "clusters-joins")
    heaviest = spanning_tree(edges).agg(F.max("w")).first()[0]
    if heaviest is None:
        return materialise(sure.unionByName(edges), "clusters-edges"), 0.0

    sole = {r.blk: r.one for r in points.groupBy("blk").agg(F.min("tree").alias("one"), F.max("tree").alias("two")).filter("one = two").collect()}

    def others(batches):
        for pdf in batches:
            for i in pdf["id"].tolist():
                low, _ = balls.between(i)
                meets = np.flatnonzero((np.maximum(np.maximum(low, core[i]), core) < heaviest) & (np.arange(len(low)) > i) & (balls.count > 0))
                fresh = np.array([j for j in meets.tolist() if (i, j) not in held and (i not in sole or sole[i] != sole.get(j))], np.int32)
                if len(fresh):
                    yield pd.DataFrame({"bi": np.full(len(fresh), i, np.int32), "bj": fresh})

    pairs = materialise(spark.range(count).mapInPandas(others, "bi int, bj int"), "clusters-more-pairs")
    light = _packed(points.filter(F.col("core") < heaviest), "clusters-light")
    more = joined(materialise(_meet(light, light, pairs, _joins(heaviest), "src string, dst string, w double"), "clusters-forest"))
    every = len(live) * (len(live) + 1) / 2
    return materialise(sure.unionByName(edges).unionByName(more), "clusters-edges"), 1.0 - (pairs.count() + len(held)) / every
