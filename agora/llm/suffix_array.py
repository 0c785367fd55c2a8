"""Suffix dedup of bytes: every byte under a ``width``-byte string that also starts anywhere else is removed.

A dense suffix array holds a suffix for every byte. Here suffixes are sampled by content: of the starts in a
``width``-byte string the one whose leading ``LEAD`` bytes have the least fingerprint is its anchor, so equal strings
have equal anchors at equal offsets, about one for every (width - LEAD) / 2 bytes. The strings with one anchor begin in
one run of starts; the run and what follows is the anchor's segment.

1. An anchored suffix is a string of three 64-bit tokens: its first 8 bytes, the fingerprint of its ``LEAD`` leading
   bytes, and that of its whole segment. A chunk of documents sends each distinct one once. Splitters are quantiles of
   a sample of suffixes (``PER_RANGE`` for each range, at byte positions spread evenly over all texts), so ranges of
   leading bytes are even however the texts are distributed. A range sorts its suffixes by multikey quicksort and
   compares neighbours: equal ones are repeats as a whole; an anchor that leads several different segments leaves them
   open, one that leads a single segment is settled.
2. Equal suffixes share a range, but an anchor with very many segments may lie across boundaries. Each range therefore
   reports what it saw of its first and its last anchor; these reports are added up by anchor, and the sums, joined
   back, decide on the anchors at the edges.
3. For open segments (and one copy of each repeated segment beside them) all suffixes of the segment, cut at ``width``
   bytes, are compared once more, in even ranges of their fingerprints.

Segments and strings are compared by 64-bit fingerprints (segments under one anchor by 128). The splitters are at most
``MAX_RANGES`` - 1 triples (6 MiB); a larger table has larger ranges, at 100 TB about 2.8 million suffixes each.

Defined results: null texts are empty; matches never cross documents; rows that repeat are documents of their own, so
an equal long row is removed in both; shorter texts keep all; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm import packs
from agora.llm.common import BASES, BYTE, U64, Spans, cover, mix, text_key

LEAD = 128
PIECE, PLACE = 1 << 20, 24
MAX_RANGES, PER_RANGE = 1 << 18, 64
SMALL = 1 << 12
TOKENS = ("head", "lead", "body")


def multikey_sort(tokens: list[np.ndarray]) -> np.ndarray:
    """The order of strings given token by token, by three-way partition around a pivot: what equals the pivot goes on
    with the next token. Up to ``SMALL`` strings are sorted at once."""
    order = np.arange(len(tokens[0]))
    todo = [(0, len(order), 0)]
    while todo:
        lo, hi, depth = todo.pop()
        if hi - lo < 2 or depth == len(tokens):
            continue
        part = order[lo:hi]
        if hi - lo <= SMALL:
            order[lo:hi] = part[np.lexsort([t[part] for t in reversed(tokens[depth:])])]
            continue
        x = tokens[depth][part]
        few = np.sort(x[::len(x) // 33 + 1])
        pivot = few[len(few) // 2]
        less, more = x < pivot, x > pivot
        order[lo:hi] = np.concatenate([part[less], part[~(less | more)], part[more]])
        a, b = lo + int(less.sum()), hi - int(more.sum())
        todo += [(lo, a, depth), (a, b, depth + 1), (b, hi, depth)]
    return order


def range_of(tokens: list[np.ndarray], splitters: np.ndarray) -> np.ndarray:
    """How many splitters (one a row) are not above each string."""
    lo, hi = np.zeros(len(tokens[0]), np.int64), np.full(len(tokens[0]), len(splitters), np.int64)
    while (lo < hi).any():
        mid = (lo + hi) // 2
        at = splitters[np.minimum(mid, len(splitters) - 1)]
        above, level = np.zeros(len(lo), bool), np.ones(len(lo), bool)
        for k, t in enumerate(tokens):
            above |= level & (at[:, k] > t)
            level &= at[:, k] == t
        go, live = ~above, lo < hi
        lo, hi = np.where(live & go, mid + 1, lo), np.where(live & ~go, mid, hi)
    return lo


def slices(where: np.ndarray) -> list[tuple[int, int, int]]:
    """(range, first, end) of the runs of a sorted array of ranges."""
    first = np.flatnonzero(np.concatenate([[True], where[1:] != where[:-1]])[:len(where)])
    return list(zip(where[first].tolist(), first.tolist(), np.append(first[1:], len(where)).tolist()))


def sliding_least(x: np.ndarray, width: int) -> np.ndarray:
    """The minimum of each ``width`` consecutive values, from minima of prefixes and suffixes of blocks."""
    n = len(x)
    if n < width:
        return x[:0]
    padded = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = x
    rows = padded.reshape(-1, width)
    left = np.minimum.accumulate(rows, axis=1).ravel()
    right = np.minimum.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[:n - width + 1], left[width - 1:n])


class Part:
    """Some whole documents, or a slice of one: its segments (first and last start, both included) and their prints."""

    def __init__(self, buf: np.ndarray, offs: np.ndarray, width: int, lead: int):
        n = len(buf)
        self.at = np.zeros(0, np.int64)
        self.low = self.high = self.at
        self.head = self.lead = self.body = np.zeros(0, np.uint64)
        if n < width:
            return
        values = BYTE[buf]
        lead_of = Spans(values).of(np.arange(n - lead + 1), np.arange(lead, n + 1))
        ranked = (lead_of >> U64(PLACE) << U64(PLACE)) | np.arange(len(lead_of), dtype=np.uint64)
        anchor = (sliding_least(ranked, width - lead + 1) & U64((1 << PLACE) - 1)).astype(np.int64)
        ends = np.repeat(offs[1:], np.diff(offs))[:len(anchor)]
        p = np.flatnonzero(np.arange(len(anchor)) + width <= ends)
        if not len(p):
            return
        a = anchor[p]
        new = np.concatenate([[True], (np.diff(a) != 0) | (np.diff(p) != 1)])
        first = np.flatnonzero(new)
        self.low, self.high = p[first], p[np.append(first[1:], len(p)) - 1]
        self.lead = lead_of[a[first]]
        self.head = buf[a[first][:, None] + np.arange(8)].view(">u8").ravel().astype(np.uint64)
        self.spans = Spans(values, BASES[1])
        self.body = mix(self.spans.of(self.low, self.high + width) + (a[first] - self.low).astype(np.uint64))


class Chunk:
    def __init__(self, pdf: pd.DataFrame, width: int, lead: int = LEAD):
        self.width = width
        self.pdf, self.ids, self.raw = packs.load(pdf)
        self.parts, group, size = [], [], 0
        for i, text in enumerate(self.raw):
            if len(text) > PIECE:
                for at in range(0, len(text) - width + 1, PIECE):
                    self._add([i], text[at:at + PIECE + width - 1], [0], at, lead)
                continue
            group.append(i)
            size += len(text)
            if size >= PIECE:
                self._add(group, *self._join(group), 0, lead)
                group, size = [], 0
        if group:
            self._add(group, *self._join(group), 0, lead)
        # segments of the chunk: (part, row in part) in order, and the distinct suffixes
        tokens = [np.concatenate([getattr(p, k) for _, _, _, p in self.parts] or [np.zeros(0, np.uint64)]) for k in TOKENS]
        order = multikey_sort(tokens)
        tokens = [t[order] for t in tokens]
        new = np.zeros(len(order), bool)
        new[:1] = True
        for t in tokens:
            new[1:] |= t[1:] != t[:-1]
        self.tokens = [t[new] for t in tokens]
        which = np.cumsum(new) - 1
        self.inv = np.empty(len(order), np.int64)
        self.inv[order] = which
        self.times = np.bincount(which, minlength=int(new.sum()))

    def _join(self, group):
        return b"".join(self.raw[i] for i in group), np.concatenate([[0], np.cumsum([len(self.raw[i]) for i in group])])

    def _add(self, rows, text, offs, start, lead):
        offs = np.asarray(offs if len(offs) > 1 else [0, len(text)], np.int64)
        self.parts.append((rows, offs, start, Part(np.frombuffer(text, np.uint8), offs, self.width, lead)))

    def windows(self, chosen: np.ndarray):
        """All strings in the segments of the chosen pairs: part by part their starts and prints."""
        upto = 0
        for n, (_, _, _, part) in enumerate(self.parts):
            mine = chosen[self.inv[upto:upto + len(part.low)]]
            upto += len(part.low)
            low, count = part.low[mine], (part.high - part.low + 1)[mine]
            p = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]) if len(low) else low, count) + np.arange(count.sum())
            yield n, p, part.spans.of(p, p + self.width) if len(p) else np.zeros(0, np.uint64)


def _flagged(prints: np.ndarray) -> np.ndarray:
    """Distinct prints, 63 bits, with the lowest bit set where there are two or more."""
    u, times = np.unique(prints | U64(1), return_counts=True)
    return u - (times < 2).astype(np.uint64)


def _sampled(width: int, lead: int):
    """The suffixes at sampled positions: ``at`` is the place in a snippet that holds the whole segment around it."""
    def run(frames):
        for pdf in frames:
            out = []
            for text, at in zip(pdf["snippet"], pdf["at"]):
                p = Part(np.frombuffer(text, np.uint8), np.asarray([0, len(text)]), width, lead)
                i = int(np.searchsorted(p.low, at, "right")) - 1
                if i >= 0 and p.high[i] >= at:
                    out.append([getattr(p, k)[i] for k in TOKENS])
            yield pd.DataFrame(np.asarray(out, np.uint64).reshape(-1, len(TOKENS)).view(np.int64), columns=list(TOKENS))
    return run


def sampled_splitters(docs: DataFrame, width: int, ranges: int) -> np.ndarray:
    """Quantiles of a sample of about ``PER_RANGE`` suffixes for each range, one splitter a row."""
    most = min(ranges, MAX_RANGES)
    if most < 2:
        return np.zeros((0, len(TOKENS)), np.uint64)
    step, gap = max(1, packs.RANGE_BYTES * ranges // (most * PER_RANGE)), width - LEAD + 1
    size = F.octet_length("text").cast("long")
    at = F.pmod(F.xxhash64("doc_id", text_key()), F.lit(step))
    places = docs.filter(size > at).select(F.col("text").cast("binary").alias("text"), F.explode(F.sequence(at, size - 1, F.lit(step).cast("long"))).alias("p"))
    snippets = places.select(F.expr(f"substring(text, CAST(greatest(p - {gap}, 0) AS int) + 1, CAST(least(p, {gap}) AS int) + {gap + width})").alias("snippet"),
                             F.least("p", F.lit(gap)).alias("at"))
    sample = snippets.mapInPandas(_sampled(width, LEAD), ", ".join(f"{k} long" for k in TOKENS)).toPandas()
    tokens = [sample[k].to_numpy(np.int64).view(np.uint64) for k in TOKENS]
    if not len(sample):
        return np.zeros((0, len(TOKENS)), np.uint64)
    order = multikey_sort(tokens)
    return np.column_stack(tokens)[order[np.arange(1, most) * len(order) // most]]


def _send_segments(width: int, splitters: np.ndarray):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(pdf, width)
        rows = [(r, key[0], *(t[a:z].tobytes() for t in c.tokens), packs.bits(c.times[a:z] > 1)) for r, a, z in slices(range_of(c.tokens, splitters))]
        return pd.DataFrame(rows, columns=["range", "chunk", *TOKENS, "twice"])
    return run


FOUND = "range int, chunk int, repeated binary, open binary, n_first int, n_last int, side int, head long, lead long, kinds long, fresh long"


def _match_segments(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """For each chunk bits for its suffixes (repeated as a whole; to be compared string by string) and how many of them
    belong to the first and the last anchor of the range, whose open bits hold only if the anchor is open. With a null
    chunk, the two reports on these anchors: their kinds of segments and those found once."""
    parts = [[np.frombuffer(x, "<u8") for x in pdf[k]] for k in TOKENS]
    lens = [len(x) for x in parts[0]]
    twice = np.concatenate([np.unpackbits(np.frombuffer(b, np.uint8), count=n) for b, n in zip(pdf["twice"], lens)])
    tokens = [*map(np.concatenate, parts)]
    order = multikey_sort(tokens)
    h, k, b = (t[order] for t in tokens)
    new_key = np.concatenate([[True], (h[1:] != h[:-1]) | (k[1:] != k[:-1])])
    new = new_key | np.concatenate([[True], b[1:] != b[:-1]])
    pair, anchor = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    times = np.bincount(pair, weights=1 + twice[order])
    repeated = (times >= 2)[pair]
    kinds, fresh = np.bincount(anchor[new]), np.bincount(anchor[new], weights=(times < 2))
    # nothing is open where all segments of an anchor are repeated as a whole
    mixed = (kinds > 1) & (fresh > 0)
    mixed[0] = mixed[-1] = True
    open_ = mixed[anchor] & (~repeated | new)
    out = np.zeros((4, len(k)), bool)
    for row, flags in zip(out, (repeated, open_, anchor == 0, anchor == anchor[-1])):
        row[order] = flags
    repeated, open_, first, last = (np.split(x, np.cumsum(lens)[:-1]) for x in out)
    bits = pd.DataFrame({"range": key[0], "chunk": pdf["chunk"].to_numpy(), "repeated": [*map(packs.bits, repeated)], "open": [*map(packs.bits, open_)],
                         "n_first": [int(x.sum()) for x in first], "n_last": [int(x.sum()) for x in last]})
    edges = [0] if anchor[-1] == 0 else [0, -1]
    reports = pd.DataFrame({"range": key[0], "side": edges, "head": [h[e] for e in edges], "lead": [k[e] for e in edges],
                            "kinds": kinds[edges], "fresh": fresh[edges].astype(np.int64)})
    reports[["head", "lead"]] = reports[["head", "lead"]].to_numpy(np.uint64).view(np.int64)
    reports["side"] = reports["side"].abs()
    return pd.concat([bits, reports]).reindex(columns=[x.split()[0] for x in FOUND.split(", ")])


def decided(found: DataFrame) -> DataFrame:
    """(range, chunk, repeated, open, n_first, n_last, first_open, last_open): reports on an anchor added up over all
    ranges that hold it, and joined to the answers of these ranges."""
    reports = found.filter("chunk IS NULL").select("range", "side", "head", "lead", "kinds", "fresh")
    sums = reports.groupBy("head", "lead").agg((F.sum("kinds") > 1).alias("several"), (F.sum("fresh") > 0).alias("some"))
    sides = reports.join(sums, ["head", "lead"]).select("range", "side", (F.col("several") & F.col("some")).alias("mixed"))
    edge = sides.groupBy("range").agg(F.max(F.when(F.col("side") == 0, F.col("mixed"))).alias("first_open"), F.max(F.when(F.col("side") == 1, F.col("mixed"))).alias("last_open"))
    return found.filter("chunk IS NOT NULL").select("range", "chunk", "repeated", "open", "n_first", "n_last").join(edge, "range")


def answers(replies: pd.DataFrame, c: Chunk, splitters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which suffixes of the chunk are repeated, and which are open."""
    n = len(c.tokens[0])
    repeated, open_ = np.zeros(n, bool), np.zeros(n, bool)
    place = {r: (a, z) for r, a, z in slices(range_of(c.tokens, splitters))}
    for x in replies.itertuples():
        a, z = place[x.range]
        repeated[a:z] = np.unpackbits(np.frombuffer(x.repeated, np.uint8), count=z - a)
        mine = np.unpackbits(np.frombuffer(x.open, np.uint8), count=z - a).astype(bool)
        n_first, n_last = int(x.n_first), int(x.n_last)
        if not x.first_open:
            mine[:n_first] = False
        # a range with one anchor reports it as its first
        if n_last and not pd.isna(x.last_open) and not x.last_open:
            mine[-n_last:] = False
        open_[a:z] = mine
    return repeated, open_


def _open_prints(c: Chunk, chosen: np.ndarray) -> np.ndarray:
    return _flagged(np.concatenate([x for _, _, x in c.windows(chosen)] or [np.zeros(0, np.uint64)]))


def _send_strings(width: int, ranges: int, splitters: np.ndarray):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left):
            c = Chunk(left, width)
            # a repeated segment stands for its copies: its strings count twice
            repeated, chosen = answers(right, c, splitters)
            u = _open_prints(c, chosen & ~repeated)
            more = _open_prints(c, chosen & repeated) | U64(1)
            u = np.unique(np.concatenate([u, more]))
            u = u[np.append((u[1:] >> U64(1)) != (u[:-1] >> U64(1)), True)] if len(u) else u
            a = packs.cuts(u, ranges)
            rows = [(r, key[0], u[a[r]:a[r + 1]].tobytes()) for r in range(ranges) if a[r + 1] > a[r]]
        return pd.DataFrame(rows, columns=["range", "chunk", "prints"])
    return run


def _match_strings(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    """The prints of each chunk that are found twice."""
    own = [np.frombuffer(x, "<u8") for x in pdf["prints"]]
    every = np.concatenate(own)
    u, inv = np.unique(every >> U64(1), return_inverse=True)
    times = np.bincount(inv, weights=1 + (every & U64(1)))
    again = np.split((times >= 2)[inv], np.cumsum([len(x) for x in own])[:-1])
    return pd.DataFrame({"chunk": pdf["chunk"], "again": [(x[y] >> U64(1)).tobytes() for x, y in zip(own, again)]})


def _remove(width: int, splitters: np.ndarray):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
        if not len(left):
            return pd.DataFrame(columns=out)
        c = Chunk(left, width)
        segments, strings = right[right["kind"] == 1], right[right["kind"] == 2]
        repeated, _ = answers(segments, c, splitters)
        again = np.sort(np.concatenate([np.frombuffer(x, "<u8") for x in strings["again"]] or [np.zeros(0, np.uint64)]))
        starts: list[list[np.ndarray]] = [[] for _ in c.raw]
        for chosen, whole in ((repeated, True), (~repeated, False)):
            if not whole and not len(again):
                continue
            for n, p, prints in c.windows(chosen):
                if not whole:
                    at = np.minimum(np.searchsorted(again, prints >> U64(1)), len(again) - 1)
                    p = p[again[at] == prints >> U64(1)]
                rows, offs, start, _ = c.parts[n]
                who = np.searchsorted(offs, p, "right") - 1
                cut = np.searchsorted(who, np.arange(len(rows) + 1))
                for i, row in enumerate(rows):
                    if cut[i + 1] > cut[i]:
                        starts[row].append(p[cut[i]:cut[i + 1]] - offs[i] + start)
        removed, spans, sha = [], [], []
        for text, s in zip(c.raw, starts):
            if s:
                drop = cover(np.concatenate(s), width, len(text))
                removed.append(int(drop.sum()))
                spans.append(int(drop[0]) + int((drop[1:] & ~drop[:-1]).sum()))
                text = np.frombuffer(text, np.uint8)[~drop].tobytes()
            else:
                removed.append(0)
                spans.append(0)
            sha.append(hashlib.sha256(text).hexdigest())
        return pd.DataFrame({"doc_id": c.pdf["doc_id"].to_numpy(), "n_bytes": [len(x) for x in c.raw], "n_removed": removed, "n_spans": spans, "kept_sha256": sha})[out]
    return run


def remove_repeated_bytes(docs: DataFrame, width: int = 400) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans and the digest of the kept bytes, one row for each input row."""
    if width <= LEAD:
        raise ValueError(f"width must be over {LEAD}")
    base, ranges = packs.chunked(docs)
    splitters = sampled_splitters(docs, width, ranges)
    texts = base.groupBy("chunk")
    columns = ", ".join(["range int", "chunk int", *(f"{k} binary" for k in TOKENS), "twice binary"])
    found = decided(texts.applyInPandas(_send_segments(width, splitters), columns).groupBy("range").applyInPandas(_match_segments, FOUND))
    strings = (texts.cogroup(found.groupBy("chunk")).applyInPandas(_send_strings(width, ranges, splitters), "range int, chunk int, prints binary")
               .groupBy("range").applyInPandas(_match_strings, "chunk int, again binary"))
    replies = found.withColumns({"kind": F.lit(1), "again": F.lit(None).cast("binary")}).unionByName(strings.withColumn("kind", F.lit(2)), allowMissingColumns=True)
    return texts.cogroup(replies.groupBy("chunk")).applyInPandas(
        _remove(width, splitters), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_array(spark, sf_dir: str) -> DataFrame:
    return remove_repeated_bytes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
