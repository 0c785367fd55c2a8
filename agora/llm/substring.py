"""Substring dedup by fixed-block anchors: repeats of ``window`` words that an earlier document holds are removed.

Every document is cut into non-overlapping reference blocks of ``window // 2`` words, whose fingerprints form the
index; any window of a document holds one whole block of it. Every rolling block-wide window of every document probes
the index. Around each hit, on the probing and on the indexed side, all windows that hold it are extended to full
width and compared by fingerprint and smallest doc_id; overlapping hits make up the maximal repeats. Probes carry 40
bits besides their range, so a chance hit costs a comparison at full width and nothing else; a match at full width is
by 64 bits.

Defined results: a null or empty text has no words; rows that repeat a doc_id never remove each other's words; a null
doc_id counts as greater than every id; shorter documents keep all; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from agora.llm import packs
from agora.llm.common import BASES, U64, Spans, cover, word_hashes, word_spans


def _fives(x: np.ndarray) -> bytes:
    return (x & U64(0xFFFFFFFF)).astype("<u4").tobytes() + ((x >> U64(32)) & U64(0xFF)).astype(np.uint8).tobytes()


def _from_fives(b: bytes) -> np.ndarray:
    n = len(b) // 5
    return np.frombuffer(b, "<u4", n).astype(np.uint64) | (np.frombuffer(b, np.uint8, n, 4 * n).astype(np.uint64) << U64(32))


class Chunk:
    """A chunk's words, its rolling blocks and its index blocks."""

    def __init__(self, pdf: pd.DataFrame, window: int):
        self.window, self.block = window, window // 2
        self.pdf, self.ids, self.raw = packs.load(pdf)
        offs = np.concatenate([[0], np.cumsum([len(x) for x in self.raw])]).astype(np.int64)
        buf = np.frombuffer(b"".join(self.raw), np.uint8)
        starts, ends, self.first = word_spans(buf, offs)
        self.hashes = word_hashes(buf, starts, ends)
        self.n = len(self.hashes)
        self.doc = np.repeat(np.arange(len(self.raw)), np.diff(self.first))
        at = np.arange(max(self.n - self.block + 1, 0))
        self.at = at[at + self.block <= self.first[1:][self.doc[at]]]
        self.roll = Spans(self.hashes).of(self.at, self.at + self.block)
        self.probes, self.inv = np.unique(self.roll, return_inverse=True)
        aligned = (self.at - self.first[:-1][self.doc[self.at]]) % self.block == 0
        self.index = np.unique(self.roll[aligned])

    def windows(self, probe_hit: np.ndarray, index_hit: np.ndarray):
        """Starts of the windows around hits, their distinct prints, each start's print, and each print's least id."""
        hit = probe_hit.copy()
        hit[np.searchsorted(self.probes, self.index[index_hit])] = True
        # blocks of the index that several documents of this chunk hold
        order = np.argsort(self.inv, kind="stable")
        runs = np.searchsorted(self.inv[order], np.arange(len(self.probes) + 1))
        ids = self.ids[self.doc[self.at[order]]]
        several = ids[runs[:-1]] != ids[runs[1:] - 1] if len(self.probes) else np.zeros(0, bool)
        mine = np.searchsorted(self.probes, self.index)
        hit[mine[several[mine]]] = True
        near = np.zeros(self.n + 1, np.int32)
        near[self.at + 1] = hit[self.inv]
        near = np.cumsum(near)
        p = np.arange(max(self.n - self.window + 1, 0))
        p = p[p + self.window <= self.first[1:][self.doc[p]]]
        p = p[near[p + self.window - self.block + 1] > near[p]]
        prints, one, inv = np.unique(Spans(self.hashes, BASES[1]).of(p, p + self.window), return_index=True, return_inverse=True)
        return p, prints, inv, self.ids[self.doc[p[one]]]


def _send_blocks(window: int, ranges: int):
    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = Chunk(pdf, window)
        a, b = packs.cuts(c.probes, ranges), packs.cuts(c.index, ranges)
        rows = [(r, key[0], _fives(c.probes[a[r]:a[r + 1]]), _fives(c.index[b[r]:b[r + 1]])) for r in range(ranges) if a[r + 1] > a[r]]
        return pd.DataFrame(rows, columns=["range", "chunk", "probes", "index"])
    return run


def _match_blocks(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    chunks = pdf["chunk"].to_numpy()
    index = [_from_fives(x) for x in pdf["index"]]
    whose = np.repeat(chunks, [len(x) for x in index])
    blocks, inv = np.unique(np.concatenate(index), return_inverse=True)
    low, high = np.full(len(blocks), np.iinfo(np.int64).max), np.full(len(blocks), -1)
    np.minimum.at(low, inv, whose)
    np.maximum.at(high, inv, whose)
    probed, found = np.zeros(len(blocks), np.int64), []
    for c, b in zip(chunks, pdf["probes"]):
        x = _from_fives(b)
        at = np.minimum(np.searchsorted(blocks, x), max(len(blocks) - 1, 0))
        there = blocks[at] == x if len(blocks) else np.zeros(len(x), bool)
        probed[np.unique(at[there])] += 1
        found.append(packs.bits(there & ((low[at] != c) | (high[at] != c)) if len(blocks) else there))
    met = [packs.bits(probed[np.searchsorted(blocks, x)] > 1) for x in index]  # its own chunk probes it too
    return pd.DataFrame({"range": key[0], "chunk": chunks, "found": found, "met": met})


def _send_windows(window: int, ranges: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        rows = []
        if len(left):
            c = Chunk(left, window)
            _, prints, _, least = c.windows(packs.gather(right, "found", c.probes, ranges), packs.gather(right, "met", c.index, ranges))
            a = packs.cuts(prints, ranges)
            kind = "<i4" if not len(least) or -2 ** 31 <= least.min() and least.max() < 2 ** 31 else "<i8"
            rows = [(r, key[0], prints[a[r]:a[r + 1]].tobytes(), least[a[r]:a[r + 1]].astype(kind).tobytes()) for r in range(ranges) if a[r + 1] > a[r]]
        return pd.DataFrame(rows, columns=["range", "chunk", "prints", "least"])
    return run


def _match_windows(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
    prints = [np.frombuffer(x, "<u8") for x in pdf["prints"]]
    ids = [np.frombuffer(x, "<i4" if len(x) < len(p) * 8 else "<i8").astype(np.int64) for x, p in zip(pdf["least"], prints)]
    every, inv = np.unique(np.concatenate(prints), return_inverse=True)
    own = np.concatenate(ids)
    least = np.full(len(every), packs.NO_ID)
    np.minimum.at(least, inv, own)
    earlier = np.split(least[inv] < own, np.cumsum([len(x) for x in prints])[:-1])
    return pd.DataFrame({"range": key[0], "chunk": pdf["chunk"], "earlier": [packs.bits(x) for x in earlier]})


def _remove(window: int, ranges: int):
    def run(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        out = ["doc_id", "n_words", "n_removed", "kept_sha256"]
        if not len(left):
            return pd.DataFrame(columns=out)
        blocks, wide = right[right["kind"] == 1], right[right["kind"] == 2]
        c = Chunk(left, window)
        p, prints, inv, least = c.windows(packs.gather(blocks, "found", c.probes, ranges), packs.gather(blocks, "met", c.index, ranges))
        gone = packs.gather(wide, "earlier", prints, ranges)
        again = gone[inv] | (least[inv] < c.ids[c.doc[p]])
        drop = cover(p[again], window, c.n)
        removed = np.add.reduceat(np.append(drop, False).astype(np.int64), np.minimum(c.first[:-1], c.n))
        removed[np.diff(c.first) == 0] = 0
        sha = []
        for i, text in enumerate(c.raw):
            words = text.split()
            if removed[i]:
                words = [w for w, d in zip(words, drop[c.first[i]:c.first[i + 1]].tolist()) if not d]
            sha.append(hashlib.sha256(b" ".join(words)).hexdigest())
        return pd.DataFrame({"doc_id": c.pdf["doc_id"].to_numpy(), "n_words": np.diff(c.first), "n_removed": removed, "kept_sha256": sha})[out]
    return run


def remove_repeats(docs: DataFrame, window: int = 50) -> DataFrame:
    """doc_id, n_words, n_removed and the digest of the kept words, one row for each input row."""
    base, ranges = packs.chunked(docs)
    texts = base.groupBy("chunk")
    found = (texts.applyInPandas(_send_blocks(window, ranges), "range int, chunk int, probes binary, index binary")
             .groupBy("range").applyInPandas(_match_blocks, "range int, chunk int, found binary, met binary"))
    earlier = (texts.cogroup(found.groupBy("chunk")).applyInPandas(_send_windows(window, ranges), "range int, chunk int, prints binary, least binary")
               .groupBy("range").applyInPandas(_match_windows, "range int, chunk int, earlier binary"))
    replies = found.selectExpr("chunk", "range", "1 AS kind", "found", "met", "CAST(NULL AS binary) AS earlier").unionByName(
        earlier.selectExpr("chunk", "range", "2 AS kind", "CAST(NULL AS binary) AS found", "CAST(NULL AS binary) AS met", "earlier"))
    return texts.cogroup(replies.groupBy("chunk")).applyInPandas(_remove(window, ranges), "doc_id long, n_words long, n_removed long, kept_sha256 string")


def op6_substring(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP6_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
g AS (SELECT rid, doc_id, i, md5(array_to_string(ws[i:i + 49], ' ')) AS h FROM (SELECT rid, doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM d)),
f AS (SELECT rid, i FROM (SELECT rid, i, doc_id, min(doc_id) OVER (PARTITION BY h) AS least FROM g) WHERE least < coalesce(doc_id, 9223372036854775807)),
c AS (SELECT DISTINCT rid, unnest(range(i, i + 50)) AS p FROM f),
w AS (SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS p FROM d),
k AS (SELECT w.rid, count(c.p) AS n_removed, string_agg(word, ' ' ORDER BY w.p) FILTER (WHERE c.p IS NULL) AS kept FROM w LEFT JOIN c ON w.rid = c.rid AND w.p = c.p GROUP BY w.rid)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k ON d.rid = k.rid
"""
