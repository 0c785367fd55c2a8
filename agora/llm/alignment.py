"""Cross-tokenizer alignment: which tokens of vocabulary A and of vocabulary B cover the same bytes of a text.

A byte-level BPE (A, encoding a space and the text) and a SentencePiece BPE with byte fallback (B, which adds the space
itself) give two rising arrays of end offsets. The aligner walks them by diagonal run skipping: at the current index
shift it compares blocks of both arrays, doubling the block while all ends agree, so a stretch of one-to-one tokens
costs a few array comparisons; where they part, the two ends are advanced in turn until they meet again, which is one
irregular group, and the shift is what the indexes then differ by.

1. One pass encodes and aligns (each distinct unit of a batch is encoded once; units begin at spaces after visible
   ASCII, which no merge of either vocabulary crosses), and writes per document its figures and links, the links as
   places in the distinct id pairs of its chunk of about ``CHUNK`` bytes; per chunk the pairs and how often each occurs.
2. Pairs are counted over all chunks; each B id's highest count marks its best pairs.
3. Each chunk gets the counts of its own pairs and adds them up by document. A pair moves once a chunk, however
   frequent it is, and nothing is broadcast but the task's code.

Defined results: null and empty texts, and texts whose joined token bytes are not space + text on both sides, have no
tokens (zeros and ''); strings of special tokens are plain text; repeated rows are documents of their own and count;
null doc_ids stay; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import json
import os
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import cut, text_chunks
from agora.llm.units import byte_level, distinct, ragged, raw, spread

CHUNK, PROBE = 4 << 20, 16
#: Longer units are encoded by themselves.
LONG = 4096


class Side:
    """One tokenizer: (ids, their number) of units, the bytes of each id and how many they are."""

    def __init__(self, encode, tokens: list[bytes]):
        self.encode, self.tokens = encode, tokens
        self.lens = np.array([len(t) for t in tokens], np.int64)

    def with_encoder(self, make) -> Side:
        self.encode = make(self)
        return self


class ByteLevelIds:
    """Ids of units (each begins with a space) of a byte-level vocabulary. Its tokens are lossless, so many units are
    encoded as one text and parted by their bytes: by the faster rank encoder where the file's merges are its ranks and
    all code points are below U+0100 (whose classes every library knows alike), else by the file's own library."""

    def __init__(self, t, tokens: list[bytes], lens: np.ndarray, merges: list, vocabulary: dict[str, int]):
        self.t, self.lens, self.ranks = t, lens, None
        if all(vocabulary["".join(m if isinstance(m, list) else m.split(" "))] == 256 + k for k, m in enumerate(merges)):
            import tiktoken
            ranked = {tokens[i]: i for i in vocabulary.values()}
            self.ranks = tiktoken.Encoding("units", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranked, special_tokens={})

    def slow(self, text: str) -> list[int]:
        return self.t.encode(text, add_special_tokens=False).ids

    def joined(self, encode, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.array(encode(data.tobytes().decode()), np.uint32)
        return ids, np.diff(np.searchsorted(np.cumsum(self.lens[ids]), ends, "right"), prepend=0)

    def __call__(self, units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        data, offs = raw(units)
        n = np.diff(offs)
        if not len(n):
            return np.zeros(0, np.uint32), np.zeros(0, np.int64)
        last = data[offs[1:] - 1]
        wide = np.diff(np.concatenate([[0], np.cumsum(data >= 0xC4)])[offs]) > 0
        # white space at the end of a unit is split otherwise where something follows
        kind = np.where((last <= 0x20) | (last >= 0x7F) | (n > LONG), 2, np.where(wide | (self.ranks is None), 1, 0))
        flat, count, order = [], [], []
        for k, encode in ((0, self.ranks and self.ranks.encode_ordinary), (1, self.slow)):
            mine = np.flatnonzero(kind == k)
            if len(mine):
                ids, c = self.joined(encode, data[np.repeat(kind == k, n)], np.cumsum(n[mine]))
                flat.append(ids)
                count.append(c)
                order.append(mine)
        mine = np.flatnonzero(kind == 2)
        ids, c = ragged([self.slow(units[k].as_py().decode()) for k in mine.tolist()])
        flat, count, order = np.concatenate([*flat, ids]), np.concatenate([*count, c]), np.concatenate([*order, mine])
        place = np.empty(len(n), np.int64)
        place[order] = np.arange(len(n))
        return spread(flat, count, place)[0], count[place]


@cache
def side_a(path: str) -> Side:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer
    t, back = Tokenizer.from_file(path), byte_level()
    t.encode_special_tokens = True
    with open(path) as f:
        file = json.load(f)
    special = {x["id"] for x in file["added_tokens"]}
    tokens = [b""] * t.get_vocab_size()
    for piece, i in t.get_vocab().items():
        tokens[i] = piece.encode() if i in special else bytes(back[c] for c in piece)
    return Side(None, tokens).with_encoder(lambda s: ByteLevelIds(t, tokens, s.lens, file["model"]["merges"], file["model"]["vocab"]))


@cache
def side_b(path: str) -> Side:
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    pieces = [p.id_to_piece(i) for i in range(len(p))]
    if any("▁" in x.lstrip("▁") for x in pieces):
        raise ValueError("pieces that go on after a space: units cannot be encoded by themselves")
    tokens = [bytes([int(x[3:5], 16)]) if p.is_byte(i) else x.replace("▁", " ").encode() for i, x in enumerate(pieces)]
    return Side(lambda units: ragged(p.encode([u[1:].decode() for u in units.to_pylist()], num_threads=1)), tokens)


def align(ea: np.ndarray, eb: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each group, the number of A and of B tokens up to its end. Both arrays rise strictly to the same last end."""
    n, m = len(ea), len(eb)
    va, vb = memoryview(ea), memoryview(eb)
    i = j = 0
    runs: list[tuple[int, int, int]] = []
    while i < n:
        step = PROBE
        while True:
            k = min(step, n - i, m - j)
            same = ea[i:i + k] == eb[j:j + k]
            run = int(same.argmin()) if k else 0
            if k and same[run]:
                run = k
            if run:
                runs.append((i, j, run))
                i += run
                j += run
            if run < step:
                break
            step *= 2
        if i >= n:
            break
        x, y = va[i], vb[j]
        while x != y:
            if x < y:
                i += 1
                x = va[i]
            else:
                j += 1
                y = vb[j]
        runs.append((i, j, 1))
        i += 1
        j += 1
    a, b, count = np.array(runs, np.int64).reshape(-1, 3).T
    inside = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    return np.repeat(a, count) + inside + 1, np.repeat(b, count) + inside + 1


def unit_starts(buf: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where units begin: at each text (all begin with a space), and at spaces after visible ASCII, the last byte of a text left out."""
    at = np.zeros(len(buf) + 1, bool)
    at[1:-1] = (buf[1:] == 0x20) & (buf[:-1] > 0x20) & (buf[:-1] < 0x7F)
    at[offs[1:] - 1] = False
    at[offs] = True
    return np.flatnonzero(at)


class Chunk:
    """Tokens and groups of consecutive texts, each with a space before it."""

    def __init__(self, a: Side, b: Side, buf: np.ndarray, offs: np.ndarray):
        starts = unit_starts(buf, offs)
        units, which = distinct(buf, starts)
        first = np.searchsorted(starts, offs)
        data, unit_offs = raw(units)
        whole, good = data.tobytes(), np.ones(len(units), bool)
        sides = []
        for s in (a, b):
            ids, count = s.encode(units)
            ends = np.concatenate([[0], np.cumsum(s.lens[ids])])[np.concatenate([[0], np.cumsum(count)])]
            joined = b"".join(map(s.tokens.__getitem__, ids.tolist()))
            if joined != whole or (ends != unit_offs).any():
                good &= np.fromiter((joined[x:y] == u for x, y, u in zip(ends[:-1].tolist(), ends[1:].tolist(), units.to_pylist())), bool, len(units))
            ids, at = spread(ids, count, which)
            sides.append([s, ids, at[first]])
        bad = np.concatenate([[0], np.cumsum(~good[which])])[first]
        self.keep = np.diff(offs) > 1
        for k in np.flatnonzero(np.diff(bad) > 0):
            text = buf[offs[k]:offs[k + 1]].tobytes()
            self.keep[k] &= all(b"".join(map(s.tokens.__getitem__, ids[at[k]:at[k + 1]].tolist())) == text for s, ids, at in sides)
        self.ids, self.at = [], []
        ends = []
        for s, ids, at in sides:
            count = np.where(self.keep, np.diff(at), 0)
            ids = ids[np.repeat(self.keep, np.diff(at))]
            self.ids.append(ids)
            self.at.append(np.concatenate([[0], np.cumsum(count)]))
            ends.append(np.cumsum(s.lens[ids]))
        self.ga, self.gb = align(*ends)
        self.groups = np.searchsorted(self.ga, self.at[0], "right")

    def links(self, width: int) -> np.ndarray:
        """The id pairs whose tokens end together, as id of A * width + id of B."""
        return self.ids[0][self.ga - 1].astype(np.int64) * width + self.ids[1][self.gb - 1]

    def written(self, names: list[str]) -> list[str]:
        """The groups of each text as `a1,a2|b1;a3|b2,b3`; ``names`` as of :func:`joints`."""
        x, y = np.diff(self.ga, prepend=0), np.diff(self.gb, prepend=0)
        a, b = (len(i) for i in self.ids)
        size_a = (len(names) >> 1) - self.width_b
        first_a, first_b = np.zeros(a, bool), np.zeros(b, bool)
        first_a[self.ga - x] = True
        first_b[self.gb - y] = True
        order = np.empty(a + b, np.int64)
        order[np.arange(a) + np.repeat(self.gb - y, x)] = self.ids[0].astype(np.int64) + np.where(first_a, 0, size_a)
        order[np.arange(b) + np.repeat(self.ga, y)] = self.ids[1].astype(np.int64) + 2 * size_a + np.where(first_b, 0, self.width_b)
        at = self.at[0] + self.at[1]
        return ["".join(map(names.__getitem__, order[p:q].tolist()))[1:] for p, q in zip(at[:-1].tolist(), at[1:].tolist())]

    width_b = 0


@cache
def joints(size_a: int, size_b: int) -> list[str]:
    """Each id with the sign before it: A first in its group and not, B first and not."""
    return [sign + str(i) for sign, size in ((";", size_a), (",", size_a), ("|", size_b), (",", size_b)) for i in range(size)]


def chunks_of(batch: pa.RecordBatch, a: Side, b: Side):
    """(first row, end row, chunk) of a batch whose second column is the text."""
    text = batch.column(1)
    text = pc.binary_join_element_wise(pa.scalar(" ", text.type), text.fill_null(""), pa.scalar("", text.type))
    for i, j, buf, offs in text_chunks(pa.RecordBatch.from_arrays([text], ["text"]), limit=CHUNK):
        c = Chunk(a, b, buf, offs)
        c.width_b = len(b.tokens)
        yield i, j, c


def align_texts(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, a and b (the ids), a_ends and b_ends (for each group, how many of them lie before its end)."""
    def run(batches):
        a, b = side_a(path_a), side_b(path_b)
        for batch in batches:
            for i, j, c in chunks_of(batch, a, b):
                lists = [pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids.astype(np.int32))) for ids, at in zip(c.ids, c.at)]
                for g, at in ((c.ga, c.at[0]), (c.gb, c.at[1])):
                    own = g - np.repeat(at[:-1], np.diff(c.groups))
                    lists.append(pa.ListArray.from_arrays(pa.array(c.groups, pa.int32()), pa.array(own.astype(np.int32))))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), *lists], names=["doc_id", "a", "b", "a_ends", "b_ends"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, a array<int>, b array<int>, a_ends array<int>, b_ends array<int>")


def _written(path_a: str, path_b: str):
    names = ["chunk", "doc_id", "n_a", "n_b", "n_groups", "groups_sha256", "links", "pairs", "times"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches):
        a, b = side_a(path_a), side_b(path_b)
        signs = joints(len(a.tokens), len(b.tokens))
        chunk = TaskContext.get().partitionId() << 32
        for batch in batches:
            for i, j, c in chunks_of(batch, a, b):
                chunk += 1
                coded = pa.array(c.links(len(b.tokens))).dictionary_encode()
                place = coded.indices.to_numpy()
                times = np.bincount(place, minlength=len(coded.dictionary)).astype(np.int64)
                raw = place.astype("<u2" if len(times) <= 1 << 16 else "<u4")
                at = c.groups.tolist()
                sha = [hashlib.sha256(t.encode()).hexdigest() if t else "" for t in c.written(signs)]
                n = j - i
                own = [pa.array([chunk] * n), batch.column(0).slice(i, n), *(pa.array(np.diff(x)) for x in (*c.at, c.groups)), pa.array(sha),
                       pa.array([raw[x:y].tobytes() for x, y in zip(at[:-1], at[1:])], pa.binary()), pa.nulls(n, kinds[7]), pa.nulls(n, kinds[8])]
                yield pa.RecordBatch.from_arrays(own, names=names)
                if len(times):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([chunk]), *(pa.nulls(1, k) for k in kinds[1:7]), pa.array([coded.dictionary.to_pylist()], kinds[7]), pa.array([times.tolist()], kinds[8])], names=names)
    return run


def _add_up(key: tuple, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
    n, best = np.zeros(len(right), np.int64), np.zeros(len(right), np.int64)
    place = right["place"].to_numpy()
    n[place], best[place] = right["n"].to_numpy(), right["best"].to_numpy()
    raw = left["links"].tolist()
    at = np.concatenate([[0], np.cumsum(left["n_groups"].to_numpy())]).astype(np.int64)
    links = np.frombuffer(b"".join(raw), "<u2" if len(right) <= 1 << 16 else "<u4")
    out = left.drop(columns=["chunk", "links"])
    out["n_links"] = out["n_groups"]
    for name, values in (("n_best", best), ("count_sum", n)):
        sums = np.concatenate([[0], np.cumsum(values[links])]) if len(right) else np.zeros(len(links) + 1, np.int64)
        out[name] = np.diff(sums[at])
    return out


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256, one row for each input row."""
    size_b = len(side_b(path_b).tokens)
    table = cut(docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(
        _written(path_a, path_b), "chunk long, doc_id long, n_a long, n_b long, n_groups long, groups_sha256 string, links binary, pairs array<long>, times array<long>"), "alignment")
    pairs = (table.filter("pairs IS NOT NULL").select("chunk", F.posexplode(F.arrays_zip("pairs", "times")))
             .select("chunk", F.col("pos").alias("place"), F.col("col.pairs").alias("pair"), F.col("col.times").alias("times")))
    counts = cut(pairs.groupBy("pair").agg(F.sum("times").alias("n")).withColumn("b", F.col("pair") % size_b), "alignment-pairs")
    highest = counts.groupBy("b").agg(F.max("n").alias("most"))
    counts = counts.join(highest, "b").select("pair", "n", (F.col("n") == F.col("most")).cast("long").alias("best"))
    answers = pairs.join(counts, "pair").select(F.col("chunk").alias("owner"), "place", "n", "best")
    rows = table.filter("n_a IS NOT NULL").drop("pairs", "times")
    return rows.groupBy("chunk").cogroup(answers.groupBy("owner")).applyInPandas(
        _add_up, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string")


def op13_alignment(spark, sf_dir: str) -> DataFrame:
    return aligned(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
