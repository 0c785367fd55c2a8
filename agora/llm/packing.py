"""Mixture-controlled packing: documents queue by source, and deficit round-robin over the queues fills windows of
``window`` tokens to target token proportions.

In every round a source earns a quantum, its share of the window, and sends the packets (up to ``grain`` tokens of one
document) that its deficit pays for; what is left of the deficit is carried on. A packet that ends at token C of its
queue is sent in round ceil(C / quantum), because earned less sent is the deficit. So the rounds of all packets are
known once the queues' prefix sums are, and a range of rounds is a partition: each source's deficit at its start is
(rounds before) * quantum - (tokens sent before), which the packets carry in their queue positions. A partition orders
its packets by round, source and queue and cuts the stream, whose position is the sum of the partitions before, into
windows; a window may begin in one partition and end in the next.

1. Rows are dealt to shards by a hash of doc_id and text, sorted, encoded once and written as runs of up to ``RUN`` ids.
2. Prefix sums of shard totals, in two levels, give each run its place in its source's queue.
3. Packet lengths alone give the tokens of each range of rounds, then the packets move there with their ids.

The queue order is by hash and doc_id, whatever the partitions of the input; results are equal in every run.

Defined results: a null text is empty (its document is the end id alone); a null source is a source of its own; without
weights a source's share is its share of all tokens, so every queue lasts to the end; with weights, queues that run dry
leave their share to the others in proportion; sources that the weights lack get none of the share while others queue
(weight 0) and come last; the last tokens, fewer than a window, are cut into sequences of powers of two, so nothing is
padded; repeated rows are documents of their own; null doc_ids stay; an empty table gives no rows; other columns of the
input are not read.
"""

from __future__ import annotations

import os
import zlib
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import public_tokenizers
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import SPACE, cut, text_chunks, text_key, word_spans
from agora.llm.units import byte_level, distinct, ragged, spread
from agora.session import broadcast_if_small

SHARD_BYTES, RUN, ROUNDS, SUPER = 16 << 20, 1 << 15, 512, 1024
#: Shards are at least so many, so that small tables are spread too.
SHARDS = 2048
#: A worker remembers the ids of so many pieces, of so many bytes in all; others are encoded again in each batch.
MEMORY, MEMORY_BYTES = 1 << 18, 8 << 20
#: Rounds of sources that have no weight begin here.
LAST = 1 << 60


#: What a byte is to the vocabulary's pre-tokenizing rule: 1 letter, 2 digit, 3 other visible sign, 0 left to the library.
KIND = np.zeros(256, np.uint8)
KIND[0x21:0x7F] = 3
KIND[[ord("'"), ord("<")]] = 0
KIND[ord("0"):ord("9") + 1] = 2
KIND[[*range(ord("A"), ord("Z") + 1), *range(ord("a"), ord("z") + 1)]] = 1


def kinds(data: np.ndarray) -> np.ndarray:
    """The kind of each byte; letters of U+00C0 to U+00FF (C3 and a second byte, but for the signs U+00D7, U+00F7) too."""
    out = KIND[data]
    lead = np.flatnonzero(data[:-1] == 0xC3)
    lead = lead[(data[lead + 1] != 0x97) & (data[lead + 1] != 0xB7)]
    out[lead] = out[lead + 1] = 1
    return out


class WordIds:
    """Ids of words (runs without white space, which the vocabulary's rules drop and never merge across). Words of plain
    letters, digits and signs are lower-cased and cut into the rule's pieces here, so that each distinct piece meets the
    merges once; words with anything else (apostrophes, other scripts, special tokens) go to the library as they are.
    The ids of a bounded number of pieces are kept from batch to batch (a plain piece never has the bytes of such a word)."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        self.t = Tokenizer.from_file(path)
        self.spelled = {b: c for c, b in byte_level().items()}
        self.known, self.flat, self.lens = pa.array([], pa.large_binary()), np.zeros(0, np.uint32), np.zeros(0, np.int64)

    def plain(self, piece: str) -> list[int]:
        return [x.id for x in self.t.model.tokenize(piece.translate(self.spelled))]

    def ids_of(self, pieces: pa.Array, odd: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids and lengths of some pieces, and for each of ``pieces`` which one it is there."""
        place = pc.index_in(pieces, value_set=self.known).fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = np.flatnonzero(place < 0)
        new = pieces.take(pa.array(fresh))
        flat, lens = ragged([self.t.encode(p.decode(), add_special_tokens=False).ids if o else self.plain(p.decode("latin-1"))
                             for p, o in zip(new.to_pylist(), odd[fresh].tolist())])
        place[fresh] = len(self.lens) + np.arange(len(fresh))
        flat, lens = np.concatenate([self.flat, flat]), np.concatenate([self.lens, lens])
        new = new.take(pa.array(np.arange(min(len(new), MEMORY - len(self.known)))))
        if len(new) and self.known.nbytes + new.nbytes <= MEMORY_BYTES:
            self.known = pa.concat_arrays([self.known, new])
            self.lens = lens[:len(self.known)]
            self.flat = flat[:self.lens.sum()]
        return flat, lens, place

    def __call__(self, data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the words that ``offs`` cuts from ``data``, and where each word's ids begin (one more at the end)."""
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(offs), np.int64)
        kind = kinds(data)
        strange = np.diff(np.concatenate([[0], np.cumsum(kind == 0)])[offs]) > 0
        strange_bytes = np.repeat(strange, np.diff(offs))
        begin = ~strange_bytes & (kind == 2)
        begin[1:] |= ~strange_bytes[1:] & (kind[1:] != kind[:-1])
        begin[offs[:-1]] = True
        upper = ~strange_bytes & (((data >= 0x41) & (data <= 0x5A)) | ((data >= 0x80) & (data <= 0x9E)))
        data = np.where(upper, data + np.uint8(0x20), data)
        at = np.append(np.flatnonzero(begin), len(data))
        pieces, which = distinct(data, at)
        odd = np.zeros(len(pieces), bool)
        odd[which[strange_bytes[at[:-1]]]] = True
        flat, lens, place = self.ids_of(pieces, odd)
        ids, ends = spread(flat, lens, place[which])
        return ids, ends[np.searchsorted(at, offs)]


@cache
def word_ids(path: str) -> WordIds:
    return WordIds(path)


def prefix_sums(df: DataFrame, keys: list[str], at: str, n: str, out: str) -> DataFrame:
    """``df`` (one row for each keys and ``at``) with the sum of ``n`` over smaller ``at``: within groups of ``SUPER``
    consecutive values and over the groups, so no window holds more than one group or one row a group."""
    df = df.withColumn("_g", F.floor(F.col(at) / SUPER))
    groups = df.groupBy(*keys, "_g").agg(F.sum(n).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_g").rowsBetween(Window.unboundedPreceding, -1)
    groups = groups.select(*keys, "_g", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys, "_g").orderBy(at).rowsBetween(Window.unboundedPreceding, -1)
    return (df.withColumn("_in", F.coalesce(F.sum(n).over(inside), F.lit(0))).join(groups, [*keys, "_g"])
            .withColumn(out, F.col("_in") + F.col("_before")).drop("_g", "_in", "_before"))


def encoded_runs(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    """shard, queue (the source), doc_id, doc_tokens, start, n, ids (little-endian uint16 or uint32), local: the tokens
    of the queue before the run within the shard; written once."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(SHARDS, -(-total // SHARD_BYTES))
    rows = docs.select(F.pmod(F.xxhash64("doc_id", text_key()), F.lit(shards)).cast("int").alias("shard"),
                       F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("queue"),
                       F.col("doc_id").cast("long").alias("doc_id"), "text", text_key().alias("key"))
    rows = rows.repartition("shard").sortWithinPartitions("shard", "queue", "doc_id", "key")

    def run(batches):
        encoder = word_ids(path)
        last, upto = None, 0
        for batch in batches:
            places = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            for i, j, buf, offs in text_chunks(batch, limit=4 << 20):
                starts, ends, first = word_spans(buf, offs)
                ids, at = encoder(buf[~SPACE[buf]], np.concatenate([[0], np.cumsum(ends - starts)]))
                at = at[first]
                out = []
                for k in range(i, j):
                    mine = np.append(ids[at[k - i]:at[k - i + 1]], np.uint32(end_id)).astype(kind)
                    if places[k] != last:
                        last, upto = places[k], 0
                    for s in range(0, len(mine), RUN):
                        part = mine[s:s + RUN]
                        out.append((k, len(mine), s, len(part), part.tobytes(), upto))
                        upto += len(part)
                which, *columns = zip(*out)
                which = pa.array(which)
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(c).take(which) for c in range(3)), *(pa.array(c, pa.int64()) for c in columns[:3]), pa.array(columns[3], pa.binary()),
                     pa.array(columns[4], pa.int64())], names=["shard", "queue", "doc_id", "doc_tokens", "start", "n", "ids", "local"])

    from tokenizers import Tokenizer
    kind = "<u2" if max(Tokenizer.from_file(path).get_vocab_size(), end_id + 1) <= 1 << 16 else "<u4"
    out = rows.mapInArrow(run, "shard int, queue string, doc_id long, doc_tokens long, start long, n long, ids binary, local long")
    return cut(out.withColumn("width", F.lit(2 if kind == "<u2" else 4)), "packing-runs")


def tail_bounds(total: int, window: int) -> np.ndarray:
    """Where the sequences after the last full window begin: powers of two, falling."""
    at, out = total - total % window, []
    for p in range((total % window).bit_length() - 1, -1, -1):
        if total % window >> p & 1:
            out.append(at)
            at += 1 << p
    return np.array([*out, total], np.int64)


def _cut_windows(window: int, total: int, digest: bool):
    tail = tail_bounds(total, window)

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.iloc[np.lexsort((pdf["place"], pdf["queue"], pdf["round"]))]
        n, start = pdf["n"].to_numpy(), pdf["start"].to_numpy()
        ids = np.frombuffer(b"".join(pdf["ids"]), "<u2" if pdf["width"].iat[0] == 2 else "<u4").astype("<u4")
        at = np.concatenate([[0], np.cumsum(n)])
        base = int(pdf["before"].iat[0])
        # packets that go on where the one before ended are one piece; then pieces are cut at the windows
        fresh = np.concatenate([[True], (start[1:] != start[:-1] + n[:-1]) | (np.diff(pdf["place"].to_numpy()) != n[:-1]) | (pdf["queue"].to_numpy()[1:] != pdf["queue"].to_numpy()[:-1])])
        first = np.flatnonzero(fresh)
        low, high = base, base + int(at[-1])
        bounds = np.concatenate([np.arange(low - low % window, min(high, tail[0]) + 1, window), tail])
        cuts = np.unique(np.concatenate([at[first], bounds[(bounds > low) & (bounds < high)] - low, [at[-1]]]))
        a, b = cuts[:-1], cuts[1:]
        piece = first[np.searchsorted(at[first], a, "right") - 1]
        where = a + low
        full = where < tail[0]
        k = np.searchsorted(tail, where, "right") - 1
        sequence = np.where(full, where // window, tail[0] // window + k)
        offset = np.where(full, where % window, where - tail[np.maximum(k, 0)])
        out = pdf.iloc[piece][["doc_id", "doc_tokens", "queue", "round"]].reset_index(drop=True)
        out["start"], out["length"], out["sequence_id"], out["offset"] = start[piece] + a - at[piece], b - a, sequence, offset
        out["source"] = out["queue"].where(out["queue"] != "n").str[1:].astype(object).where(out["queue"] != "n", None)
        if digest:
            raw = memoryview(ids.tobytes())
            out["ids_crc32"] = [zlib.crc32(raw[4 * x:4 * y]) for x, y in zip(a.tolist(), b.tolist())]
        else:
            out["ids"] = [ids[x:y].astype(np.int32) for x, y in zip(a, b)]
        return out.drop(columns="queue")
    return run


def pack(docs: DataFrame, path: str, window: int = 2048, grain: int = 128, end_id: int = 1, weights: DataFrame | None = None, digest: bool = False) -> DataFrame:
    """One row for each piece of a document: doc_id, doc_tokens, start, length, sequence_id, offset, source, round (the
    first one of its packets), and ids, or with ``digest`` their ids_crc32. ``weights`` (source, weight) sets the target
    proportions; without it they are the sources' shares of all tokens."""
    if window < 1 or grain < 1 or RUN % grain:
        raise ValueError(f"window must be positive, grain a divisor of {RUN}")
    runs = encoded_runs(docs, path, end_id)
    shares = runs.groupBy("queue", "shard").agg(F.sum("n").alias("n"))
    totals = shares.groupBy("queue").agg(F.sum("n").alias("tokens"))
    total = totals.agg(F.sum("tokens")).first()[0] or 0
    if weights is None:
        totals = totals.withColumn("quantum", F.col("tokens") * (window / max(total, 1)))
    else:
        w = weights.groupBy(F.coalesce(F.concat(F.lit("s"), F.col("source").cast("string")), F.lit("n")).alias("queue")).agg(F.sum("weight").alias("weight")).filter("weight > 0")
        full = w.join(totals, "queue", "left_semi").agg(F.sum("weight")).first()[0] or 1.0
        totals = totals.join(w, "queue", "left").withColumn("quantum", F.coalesce(F.col("weight") * (window / full), F.lit(0.0)))
    places = cut(prefix_sums(shares, ["queue"], "shard", "n", "base").join(totals, "queue").select("queue", "shard", "base", "quantum"), "packing-queues")
    placed = runs.join(broadcast_if_small(places), ["queue", "shard"])
    end = F.col("base") + F.col("local") + F.least(F.col("p") + grain, F.col("n"))
    turn = F.when(F.col("quantum") > 0, F.ceil(end / F.col("quantum"))).otherwise(F.lit(LAST) + F.floor(end / window))
    packets = (placed.withColumn("p", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(grain)))).withColumn("round", turn.cast("long"))
               .withColumn("part", F.floor(F.col("round") / ROUNDS)).withColumn("size", F.least(F.lit(grain), F.col("n") - F.col("p"))))
    parts = packets.groupBy("part").agg(F.sum("size").alias("size"))
    before = cut(prefix_sums(parts.withColumn("all", F.lit(0)), ["all"], "part", "size", "before").select("part", "before"), "packing-parts")
    moved = packets.select("part", "queue", "round", (F.col("base") + F.col("local") + F.col("p")).alias("place"), "doc_id", "doc_tokens", (F.col("start") + F.col("p")).alias("start"),
                           F.col("size").alias("n"), F.expr(f"substring(ids, cast(p * width + 1 as int), {grain} * width)").alias("ids"), "width")
    ids = "ids_crc32 long" if digest else "ids array<int>"
    return moved.join(broadcast_if_small(before), "part").groupBy("part").applyInPandas(
        _cut_windows(window, total, digest), f"doc_id long, doc_tokens long, round long, start long, length long, sequence_id long, offset long, source string, {ids}")


def op12_packing(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), public_tokenizers.path("word_bpe_49k.json"), digest=True).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "source")
