"""Line dedup: line hashes go to ranges of the hash space, each range is sorted by hash, document and position and
streamed once, and what comes back is a compressed keep bitmap per document, never text.

Two rules: ``first`` keeps the first occurrence (by doc_id, then position) of each key; ``frequent`` drops every
line whose key is found in ``min_docs`` documents or more. A key is the line without whitespace at its ends, A-Z
lower-cased. Defined results: a null or empty text is one empty line; keys of fewer than ``min_chars`` code points are
always kept; rows with a null doc_id count as one document each text; rows that repeat doc_id and text share one
bitmap; other columns pass through untouched.

Hot keys (over 1/1000 of all lines, so at most 1000 of them) are resolved by aggregates that combine before the
shuffle, and sent to the rows as a broadcast of that bounded list; only the other keys travel through the ranges.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import cut, own_prefix, partitions, text_key

HOT_SHARE = 1000


def _explode(min_chars: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, keys = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            h, d, k, pos = [], [], [], []
            for i, text in enumerate(batch.column(2).cast(pa.large_binary())):
                text = text.as_py()
                if not text:
                    continue
                for p, line in enumerate(text.lower().split(b"\n")):
                    line = line.strip()
                    if len(line) >= min_chars and (len(line) >= 4 * min_chars or len(line.decode("utf-8", "replace")) >= min_chars):
                        h.append(xxhash.xxh3_128_digest(line))
                        d.append(ids[i])
                        k.append(keys[i])
                        pos.append(p)
                if len(h) >= 50_000:
                    yield _lines(h, d, k, pos)
                    h, d, k, pos = [], [], [], []
            if h:
                yield _lines(h, d, k, pos)
    return run


def _lines(h, d, k, pos) -> pa.RecordBatch:
    top = np.frombuffer(b"".join(x[:2] for x in h), dtype=">u2").astype(np.int32)
    return pa.RecordBatch.from_arrays(
        [pa.array(h, pa.binary()), pa.array(top), pa.array(d, pa.int64()), pa.array(k, pa.int64()), pa.array(pos, pa.int32())],
        names=["h", "top", "doc_id", "tk", "pos"])


def _stream(rule: str, min_docs: int):
    """Over one sorted range: the rows to drop. A key may cross batches; its state is a few values."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, docs, last, held = None, 0, None, []
        out = ([], [], [])

        def flush():
            r = pa.RecordBatch.from_arrays([pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=["doc_id", "tk", "pos"])
            for x in out:
                x.clear()
            return r

        def drop(row):
            for x, v in zip(out, row):
                x.append(v)

        for batch in batches:
            for h, d, k, p in zip(*(batch.column(i).to_pylist() for i in range(4))):
                if h != key:
                    key, docs, last, held = h, 0, None, []
                    if rule == "first":
                        last = (d, k, p)
                        continue
                if rule == "first":
                    if (d, k, p) != last:  # an equal row is the same line of a repeated row
                        drop((d, k, p))
                    continue
                who = d if d is not None else (k,)
                if who != last:
                    docs, last = docs + 1, who
                if docs >= min_docs:
                    for row in held:
                        drop(row)
                    held = []
                    drop((d, k, p))
                else:
                    held.append((d, k, p))  # rows of fewer than min_docs documents
                if len(out[0]) >= 50_000:
                    yield flush()
        if out[0]:
            yield flush()
    return run


def _bitmaps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        maps = []
        for pos in batch.column(2).to_pylist():
            bits = np.zeros(max(pos) + 1, dtype=bool)
            bits[pos] = True
            maps.append(zlib.compress(np.packbits(bits).tobytes(), 1))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(maps, pa.binary())], names=["doc_id", "tk", "dropped"])


def line_bitmaps(docs: DataFrame, rule: str = "first", min_docs: int = 10, min_chars: int = 1) -> DataFrame:
    """(doc_id, tk, dropped): zlib-compressed bitmap of the lines to drop, for documents that lose any."""
    lines = cut(docs.select("doc_id", text_key().alias("tk"), "text")
                .mapInArrow(_explode(min_chars), "h binary, top int, doc_id long, tk long, pos int"), "lines")
    n = partitions(docs.sparkSession)
    total = lines.count()
    hot = cut(lines.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > max(min_docs * 10, total // HOT_SHARE)).select("h"), "hot")
    hot_rows = lines.join(F.broadcast(hot), "h")  # at most HOT_SHARE keys
    if rule == "first":
        best = hot_rows.groupBy("h").agg(F.min(F.struct("doc_id", "tk", "pos")).alias("best"))
        hot_drop = hot_rows.join(F.broadcast(best), "h").filter(F.struct("doc_id", "tk", "pos") != F.col("best"))
    else:
        who = F.when(F.col("doc_id").isNull(), F.col("tk"))
        wide = (hot_rows.groupBy("h", "doc_id", who.alias("who")).agg(F.lit(1)).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
                .filter(F.col("n") >= min_docs).select("h"))
        hot_drop = hot_rows.join(F.broadcast(wide), "h")
    cold = (lines.join(F.broadcast(hot), "h", "left_anti")
            .withColumn("range", (F.col("top") * F.lit(n) / F.lit(65536)).cast("int")).repartitionById(n, "range")
            .select("h", "doc_id", "tk", "pos").sortWithinPartitions("h", "doc_id", "tk", "pos")
            .mapInArrow(_stream(rule, min_docs), "doc_id long, tk long, pos int"))
    return (cold.unionByName(hot_drop.select("doc_id", "tk", "pos")).groupBy("doc_id", "tk")
            .agg(F.collect_set("pos").alias("pos")).mapInArrow(_bitmaps, "doc_id long, tk long, dropped binary"))


def kept_lines(text: bytes | None, dropped: bytes | None) -> tuple[list[bytes], int]:
    """The kept lines and the number of all lines."""
    lines = (text or b"").split(b"\n")
    if dropped is None:
        return lines, len(lines)
    bits = np.unpackbits(np.frombuffer(zlib.decompress(dropped), dtype=np.uint8))[:len(lines)].tolist()
    bits += [0] * (len(lines) - len(bits))
    return [x for x, b in zip(lines, bits) if not b], len(lines)


def _with_bitmaps(docs: DataFrame, bitmaps: DataFrame) -> tuple[DataFrame, str]:
    p = own_prefix(docs)
    keyed = docs.withColumn(f"{p}tk", text_key())
    b = bitmaps.select(F.col("doc_id").alias(f"{p}id"), F.col("tk").alias(f"{p}bk"), F.col("dropped").alias(f"{p}dropped"))
    both = keyed.join(b, F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}tk") == F.col(f"{p}bk")), "left")
    return both, f"{p}dropped"


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        total, gone, sha = [], [], []
        for text, dropped in zip(batch.column(1).cast(pa.large_binary()), batch.column(2)):
            kept, n = kept_lines(text.as_py(), dropped.as_py())
            total.append(n)
            gone.append(n - len(kept))
            sha.append(hashlib.sha256(b"\n".join(kept)).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, pa.int64()), pa.array(gone, pa.int64()), pa.array(sha)],
                                         names=["doc_id", "n_lines", "n_dropped", "kept_sha256"])


def dedup_digest(docs: DataFrame, **rule) -> DataFrame:
    """doc_id, n_lines, n_dropped and the digest of the kept lines, one row for each input row."""
    both, dropped = _with_bitmaps(docs.select("doc_id", "text"), line_bitmaps(docs, **rule))
    return both.select("doc_id", "text", dropped).mapInArrow(_digest, "doc_id long, n_lines long, n_dropped long, kept_sha256 string")


def _apply(text, dropped):
    import pandas as pd
    return pd.Series([t if d is None else b"\n".join(kept_lines(t.encode(), d)[0]).decode() for t, d in zip(text, dropped)], dtype=object)


def drop_lines(docs: DataFrame, **rule) -> DataFrame:
    """``docs`` with the dropped lines taken out of text (a text that loses none stays as it is, null included)."""
    both, dropped = _with_bitmaps(docs, line_bitmaps(docs, **rule))
    new = F.when(F.col(dropped).isNull(), F.col("text")).otherwise(F.pandas_udf(_apply, "string")("text", dropped))
    return both.withColumn("text", new).select(*docs.columns)


def op9_line_dedup(spark, sf_dir: str) -> DataFrame:
    return dedup_digest(spark.read.parquet(f"{sf_dir}/documents.parquet"), rule="frequent", min_docs=10, min_chars=1)


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
l AS (SELECT rid, doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM d),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\x20\x09-\x0D]+', ''), '[\x20\x09-\x0D]+$', ''),
  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f ON k.key = f.key)
SELECT doc_id, count(*) AS n_lines, sum(gone::INT)::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id
"""
