"""Shared by the operators: written intermediates, partition counts and array work on UTF-8 buffers."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from agora.session import ensure_checkpoint_dir

U64 = np.uint64
#: A word is a run of bytes outside this class; the same class in Java's and DuckDB's regex syntax.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, dtype=bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def cut(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet under the shared checkpoint folder and read it back: lineage ends in files that
    every executor can read, so lost executors cost no recomputation, and several branches read it."""
    path = f"{ensure_checkpoint_dir(df.sparkSession).rstrip('/')}/llm-{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def own_prefix(df: DataFrame) -> str:
    """A prefix that no column of ``df`` begins with, for columns that are added and taken away again."""
    p = "__"
    while any(c.startswith(p) for c in df.columns):
        p += "_"
    return p


def text_key():
    """Rows are told apart by doc_id and this: repeated doc_ids keep their own texts, equal rows share decisions."""
    return F.xxhash64(F.col("text"), F.col("text").isNull())


# ------------------------------------------------------------------ UTF-8 buffers

def text_chunks(batch: pa.RecordBatch, name: str = "text", limit: int = 2 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of consecutive rows, about ``limit`` bytes at a time; null: empty."""
    col = batch.column(batch.schema.get_field_index(name))
    if col.null_count:
        col = col.fill_null("")
    col = col.cast(pa.large_string()) if not pa.types.is_large_string(col.type) else col
    n = len(col)
    offs = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset:col.offset + n + 1] if n else np.zeros(1, np.int64)
    data = np.frombuffer(col.buffers()[2], dtype=np.uint8) if n and col.buffers()[2] is not None and col.buffers()[2].size else np.zeros(0, np.uint8)
    i = 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + limit, "right")) - 1)
        j = min(j, n)
        yield i, j, data[offs[i]:offs[j]], offs[i:j + 1] - offs[i]
        i = j


def word_spans(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words, and for each row the index of its first word (one more at the end)."""
    if not len(buf):
        e = np.zeros(0, np.int64)
        return e, e, np.zeros(len(offs), np.int64)
    inside = ~SPACE[buf]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    edge = offs[1:-1]
    a, b = edge[edge < len(buf)], edge[edge > 0]
    first[a] = inside[a]
    last[b - 1] = inside[b - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


_rng = np.random.Generator(np.random.PCG64(20240501))
#: A random 64-bit value for each byte.
BYTE = _rng.integers(0, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}
BASES = (0x9E3779B97F4A7C15, 0xD1342543DE82EF95)


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U64(31))
    x = x * U64(0x7FB5D329728EA185)
    x = x ^ (x >> U64(27))
    x = x * U64(0x81DADEF4BC2DD44D)
    return x ^ (x >> U64(33))


def _powers(n: int, base: int) -> tuple[np.ndarray, np.ndarray]:
    have = _POWERS.get(base)
    if have is None or len(have[0]) < n:
        n = max(n, 1 << 16)
        out = []
        for b in (base, pow(base, -1, 1 << 64)):
            p = np.full(n, b, dtype=np.uint64)
            p[0] = 1
            out.append(np.multiply.accumulate(p))
        have = _POWERS[base] = tuple(out)
    return have


class Spans:
    """Fingerprints mod 2**64 of any ranges of a sequence of 64-bit values (a polynomial in an odd base)."""

    def __init__(self, values: np.ndarray, base: int = BASES[0]):
        n = len(values)
        self.pw, self.inv = _powers(n + 1, base)
        self.sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(values * self.pw[:n], out=self.sums[1:])

    def of(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inv[starts])


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return Spans(BYTE[buf]).of(starts, ends)


def cover(starts: np.ndarray, width: int, n: int) -> np.ndarray:
    """Which of n positions lie in [s, s + width) for one of the starts."""
    d = np.zeros(n + 1, dtype=np.int32)
    np.add.at(d, starts, 1)
    np.add.at(d, np.minimum(starts + width, n), -1)
    return np.cumsum(d[:n]) > 0
