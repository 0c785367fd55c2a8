"""Exchange of fingerprints between chunks of documents and ranges of the fingerprint space, as packed arrays.

Rows are dealt by a hash into chunks of about ``CHUNK_BYTES`` of text. A chunk sorts its distinct fingerprints and
sends each range's slice as one binary value; the range compares the slices of all chunks and returns one bit for each
fingerprint, in the slice's order. So what a repeated passage costs is bounded by the number of chunks, not by the
documents that hold it, and a range's share is even whatever the texts hold.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import U64, text_key

CHUNK_BYTES, RANGE_BYTES = 4 << 20, 12 << 20
NO_ID = np.iinfo(np.int64).max


def chunked(docs: DataFrame) -> tuple[DataFrame, int]:
    """(chunk, doc_id, text) and the number of ranges; both counts follow the table's bytes."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(1, -(-total // CHUNK_BYTES))
    chunk = F.pmod(F.xxhash64("doc_id", text_key()), F.lit(n)).cast("int")
    return docs.select(chunk.alias("chunk"), "doc_id", "text"), max(1, -(-total // RANGE_BYTES))


def load(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, list[bytes]]:
    """The rows in a fixed order (by doc_id, null last, then text), their ids (null: the greatest), their bytes."""
    pdf = pdf.assign(text=pdf["text"].fillna(""), missing=pdf["doc_id"].isna())
    ids = pd.Series([NO_ID if m else int(i) for i, m in zip(pdf["doc_id"], pdf["missing"])], index=pdf.index, dtype="int64")
    pdf = pdf.assign(id=ids).sort_values(["missing", "id", "text"], kind="stable")
    return pdf, pdf["id"].to_numpy(), [t.encode() for t in pdf["text"]]


def cuts(prints: np.ndarray, ranges: int) -> np.ndarray:
    """Where each range begins in sorted prints (one more at the end): even splitters of the hash space."""
    where = ((prints >> U64(32)) * U64(ranges) >> U64(32)).astype(np.int64)
    return np.searchsorted(where, np.arange(ranges + 1))


def bits(flags: np.ndarray) -> bytes:
    return np.packbits(flags).tobytes()


def gather(replies: pd.DataFrame, column: str, prints: np.ndarray, ranges: int) -> np.ndarray:
    """The flags of sorted prints from the ranges' replies."""
    at, out = cuts(prints, ranges), np.zeros(len(prints), dtype=bool)
    for r, b in zip(replies["range"], replies[column]):
        a, z = at[r], at[r + 1]
        out[a:z] = np.unpackbits(np.frombuffer(b, np.uint8), count=z - a).astype(bool)
    return out
