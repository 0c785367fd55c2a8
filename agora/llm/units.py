"""Encoding by an installed tokenizer, unit by unit: a text is cut where no merge can reach across, and each distinct
unit of a batch is encoded once. The ids of a text are its units' ids, one after another."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def spread(flat: np.ndarray, lens: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The rows ``which`` of a ragged array (``flat``, with ``lens`` values a row), and where each begins (one more)."""
    begin = np.concatenate([[0], np.cumsum(lens)]).astype(np.int64)
    take = lens[which]
    at = np.concatenate([[0], np.cumsum(take)]).astype(np.int64)
    return flat[np.arange(at[-1]) - np.repeat(at[:-1] - begin[which], take)], at


def distinct(data: np.ndarray, offs: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The distinct strings among those that ``offs`` cuts from ``data``, and for each string which one it is."""
    column = pa.Array.from_buffers(pa.large_binary(), len(offs) - 1, [None, pa.py_buffer(np.ascontiguousarray(offs, np.int64)), pa.py_buffer(np.ascontiguousarray(data))])
    coded = column.dictionary_encode()
    return coded.dictionary, coded.indices.to_numpy().astype(np.int64)


def raw(units: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets (from 0) of a binary array."""
    offs = np.frombuffer(units.buffers()[1], np.int64)[units.offset:units.offset + len(units) + 1] if len(units) else np.zeros(1, np.int64)
    data = units.buffers()[2]
    return (np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8))[offs[0]:offs[-1]], offs - offs[0]


def ragged(lists: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    return (np.array([i for x in lists for i in x], np.uint32), np.fromiter(map(len, lists), np.int64, len(lists)))


def byte_level() -> dict[str, int]:
    """The characters that stand for bytes in byte-level vocabularies: visible Latin-1 for itself, the others from U+0100 on."""
    seen = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(seen)]
    return {**{chr(b): b for b in seen}, **{chr(256 + k): b for k, b in enumerate(rest)}}
