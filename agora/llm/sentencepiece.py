"""SentencePiece encoding and decoding: the best path of a unigram model over a double-array trie of pieces.

The text gets a whitespace marker in front, and every space is the marker. Among all ways to cut it into pieces the
one with the greatest sum of log scores is taken; a character without a piece of its own costs the least score less 10
and falls back to its UTF-8 bytes. No piece has a marker after another character, so the text falls into units (markers,
then other characters) that are solved apart; equal units of a run of about ``RUN`` bytes are solved once, many at a time over
arrays, and units of over ``LONG`` bytes one by one. Decoding joins the pieces, turns markers to spaces, puts byte
pieces together and drops the marker in front.

The vocabulary comes from a tokenizer's file whose path is a parameter; the driver reads it and broadcasts its bounded
arrays. Vocabularies whose file gives merge ranks get log probabilities by Zipf's law over these ranks (``scores``).

Defined results: null and empty texts have no ids and decode to an empty text; a literal marker (U+2581) is
indistinguishable from a space, as in any SentencePiece model; ids outside the vocabulary and control ids decode to
nothing; byte pieces that are not UTF-8 decode to U+FFFD.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, IntegerType, StringType, StructField, StructType

from agora.llm.common import BASES, BYTE, Spans

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
LONG = 48
RUN = 1 << 20
MARK = "▁".encode()
CHAR = np.ones(256, dtype=np.int64)
CHAR[0xC0:0xE0], CHAR[0xE0:0xF0], CHAR[0xF0:] = 2, 3, 4


class Model(NamedTuple):
    base: np.ndarray      # double array: the child of s by byte b is base[s] + b where check is s
    check: np.ndarray
    value: np.ndarray     # id of the piece that ends in a state, or -1
    score: np.ndarray     # by id
    unknown: float
    byte_id: np.ndarray   # by byte
    bytes_of: np.ndarray  # the pieces' bytes (a space for a marker) ...
    at: np.ndarray        # ... and where each id's begin, one more at the end
    longest: int


def double_array(pieces: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    trie: list[dict[int, int]] = [{}]
    end = [-1]
    for p, i in pieces.items():
        s = 0
        for b in p:
            if b not in trie[s]:
                trie[s][b] = len(trie)
                trie.append({})
                end.append(-1)
            s = trie[s][b]
        end[s] = i
    used, base, check, value = bytearray(256), [0] * 256, [0] + [-1] * 255, [end[0]] + [-1] * 255
    place, todo, single, several, top = {0: 0}, [0], 256, 256, 256
    while todo:
        node = todo.pop()
        kids = sorted(trie[node])
        if not kids:
            continue
        # an only child takes the first free cell; brothers are tried near the last ones, else at the end
        while single < len(used) and used[single]:
            single += 1
        b = max((single if len(kids) == 1 else several) - kids[0], 0)
        tries = 0
        while True:
            tries += 1
            if tries == 16 and len(kids) > 1:
                b = max(b, top - kids[0])
            if b + 256 > len(used):
                more = len(used)
                used += bytes(more + 256)
                for cells, empty in ((base, 0), (check, -1), (value, -1)):
                    cells += [empty] * (len(used) - len(cells))
            if not any(used[b + c] for c in kids) and b + kids[0] > 0:
                break
            b += 1
        if len(kids) > 1:
            several = b + kids[0]
        top = max(top, b + kids[-1] + 1)
        s = place[node]
        base[s] = b
        for c in kids:
            used[b + c], check[b + c], value[b + c] = 1, s, end[trie[node][c]]
            place[trie[node][c]] = b + c
            todo.append(trie[node][c])
    used[0] = 1
    last = max(i for i in range(len(used)) if used[i]) + 512
    cells = []
    for x, empty in ((base, 0), (check, -1), (value, -1)):
        cells.append(np.array(x[:last] + [empty] * (last - len(x)), dtype=np.int32))
    return tuple(cells)


def make_model(pieces: list[tuple[str, float, str]]) -> Model:
    """From (piece, log score, kind) by id; kind: normal, byte or control (which text never gives)."""
    normal = {p.replace("▁", " ").encode(): i for i, (p, _, kind) in enumerate(pieces) if kind == "normal"}
    if any(b" " in p.lstrip(b" ") for p in normal):
        raise ValueError("a piece has a marker after another character")
    byte_id = np.full(256, -1, np.int32)
    raw = []
    for i, (p, _, kind) in enumerate(pieces):
        raw.append(p.replace("▁", " ").encode() if kind == "normal" else bytes([int(p[3:5], 16)]) if kind == "byte" else b"")
        if kind == "byte":
            byte_id[raw[-1][0]] = i
    if (byte_id < 0).any():
        raise ValueError("byte fallback needs a piece for every byte")
    score = np.array([s for _, s, _ in pieces])
    least = min(s for _, s, kind in pieces if kind == "normal")
    return Model(*double_array(normal), score, least - 10.0, byte_id, np.frombuffer(b"".join(raw), np.uint8),
                 np.concatenate([[0], np.cumsum([len(x) for x in raw])]), max(map(len, normal)))


def read_pieces(path: str = VOCABULARY, scores: str = "zipf") -> list[tuple[str, float, str]]:
    """``scores``: "file" as they are, "zipf" by the rank of the file's scores."""
    import sentencepiece
    p = sentencepiece.SentencePieceProcessor(model_file=path)
    n = p.get_piece_size()
    kinds = ["byte" if p.is_byte(i) else "control" if p.is_control(i) or p.is_unknown(i) or p.is_unused(i) else "normal" for i in range(n)]
    value = [p.get_score(i) for i in range(n)]
    if scores == "zipf":
        normal = sorted((i for i in range(n) if kinds[i] == "normal"), key=lambda i: (-value[i], i))
        norm = math.log(sum(1 / r for r in range(1, len(normal) + 1)))
        for r, i in enumerate(normal, 1):
            value[i] = -math.log(r) - norm
    return [(p.id_to_piece(i), value[i], kinds[i]) for i in range(n)]


def _one(m: Model, unit: bytes) -> list[int]:
    n = len(unit)
    best, back, tok = [-math.inf] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    base, check, value, score = m.base, m.check, m.value, m.score
    for i in range(n):
        if best[i] == -math.inf:
            continue
        s, width, single = 0, min(int(CHAR[unit[i]]), n - i), False
        for j in range(i, min(n, i + m.longest)):
            t = int(base[s]) + unit[j]
            if check[t] != s:
                break
            s = t
            v = int(value[s])
            if v >= 0:
                single |= j + 1 - i == width
                x = best[i] + score[v]
                if x > best[j + 1]:
                    best[j + 1], back[j + 1], tok[j + 1] = x, i, v
        if not single and best[i] + m.unknown > best[i + width]:
            best[i + width], back[i + width], tok[i + width] = best[i] + m.unknown, i, -1
    out, e = [], n
    while e:
        if tok[e] >= 0:
            out.append(tok[e])
        else:
            out += [int(m.byte_id[b]) for b in reversed(unit[back[e]:e])]
        e = back[e]
    return out[::-1]


def _many(m: Model, grid: np.ndarray, lens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """grid: position x unit. The ids of all units in order, and how many each has."""
    width, n = grid.shape
    best, back, tok = np.full((width + 1, n), -np.inf), np.zeros((width + 1, n), np.int32), np.full((width + 1, n), -1, np.int32)
    best[0] = 0.0
    for i in range(width):
        rows = np.flatnonzero((best[i] > -np.inf) & (lens > i))
        if not len(rows):
            continue
        begin, state = rows, np.zeros(len(rows), np.int32)
        step = np.minimum(CHAR[grid[i, rows]], lens[rows] - i)
        single = np.zeros(n, bool)
        chars = np.zeros(n, np.int64)
        chars[rows] = step
        for j in range(i, min(width, i + m.longest)):
            nxt = m.base[state] + grid[j, rows]
            ok = (m.check[nxt] == state) & (lens[rows] > j)
            rows, state = rows[ok], nxt[ok]
            if not len(rows):
                break
            v = m.value[state]
            hit = v >= 0
            if hit.any():
                r, v = rows[hit], v[hit]
                single[r[chars[r] == j + 1 - i]] = True
                x = best[i, r] + m.score[v]
                up = x > best[j + 1, r]
                r = r[up]
                best[j + 1, r], back[j + 1, r], tok[j + 1, r] = x[up], i, v[up]
        lone = ~single[begin]
        r, e = begin[lone], i + step[lone]
        x = best[i, r] + m.unknown
        up = x > best[e, r]
        r, e = r[up], e[up]
        best[e, r], back[e, r], tok[e, r] = x[up], i, -1
    ends, who, ids, pos = lens.copy(), [], [], []
    live = np.flatnonzero(ends > 0)
    while len(live):
        e = ends[live]
        t, b = tok[e, live], back[e, live]
        plain = t >= 0
        who.append(live[plain])
        ids.append(t[plain])
        pos.append(b[plain])
        for k in range(4):  # the bytes of a character without a piece
            more = np.flatnonzero(~plain & (b + k < e))
            who.append(live[more])
            ids.append(m.byte_id[grid[b[more] + k, live[more]]])
            pos.append(b[more] + k)
        ends[live] = b
        live = live[b > 0]
    who, ids, pos = np.concatenate(who), np.concatenate(ids), np.concatenate(pos)
    return ids[np.lexsort((pos, who))], np.bincount(who, minlength=n)


def _units(m: Model, buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all units in order, and how many each has; equal units are solved once."""
    h = Spans(BYTE[buf]).of(start, end)
    keys, at, inv = np.unique(h, return_index=True, return_inverse=True)
    lens = (end - start)[at]
    counts = np.zeros(len(keys), np.int64)
    order = np.argsort(lens, kind="stable")
    short = order[:np.searchsorted(lens[order], LONG, "right")]
    flat, place, total = [], np.zeros(len(keys), np.int64), 0
    for k in range(0, len(short), 16384):
        u = short[k:k + 16384]
        width = int(lens[u].max())
        grid = buf[np.minimum(start[at[u]][None, :] + np.arange(width)[:, None], len(buf) - 1)]
        x, c = _many(m, grid, lens[u])
        counts[u] = c
        place[u] = total + np.cumsum(c) - c
        total += len(x)
        flat.append(x)
    for u in order[len(short):]:
        x = _one(m, buf[start[at[u]]:end[at[u]]].tobytes())
        counts[u], place[u] = len(x), total
        total += len(x)
        flat.append(np.array(x, np.int32))
    flat = np.concatenate(flat)
    c = counts[inv]
    upto = np.cumsum(c)
    return flat[np.repeat(place[inv] - upto + c, c) + np.arange(upto[-1])].astype(np.int32), c


def encode_texts(m: Model, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all texts in order, and where each text's begin (one more at the end).

    Units are solved apart, so also a long text is worked off in runs of units of about ``RUN`` bytes."""
    raw = [b" " + t.replace(MARK, b" ") if t else b"" for t in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    buf = np.frombuffer(b"".join(raw), np.uint8)
    if not len(buf):
        return np.zeros(0, np.int32), np.zeros(len(texts) + 1, np.int64)
    first = buf == 32
    first[1:] &= buf[:-1] != 32
    first[offs[:-1][np.diff(offs) > 0]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(buf))
    ids, counts, i = [], [], 0
    while i < len(start):
        j = max(i + 1, int(np.searchsorted(start, start[i] + RUN)))
        x, c = _units(m, buf[start[i]:end[j - 1]], start[i:j] - start[i], end[i:j] - start[i])
        ids.append(x)
        counts.append(c)
        i = j
    upto = np.concatenate([[0], np.cumsum(np.concatenate(counts))])
    return np.concatenate(ids), upto[np.searchsorted(start, offs)]


def decode_ids(m: Model, ids: np.ndarray, at: np.ndarray) -> list[str]:
    ids = np.where((ids < 0) | (ids >= len(m.at) - 1), 0, ids)
    lens = m.at[ids + 1] - m.at[ids]
    upto = np.concatenate([[0], np.cumsum(lens)])
    raw = m.bytes_of[np.repeat(m.at[ids] - upto[:-1], lens) + np.arange(upto[-1])].tobytes()
    ends = upto[at]
    return [raw[a + (raw[a:a + 1] == b" "):b].decode("utf-8", "replace") for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


def _parts(column: pa.Array, limit: int) -> Iterator[tuple[int, list[bytes]]]:
    i, held, size = 0, [], 0
    for x in column:
        x = x.as_py() or b""
        held.append(x)
        size += len(x)
        if size >= limit:
            yield i, held
            i, held, size = i + len(held), [], 0
    if held:
        yield i, held


def make_room(df: DataFrame, names: list[str]) -> DataFrame:
    """``df`` without columns of these names: they are renamed, with as many underscores before the name as it takes."""
    taken = {c.lower() for c in [*df.columns, *names]}
    out = []
    for c in df.columns:
        new = c
        if c.lower() in {n.lower() for n in names}:
            while new.lower() in taken:
                new = f"_{new}"
            taken.add(new.lower())
        out.append(new)
    return df.toDF(*out)


def encode(docs: DataFrame, path: str = VOCABULARY, scores: str = "zipf", text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with a column ids array<int>. With ``back``, decoded and round_trip stand in the place of the text: the
    text of the ids, and whether it is the text (null: empty); both directions run in one Python worker. A column of
    ``docs`` that has the name of a new one stays under that name with underscores before it."""
    model = docs.sparkSession.sparkContext.broadcast(make_model(read_pieces(path, scores)))
    new = [StructField("ids", ArrayType(IntegerType()))]
    if back:
        new += [StructField("decoded", StringType()), StructField("round_trip", BooleanType())]
    k = docs.columns.index(text)
    docs = make_room(docs, [f.name for f in new])
    stay = [c for c in range(len(docs.columns)) if c != k or not back]
    fields = [*(docs.schema.fields[c] for c in stay), *new]

    def run(batches):
        for batch in batches:
            for i, part in _parts(batch.column(k).cast(pa.binary()), RUN):
                ids, at = encode_texts(model.value, part)
                rows = batch.slice(i, len(part))
                out = [*(rows.column(c) for c in stay), pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32()))]
                if back:
                    texts = decode_ids(model.value, ids, at)
                    out += [pa.array(texts, pa.string()), pa.array([t.encode() == x for t, x in zip(texts, part)], pa.bool_())]
                yield pa.RecordBatch.from_arrays(out, names=[f.name for f in fields])

    return docs.mapInArrow(run, StructType(fields))


def decode(rows: DataFrame, path: str = VOCABULARY, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``rows`` with the text of their ids. A column that has the name ``out`` stays under that name with underscores before it."""
    model = rows.sparkSession.sparkContext.broadcast(make_model(read_pieces(path, "file")))
    k = rows.columns.index(ids)
    rows = make_room(rows, [out])

    def run(batches):
        for batch in batches:
            col = batch.column(k)
            values = col.flatten()  # without what null rows hold
            counts = np.array(col.value_lengths().fill_null(0), dtype=np.int64) if len(col) else np.zeros(0, np.int64)
            flat = np.array(values.fill_null(-1), dtype=np.int64)
            at = np.concatenate([[0], np.cumsum(counts)])
            i = 0
            while i < len(col):
                j = min(len(col), max(i + 1, int(np.searchsorted(at, at[i] + (RUN >> 2), "right")) - 1))
                b = batch.slice(i, j - i)
                texts = decode_ids(model.value, flat[at[i]:at[j]], at[i:j + 1] - at[i])
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], names=[*b.schema.names, out])
                i = j

    return rows.mapInArrow(run, StructType([*rows.schema.fields, StructField(out, StringType())]))


def round_trip(docs: DataFrame, path: str = VOCABULARY, scores: str = "zipf") -> DataFrame:
    """doc_id, n_tokens, n_byte_tokens, ids_sha256 (of the ids as decimal text, one space between), decoded_sha256 and
    round_trip: whether the decoded text is the text (null: empty). Encoding and decoding run in one Python worker, so
    neither ids nor texts go back to Spark."""
    pieces = read_pieces(path, scores)
    model = docs.sparkSession.sparkContext.broadcast(make_model(pieces))
    byte_ids = np.array([kind == "byte" for _, _, kind in pieces])

    def run(batches):
        for batch in batches:
            for i, part in _parts(batch.column(1).cast(pa.binary()), RUN):
                ids, at = encode_texts(model.value, part)
                texts = [t.encode() for t in decode_ids(model.value, ids, at)]
                n_bytes = np.diff(np.concatenate([[0], np.cumsum(byte_ids[ids])])[at])
                shas = [hashlib.sha256(" ".join(map(str, ids[x:y].tolist())).encode()).hexdigest() for x, y in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, len(part)), pa.array(np.diff(at), pa.int64()), pa.array(n_bytes, pa.int64()), pa.array(shas, pa.string()),
                     pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array([t == x for t, x in zip(texts, part)], pa.bool_())],
                    names=["doc_id", "n_tokens", "n_byte_tokens", "ids_sha256", "decoded_sha256", "round_trip"])

    return docs.select("doc_id", "text").mapInArrow(
        run, "doc_id long, n_tokens long, n_byte_tokens long, ids_sha256 string, decoded_sha256 string, round_trip boolean")


def op5_sentencepiece(spark, sf_dir: str) -> DataFrame:
    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"))
