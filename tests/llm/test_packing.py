"""Packing against a plain deficit round-robin with explicit queues and deficits."""

import math
import random
import struct
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from agora.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")
TOKENIZER = Tokenizer.from_file(PATH)


def ids_of(text):
    return TOKENIZER.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, pieces, window):
    """Every id of every document lies in one piece; sequences are gapless, and full or a power of two."""
    want = Counter((i, tuple(ids_of(t))) for i, t in rows)
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id, p.doc_tokens].append(p)
    got = Counter()
    for (i, n), ps in by.items():
        copies = defaultdict(list)
        for p in ps:
            copies[p.start].append(p)
        at = Counter()
        for p in ps:
            at[p.start, p.start + p.length] += 1
        ids = {k for k in want if k[0] == i and len(k[1]) == n}
        assert ids
        for a, b in at:
            assert 0 <= a < b <= n
        # pieces that follow on each other, by place: as many begin as end
        assert Counter({a: c for a, c in Counter(p.start for p in ps).items() if a}) == Counter({b: c for b, c in Counter(p.start + p.length for p in ps).items() if b < n})
        times = sum(p.start == 0 for p in ps)
        assert times == sum(c for k, c in want.items() if k in ids)
        if len(ids) == 1:
            whole = next(iter(ids))[1]
            assert all(list(p.ids) == list(whole[p.start:p.start + p.length]) for p in ps)
            got[i, whole] += times
        else:
            got.update({k: want[k] for k in ids})
    assert got == want
    sequences = defaultdict(list)
    for p in pieces:
        sequences[p.sequence_id].append((p.offset, p.length))
    assert sorted(sequences) == list(range(len(sequences)))
    for s in sequences.values():
        at = 0
        for o, n in sorted(s):
            assert o == at
            at += n
        assert at == window or (at < window and at & (at - 1) == 0)


def rows_of(odd):
    return [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]


@pytest.mark.parametrize("grain,window", [(128, 2048), (16, 64)])
def test_pieces(odd, grain, window):
    pieces = packing.pack(odd, PATH, window=window, grain=grain).collect()
    check(rows_of(odd), pieces, window)
    # proportions: what a source has had by the end of a window is its share, but for one packet a source
    total, sources = Counter(), {p.source for p in pieces}
    for p in pieces:
        total[p.source] += p.length
    all_ = sum(total.values())
    assert None in sources and "" in sources
    had = Counter()
    for s in sorted({p.sequence_id for p in pieces})[:all_ // window]:
        for p in pieces:
            if p.sequence_id == s:
                had[p.source] += p.length
        for x in sources:
            assert abs(had[x] - (s + 1) * window * total[x] / all_) <= grain * len(sources)


def test_digest_and_reruns(odd):
    a = packing.pack(odd, PATH, digest=True).drop("round")
    b = packing.pack(odd.repartition(3), PATH)
    want = Counter((p.doc_id, p.start, p.length, p.sequence_id, p.offset, p.doc_tokens, zlib.crc32(struct.pack(f"<{p.length}I", *p.ids))) for p in b.collect())
    assert Counter((p.doc_id, p.start, p.length, p.sequence_id, p.offset, p.doc_tokens, p.ids_crc32) for p in a.collect()) == want


def plain_round_robin(queues, quantum, grain):
    """The order in which packets (queue, document, start, length) leave the queues."""
    waiting = {q: [(d, p, min(grain, n - p)) for d, n in docs for p in range(0, n, grain)] for q, docs in queues.items()}
    deficit, out = dict.fromkeys(queues, 0.0), []
    while any(waiting.values()):
        for q in sorted(waiting):
            if not waiting[q]:
                continue
            deficit[q] += quantum[q]
            while waiting[q] and waiting[q][0][2] <= deficit[q] + 1e-9:
                d, p, n = waiting[q].pop(0)
                deficit[q] -= n
                out.append((q, d, p, n))
    return out


@pytest.mark.parametrize("weights", [None, {"a": 4.0, "b": 2.0, "c": 2.0}, {"a": 1.0, "c": 1.0, "zz": 5.0}])
def test_equals_plain_round_robin(spark, monkeypatch, weights):
    monkeypatch.setattr(packing, "ROUNDS", 2)  # many partitions, so deficits are carried over them
    monkeypatch.setattr(packing, "SUPER", 2)
    monkeypatch.setattr(packing, "SHARD_BYTES", 500)
    monkeypatch.setattr(packing, "SHARDS", 1)
    r = random.Random(4)
    rows = [(i, " ".join(r.choice(["one", "two", "three", "four"]) for _ in range(r.randint(0, 90))), r.choice("aaabc")) for i in range(70)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    w = weights and spark.createDataFrame(list(weights.items()), "source string, weight double")
    pieces = packing.pack(docs, PATH, window=64, grain=8, weights=w).collect()
    check([(i, t) for i, t, _ in rows], pieces, 64)
    # the queues' order is by shard and doc_id
    shard = {x.doc_id: x.s for x in docs.select("doc_id", F.pmod(F.xxhash64("doc_id", packing.text_key()), F.lit(math.ceil(sum(len(t) for _, t, _ in rows) / 500))).alias("s")).collect()}
    queues = {q: [(i, len(ids_of(t))) for i, t, s in sorted(rows, key=lambda x: (shard[x[0]], x[0])) if s == q] for q in "abc"}
    total = {q: sum(n for _, n in d) for q, d in queues.items()}
    if weights is None:
        quantum = {q: 64 * total[q] / sum(total.values()) for q in queues}
    else:
        quantum = {q: 64 * weights.get(q, 0) / sum(v for k, v in weights.items() if k in queues) for q in queues}
    last = {q: queues.pop(q) for q in list(queues) if not quantum[q]}
    order = plain_round_robin(queues, quantum, 8)
    stream = [(d, p + k) for _, d, p, n in order for k in range(n)] + [(d, k) for q in sorted(last) for d, n in last[q] for k in range(n)]
    got = [(p.doc_id, p.start + k) for p in sorted(pieces, key=lambda p: (p.sequence_id, p.offset)) for k in range(p.length)]
    assert got == stream


def test_empty(spark):
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string, source string, ids int"), PATH).count() == 0


def test_tail():
    assert packing.tail_bounds(2048 * 3 + 13, 2048).tolist() == [6144, 6152, 6156, 6157]
    assert packing.tail_bounds(4096, 2048).tolist() == [4096]


def test_long_document_in_runs(spark):
    text = "word " * (2 * packing.RUN + 5)
    pieces = packing.pack(spark.createDataFrame([(1, text, "s"), (2, "x", "t")], "doc_id long, text string, source string"), PATH).collect()
    check([(1, text), (2, "x")], pieces, 2048)


def test_words_have_the_ids_of_the_library():
    words = ["plain", "MiXed", "don't", "'s", "a1b22", "ÀÉßÿ×÷", "x.y,,z!!", "<|endoftext|>", "a<|startoftext|>b", "漢字kana", "İstanbul", "e\u0301", "nb\u00a0sp", "\x01", "\x1c", "ΣΑΣ", "#!", "9", "é", "Ã", "ª²",
             "\u212b", "x" * 300, "(A1)", "\x7f", "~`"]
    raw = [w.encode() for w in words * 2]
    ids, at = packing.WordIds(PATH)(np.frombuffer(b"".join(raw), "u1"), np.concatenate([[0], np.cumsum([len(w) for w in raw])]))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [TOKENIZER.encode(w, add_special_tokens=False).ids for w in words * 2]


def test_pieces_are_encoded_once_from_batch_to_batch(monkeypatch):
    import numpy as np
    import public_tokenizers

    from agora.llm import packing as pk

    path = public_tokenizers.path("word_bpe_49k.json")
    words = ["Straße", "hello", "World42", "it's", "<s>", "日本", "hello", "x" * 40, "new", "Éa"]

    def batch(some):
        data = [w.encode() for w in some]
        return np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)])

    want = {w: pk.WordIds(path).t.encode(w, add_special_tokens=False).ids for w in words}
    for pieces, size in ((1 << 18, 8 << 20), (3, 8 << 20), (1 << 18, 100), (0, 0)):
        monkeypatch.setattr(pk, "MEMORY", pieces)
        monkeypatch.setattr(pk, "MEMORY_BYTES", size)
        encoder, asked = pk.WordIds(path), []
        plain = encoder.plain
        encoder.plain = lambda p: asked.append(p) or plain(p)
        for some in (words[:5], words, words[::-1], []):
            ids, at = encoder(*batch(some))
            assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [want[w] for w in some]
        assert len(encoder.known) <= pieces and encoder.known.nbytes <= max(size, 64)
        if pieces == 1 << 18 and size == 8 << 20:
            assert len(asked) == len(set(asked))
