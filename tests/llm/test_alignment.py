"""Alignment against a plain two-pointer walk over whole texts encoded at once."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from agora.llm import alignment

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def tokenizers():
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    p = sentencepiece.SentencePieceProcessor(model_file=B)
    return t, p, alignment.side_a(A).tokens, alignment.side_b(B).tokens


def walk(tokenizers, text):
    """Ids and groups of a text, or None."""
    t, p, a_bytes, b_bytes = tokenizers
    want = (" " + (text or "")).encode()
    a, b = t.encode(want.decode(), add_special_tokens=False).ids, p.encode(text or "")
    if not text or b"".join(a_bytes[i] for i in a) != want or b"".join(b_bytes[i] for i in b) != want:
        return None
    groups, ga, gb, x, y, i, j = [], [], [], 0, 0, 0, 0
    while i < len(a) or j < len(b):
        if x <= y:
            x += len(a_bytes[a[i]])
            ga.append(a[i])
            i += 1
        else:
            y += len(b_bytes[b[j]])
            gb.append(b[j])
            j += 1
        if x == y:
            groups.append((ga, gb))
            ga, gb = [], []
    return a, b, groups


ODD = ["<|endoftext|> in <s> a text</s>", "▁marks ▁▁ in", "tabs\tand\r\n\n  lines  ", " lead", "trail ", "  ", " ", " nbsp 　wide x y", "a\x00b \x1c c", "é é ﬁ 漢字 😀 z‍", "don't we'll 'tis I'm 's",
       "1234567 12.5% $#@! ...  ?!", "x" * 3000, "ab " * 900, "﻿bom", "q ́ combining", "Ünïcödé ß ẞ ſ", "word.\u0085next line sep"]


def test_digest(odd, tokenizers, spark):
    rows = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()] + [(1000 + k, t) for k, t in enumerate(ODD)]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n_a int, links string").repartition(3)
    found = [(i, walk(tokenizers, t)) for i, t in rows]
    count, top = Counter((g[0][-1], g[1][-1]) for _, f in found if f for g in f[2]), defaultdict(int)
    for (_, b), n in count.items():
        top[b] = max(top[b], n)
    want = Counter()
    for i, f in found:
        if f is None:
            want[i, 0, 0, 0, 0, 0, 0, ""] += 1
            continue
        a, b, groups = f
        links = [(g[0][-1], g[1][-1]) for g in groups]
        said = ";".join(",".join(map(str, x)) + "|" + ",".join(map(str, y)) for x, y in groups)
        want[i, len(a), len(b), len(groups), len(links), sum(count[k] == top[k[1]] for k in links), sum(count[k] for k in links), hashlib.sha256(said.encode()).hexdigest()] += 1
    got = alignment.aligned(docs, A, B)
    assert Counter((r.doc_id, r.n_a, r.n_b, r.n_groups, r.n_links, r.n_best, r.count_sum, r.groups_sha256) for r in got.collect()) == want
    assert sum(c for k, c in want.items() if k[1] == 0) >= 4 and len(want) > 50


def test_groups(odd, tokenizers):
    got = Counter((r.doc_id, tuple(r.a), tuple(r.b), tuple(r.a_ends), tuple(r.b_ends)) for r in alignment.align_texts(odd, A, B).collect())
    want = Counter()
    for r in odd.collect():
        f = walk(tokenizers, r.text)
        a, b, groups = f or ([], [], [])
        want[r.doc_id, tuple(a), tuple(b), tuple(np.cumsum([len(x) for x, _ in groups]).astype(int).tolist()), tuple(np.cumsum([len(y) for _, y in groups]).astype(int).tolist())] += 1
    assert got == want


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert alignment.aligned(docs, A, B).count() == 0 and alignment.align_texts(docs, A, B).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert {(r.doc_id, r.n_a, r.n_best, r.groups_sha256) for r in alignment.aligned(nothing, A, B).collect()} == {(1, 0, 0, ""), (2, 0, 0, "")}


def test_diagonal_runs():
    r = random.Random(1)
    for density in (0.02, 0.5, 0.95):
        for _ in range(40):
            n = r.randint(1, 400)
            ends = [sorted({x for x in range(1, n) if r.random() < density} | {n}) for _ in range(2)]
            ea, eb = (np.array(e, np.int64) for e in ends)
            ga, gb = alignment.align(ea, eb)
            both, i, j = np.intersect1d(ea, eb, return_indices=True)
            assert ga.tolist() == (i + 1).tolist() and gb.tolist() == (j + 1).tolist()
    ga, gb = alignment.align(np.zeros(0, np.int64), np.zeros(0, np.int64))
    assert len(ga) == len(gb) == 0


@pytest.mark.parametrize("ranked", [True, False])
def test_units_have_the_ids_they_have_alone(ranked):
    import pyarrow as pa
    side = alignment.side_a(A)
    t = Tokenizer.from_file(A)
    t.encode_special_tokens = True
    e = side.encode if ranked else alignment.ByteLevelIds(t, side.tokens, side.lens, ["a b"], {"ab": 0})
    words = [" " + w for w in ["a", "don't", "x" * 5000, "éé", "semi;", "\x01", "a\x01b", "\x02.", "<|endoftext|>", "12", "漢字.", "'", "it's", "\u00a0", "e\u0301", "\u00a0x", "日本"]] + ["  two", " \n", "  "]
    flat, n = e(pa.array([w.encode() for w in words * 3], pa.large_binary()))
    ends = np.cumsum(n)
    assert [flat[x - k:x].tolist() for x, k in zip(ends, n)] == [t.encode(w, add_special_tokens=False).ids for w in words * 3]
    assert len(e(pa.array([], pa.large_binary()))[0]) == 0
