"""Spelling variants against brute force."""

import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from agora.llm import spelling

LOWER = {c: c + 32 for c in range(65, 91)}


def vocabulary(rows, every, least):
    count = Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[:h % len(w)] + w[h % len(w) + 1:]
            if len(w) >= 6:
                count[w] += 1
    return {w: n for w, n in count.items() if n >= least}


def one_apart(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def expected(rows, every, least, ratio=5):
    n = vocabulary(rows, every, least)
    near = {w: [o for o in n if one_apart(w, o)] for w in n}
    top = {w: min(near[w], key=lambda o: (-n[o], o)) for w in n if near[w]}
    form = {w: o for w, o in top.items() if n[o] >= ratio * n[w]}

    def last(w):
        while w in form:
            w = form[w]
        return w
    return Counter((w, form.get(w), last(w), n[w], len(near[w]), n.get(form.get(w))) for w in n)


def planted_rows(seed=5):
    r = random.Random(seed)
    stems = ["".join(r.choice("abcdeéß") for _ in range(r.randint(6, 9))) for _ in range(12)]
    rows = []
    for i in range(90):
        words = []
        for _ in range(r.randint(0, 60)):
            w = stems[min(int(r.expovariate(0.5)), 11)]
            k, kind = r.randrange(len(w)), r.random()
            if kind < 0.1:
                w = w[:k] + w[k + 1:]
            elif kind < 0.2:
                w = w[:k] + r.choice("abÀé") + w[k:]
            elif kind < 0.3:
                w = w[:k] + r.choice("abcÿ") + w[k + 1:]
            words.append(w.title() if r.random() < 0.2 else w)
        rows.append((i, r.choice([" ", "-", "1", "\n", "×", "Ā"]).join(words)))
    # a chain of forms: 150 > 30 > 6 occurrences, each one letter from the next
    rows += [(200 + i, "chainwords " * 30 + "chainworda " * 6 + "chainworxa ") for i in range(6)]
    rows += [(300, None), (301, ""), (None, "abcdef " * 7), (None, None), (302, "ab" * 4000), (303, "Ã\u0083"), (7, rows[7][1]), (7, rows[7][1]), (304, "Ã")]
    return rows


def bag(df):
    return Counter((r.word, r.form, r.root, r.n, r.n_near, r.form_n) for r in df.collect())


@pytest.mark.parametrize("every", [3, 199])
def test_variants(spark, every):
    rows = planted_rows()
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, word string, n int").repartition(4)
    want = expected(rows, every, 2)
    assert any(k[1] for k in want) and any(k[1] and k[2] != k[1] for k in want)
    assert bag(spelling.group_variants(docs, least=2, every=every)) == want


def test_sql(spark):
    rows = planted_rows(8)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    con = duckdb.connect()
    frame = pd.DataFrame({"doc_id": pd.array([i for i, _ in rows], dtype="Int64"), "text": [t for _, t in rows]})
    con.register("documents", frame)
    assert Counter(con.execute(spelling.OP11_SQL).fetchall()) == bag(spelling.group_variants(docs)) == expected(rows, 199, 5)


def test_empty(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(docs).count() == 0


def test_hot_groups(spark, monkeypatch):
    """Groups dealt to several blocks find the same pairs."""
    r = random.Random(2)
    words = sorted({"prefix" + "".join(r.choice("ab") for _ in range(r.randint(0, 6))) for _ in range(400)})
    want = Counter((a, b) for a in words for b in words if one_apart(a, b))
    frame = spark.createDataFrame([(w, i + 1) for i, w in enumerate(words)], "word string, n long")
    for hot in (4096, 5):
        monkeypatch.setattr(spelling, "HOT", hot)
        got = Counter((p.word, p.other) for p in spelling.near_pairs(frame, 6).collect())
        assert got == want


def test_streamed_queries(monkeypatch):
    """Queries of a large group stream past the indexed words in small pieces."""
    monkeypatch.setattr(spelling, "HOT", 7)
    monkeypatch.setattr(spelling, "BLOCK", 4)
    words = sorted({"abcdef"[:k] + c + "abcdef"[k + 1:] for k in range(6) for c in "abcxyz"} | {"abcdefg", "abbcdef", "zzzzzz"})
    row = lambda w, role, sub, letters="abc": (6, False, letters, sub, role, w, 1)
    six = [w for w in words if len(w) == 6]
    rows = [row(w, role, sub) for sub in (0, 1) for role in (0, 1) for k, w in enumerate(words) if (k % 2 == sub if role == 0 else w in six)]
    rows += [row(w, 2, 0, "abd") for w in words]
    frame = pd.DataFrame(rows, columns=["m", "last", "letters", "sub", "role", "word", "n"])
    for size in (3, 10, 1000):
        got = pd.concat(list(spelling._search(frame.iloc[k:k + size].reset_index(drop=True) for k in range(0, len(frame), size))))
        pairs = Counter(zip(got["word"], got["other"]))
        one = Counter((a, b) for a in words for b in words if one_apart(a, b) and (len(a) == 6 or len(b) == 6) and min(len(a), len(b)) == 6)
        assert pairs == one + one


def test_crc():
    data = bytes(range(256)) * 3
    starts, lens = np.array([0, 5, 100, 3, 7]), np.array([0, 1, 300, 48, 49])
    before = np.array([zlib.crc32(b"12:"), 0, zlib.crc32(b"x"), 9, 8], np.uint32)
    got = spelling.crc_of(np.frombuffer(data, np.uint8), starts, lens, before)
    assert got.tolist() == [zlib.crc32(data[s:s + n], int(b)) for s, n, b in zip(starts, lens, before)]
