"""Components with hot labels and hubs against union-find; near duplicates verified over several blocks."""

import random
import uuid

import pytest

from agora.llm import graph, near_dup


def plain_components(edges):
    up = {}

    def top(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x
    for a, b in edges:
        if a is not None and b is not None and a != b:
            x, y = top(a), top(b)
            up[max(x, y)] = min(x, y)
    return {v: top(v) for v in up}


@pytest.mark.parametrize("least", [0, 100])
def test_components(spark, monkeypatch, least):
    monkeypatch.setattr(graph, "HOT", 4)
    monkeypatch.setattr(graph, "LEAST", least)
    r = random.Random(2)
    star = [(5000, i) for i in range(400)]  # one hub, not the least vertex
    chain = [(i, i + 1) for i in range(600, 640)]
    pairs = [(r.randint(700, 1000), r.randint(700, 1000)) for _ in range(120)]
    edges = [*star, *chain, *pairs, (3, 3), (650, 650), star[0], star[0], (1, 5000)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(6)
    assert {x.v: x.label for x in graph.components(df).collect()} == plain_components(edges)
    assert graph.components(df.limit(0)).count() == 0


def test_look_up_matches_hot_and_cold_keys_once(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 3)
    monkeypatch.setattr(graph, "LEAST", 0)
    rows = spark.createDataFrame([(1, i) for i in range(50)] + [(k, 0) for k in range(2, 12)] + [(None, 1), (99, 1)], "k long, x long")
    table = spark.createDataFrame([(k, k * 10) for k in range(1, 12)] + [(500, 0)], "k long, y long")
    got = sorted(tuple(r) for r in graph.look_up(rows, table, "k").select("k", "x", "y").collect())
    assert got == sorted([(1, i, 10) for i in range(50)] + [(k, 0, k * 10) for k in range(2, 12)])


def test_near_duplicates_over_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BLOCK_DOCS", 5)
    monkeypatch.setattr(graph, "LEAST", 3)
    r = random.Random(4)
    base = [f"w{k}" for k in range(300)]
    texts = []
    for k in range(40):  # each differs from the one before in one word more: neighbours linked, the ends not
        base[(k * 7) % 300] = f"new{k}"
        texts.append(" ".join(base))
    texts += [" ".join(r.choice(base) for _ in range(80)) for _ in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)

    def shingles(t):
        w = t.split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}
    sets = [shingles(t) for t in texts]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    want = plain_components(links)
    got = {x.doc_id: x.component_id for x in near_dup.near_components(df).collect()}
    assert got == {i: want.get(i, i) for i in range(len(texts))} and len(set(got.values())) < 30


@pytest.mark.parametrize("landmarks", [0, 3])
def test_blocks_of_one_group_of_copies_are_not_compared_pair_by_pair(spark, monkeypatch, tmp_path, landmarks):
    """Copies of one text, strays that share half of it and links between strays: the components of brute force, and no
    text meets as many groups as there are blocks."""
    rng = random.Random(5)
    base = [f"w{i}" for i in range(120)]
    texts = []
    for i in range(150):  # near copies: one word changed
        words = base[:]
        words[rng.randrange(120)] = f"x{i}"
        texts.append(" ".join(words))
    for i in range(12):  # strays: half of the base; every third has a near copy
        words = base[:60] + [f"s{i}-{j}" for j in range(60)]
        texts.append(" ".join(words))
        if i % 3 == 0:
            texts.append(" ".join(words[:-1] + ["end"]))
    rng.shuffle(texts)
    df = spark.createDataFrame(list(enumerate(texts)) + [(0, texts[0])] * 3, "doc_id long, text string")
    for k, v in {"BLOCK_DOCS": 16, "SMALL_DOCS": 16, "LANDMARKS": landmarks}.items():
        monkeypatch.setattr(near_dup, k, v)
    made = near_dup._verify

    def counting(width, percent):
        run = made(width, percent)

        def counted(pdf):
            with open(f"{tmp_path}/{uuid.uuid4().hex}", "w") as f:
                f.write(str(len(pdf)))
            return run(pdf)
        return counted

    monkeypatch.setattr(near_dup, "_verify", counting)
    got = {x.doc_id: x.component_id for x in near_dup.near_components(df, width=4).collect()}
    sets = [{tuple(t.split()[i:i + 4]) for i in range(len(t.split()) - 3)} for t in texts]
    label = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if 100 * len(a & sets[j]) >= 80 * len(a | sets[j]) and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    assert got == dict(enumerate(label))
    assert len(set(label)) == 13
    met = sum(int(f.read_text()) for f in tmp_path.iterdir())
    if landmarks:
        assert met < 6 * len(texts)  # 11 blocks: before each text met 11 groups
