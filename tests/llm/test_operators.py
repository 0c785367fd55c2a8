"""Operators against brute force on small fixtures; nulls, empties, repeats, clashing columns and empty tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from agora.llm import chat, lines, mixing, near_dup, packs, quality, sentencepiece, substring, suffix_array, topk, toxicity

SPLIT = re.compile("[^\x20\x09-\x0d]+")


def rows(df):
    return [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]


def sha(x: bytes) -> str:
    return hashlib.sha256(x).hexdigest()


def bag(df, *columns):
    return Counter(tuple(r) for r in df.select(*columns).collect())


def check_suffix_dedup(df):
    width, data = 400, [(i, (t or "").encode()) for i, t in rows(df)]
    seen = Counter(b[p:p + width] for _, b in data for p in range(len(b) - width + 1))
    want = Counter()
    for i, b in data:
        gone = np.zeros(len(b) + 1, bool)
        for p in range(len(b) - width + 1):
            if seen[b[p:p + width]] > 1:
                gone[p:p + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        want[i, len(b), int(gone.sum()), runs, sha(bytes(x for x, g in zip(b, gone) if not g))] += 1
    assert any(k[2] for k in want)
    assert bag(suffix_array.remove_repeated_bytes(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want


def test_suffix_dedup(odd, empty):
    check_suffix_dedup(odd)
    assert suffix_array.remove_repeated_bytes(empty).count() == 0


def test_suffix_dedup_many_chunks_and_ranges(odd, monkeypatch):
    monkeypatch.setattr(packs, "CHUNK_BYTES", 8000)
    monkeypatch.setattr(packs, "RANGE_BYTES", 4000)
    base, ranges = packs.chunked(odd)
    assert base.select("chunk").distinct().count() > 4 and ranges > 10
    check_suffix_dedup(odd)


def test_anchors_across_boundaries(spark, monkeypatch):
    """One lead before many different texts, and before texts that all occur twice: its suffixes fill several ranges."""
    monkeypatch.setattr(packs, "CHUNK_BYTES", 4000)
    monkeypatch.setattr(packs, "RANGE_BYTES", 2000)
    r = np.random.default_rng(5)
    say = lambda n: "".join(map(chr, r.integers(97, 123, n)))
    lead = say(410)
    texts = [say(30) + lead + say(300) for _ in range(60)] + [lead + say(400) for _ in range(20)] * 2
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    splitters = suffix_array.sampled_splitters(df, 400, packs.chunked(df)[1])
    assert len({tuple(x[:2]) for x in splitters.tolist()}) < len(splitters)
    check_suffix_dedup(df)


def test_sampled_splitters_are_even(spark, monkeypatch):
    """100 ranges over texts whose leading bytes crowd at a few values."""
    r = np.random.default_rng(7)
    texts = [" ".join(r.choice(["aaaaaaaa", "aaaaaaab", "zz", "the", *map(str, r.integers(0, 10 ** 6, 4))], 400)) for _ in range(600)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    monkeypatch.setattr(packs, "RANGE_BYTES", sum(map(len, texts)) // 100 + 1)
    splitters = suffix_array.sampled_splitters(df, 400, 100)
    c = suffix_array.Chunk(df.toPandas(), 400)
    sizes = np.bincount(suffix_array.range_of(c.tokens, splitters), minlength=100)
    assert len(sizes) == 100 and sizes.max() <= 2 * sizes.mean()


def test_multikey_sort(monkeypatch):
    monkeypatch.setattr(suffix_array, "SMALL", 4)
    r = np.random.default_rng(1)
    for n in (0, 1, 5, 3000):
        tokens = [r.integers(0, 6, n).astype(np.uint64) for _ in range(3)]
        order = suffix_array.multikey_sort(tokens)
        triples = [*zip(*(t.tolist() for t in tokens))]
        assert sorted(order.tolist()) == [*range(n)] and [triples[i] for i in order] == sorted(triples)
        splitters = np.asarray(sorted(triples[:4]), np.uint64).reshape(-1, 3)
        assert suffix_array.range_of(tokens, splitters).tolist() == [sum(tuple(s) <= t for s in splitters.tolist()) for t in triples]


def test_long_text_in_slices(spark, monkeypatch):
    monkeypatch.setattr(suffix_array, "PIECE", 1000)
    import pandas as pd
    text = "".join(chr(97 + (i * i * 7 + i // 13) % 26) for i in range(3000))
    pdf = pd.DataFrame({"doc_id": [1, 2], "text": [text + "0" * 500, "x" * 10 + text]})
    c = suffix_array.Chunk(pdf, 400)
    starts = sorted(p for n, p, _ in c.windows(np.ones(len(c.tokens[0]), bool)) for p in (p + c.parts[n][2] + 10_000 * c.parts[n][0][0]).tolist())
    assert starts == [*range(3101), *range(10_000, 12_611)]


def test_substring_dedup(odd, empty):
    window, data = 50, [(i, SPLIT.findall(t or "")) for i, t in rows(odd)]
    big = 1 << 62
    least = {}
    for i, w in data:
        for p in range(len(w) - window + 1):
            k = tuple(w[p:p + window])
            least[k] = min(least.get(k, big), big if i is None else i)
    want = Counter()
    for i, w in data:
        gone = [False] * len(w)
        for p in range(len(w) - window + 1):
            if least[tuple(w[p:p + window])] < (big if i is None else i):
                gone[p:p + window] = [True] * window
        want[i, len(w), sum(gone), sha(" ".join(x for x, g in zip(w, gone) if not g).encode())] += 1
    assert any(k[2] for k in want)
    assert bag(substring.remove_repeats(odd), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert substring.remove_repeats(empty).count() == 0


@pytest.mark.parametrize("rule", ["frequent", "first"])
def test_line_dedup(odd, empty, rule):
    data = [(i, (t or "").split("\n")) for i, t in rows(odd)]
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    docs = {}
    for i, ls in data:
        for x in ls:
            docs.setdefault(key(x), set()).add((i, None if i is not None else tuple(ls)))
    if rule == "frequent":
        want = Counter()
        for i, ls in data:
            kept = [x for x in ls if not key(x) or len(docs[key(x)]) < 5]
            want[i, len(ls), len(ls) - len(kept), sha("\n".join(kept).encode())] += 1
        assert any(k[2] for k in want)
        assert bag(lines.dedup_digest(odd, rule=rule, min_docs=5), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    else:
        left = Counter(key(x) for _, t in set(rows(lines.drop_lines(odd, rule=rule))) for x in (t or "").split("\n") if key(x))
        assert set(left) == {k for k in docs if k} and max(left.values()) == 1
    assert lines.drop_lines(odd, rule=rule).columns == odd.columns
    assert lines.dedup_digest(empty, rule=rule).count() == 0


def test_near_duplicates(odd, empty):
    def shingles(t):
        w = re.sub("[A-Z]", lambda m: m[0].lower(), t or "")
        w = SPLIT.findall(w)
        return frozenset(tuple(w[i:i + 4]) for i in range(len(w) - 3)) if len(w) >= 4 else frozenset([tuple(w)] if w else [])
    data = [(i, shingles(t)) for i, t in rows(odd)]
    comp = list(range(len(data)))
    for a in range(len(data)):
        for b in range(a):
            x, y = data[a][1], data[b][1]
            if x and y and 100 * len(x & y) >= 80 * len(x | y):
                old, new = comp[a], comp[b]
                comp = [new if c == old else c for c in comp]
    want = Counter()
    for k, (i, s) in enumerate(data):
        ids = [data[j][0] for j in range(len(data)) if comp[j] == comp[k] and data[j][0] is not None]
        least = min(ids, default=None) if s else i
        want[i, len(s), least] += 1
    got = near_dup.near_components(odd, width=4)
    assert bag(got, "doc_id", "n_shingles", "component_id") == want
    kept = near_dup.drop_near_copies(odd, width=4)
    assert kept.columns == odd.columns and kept.filter("doc_id = 3").count() <= 1
    assert near_dup.near_components(empty).count() == 0


def test_near_copies_that_share_a_doc_id(spark):
    say = lambda name, last="end": " ".join([*(f"{name}{k}" for k in range(60)), last])
    data = [(1, say("a"), "s"), (1, say("a", "close"), "s"), (1, say("b"), "s"), (2, say("a"), "s"), (3, say("c"), "t"), (3, say("c"), "s"),
            (None, say("d"), "s"), (None, say("d", "close"), "s"), (None, say("e"), "s")]
    df = spark.createDataFrame(data, "doc_id long, text string, source string")
    least = df.filter("doc_id = 1 and text like 'a%'").orderBy(near_dup.text_key()).first().text
    want = Counter([(1, least, "s"), (1, say("b"), "s"), (3, say("c"), "s"), *data[6:]])
    for parts in (1, 4):
        assert bag(near_dup.drop_near_copies(df.repartition(parts)), "doc_id", "text", "source") == want


def test_verified_links_star_and_chain():
    base = np.arange(100, dtype=np.uint64)
    sets = [base + k * 10 for k in range(6)] + [base[:50] + 1000] + [base.copy()]  # neighbours overlap 90 / 110
    label = near_dup.verified_links([np.unique(s) for s in sets], 80)
    assert len({*label[:6].tolist(), label[7]}) == 1 and label[6] != label[0]


def test_quality_brute_force(odd, empty):
    want = Counter()
    for i, t in rows(odd):
        t = t or ""
        w = SPLIT.findall(t)
        grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        again = {p for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)}
        ls = [x for x in t.split("\n") if SPLIT.search(x)]
        want[i, len(w), sum(map(len, w)), sum(t.count(c) for c in "#*$%&|<>"), len(ls) - len(set(ls)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)] += 1
    got = quality.judged(odd)
    assert bag(got, "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == want
    assert got.filter("base_failed and kept").count() == 0
    assert quality.keep_quality(odd).columns == odd.columns
    assert quality.judged(empty).count() == 0


def test_thresholds_follow_the_group(spark):
    make = lambda i, lang, word: (i, " ".join(f"{word}{i}x{k}" for k in range(40)), lang, "s", 1)
    docs = [make(i, "en", "abc") for i in range(300)] + [make(i, "xx", "abcdefghijklmnop") for i in range(300, 600)]
    docs += [make(600, "en", "abcdefghijklmnop")]  # long words: an outlier for en only
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long")
    assert [r.doc_id for r in quality.judged(df).filter("not kept").collect()] == [600]


def test_mixing(odd, empty):
    got = mixing.mix_report(odd)
    size = {}
    for r in odd.select("source", "text").collect():
        size[r.source] = size.get(r.source, 0) + len(SPLIT.findall(r.text or ""))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    goal, fixed = {}, set()
    while True:  # share, stop what is above, share again
        left = 1.5 * sum(size.values()) - sum(2 * size[s] for s in fixed)
        share = left / (sum(w[s] for s in order if s not in fixed) or 1)
        goal = {s: 2.0 * size[s] if s in fixed else share * w[s] for s in order}
        over = {s for s in order if s not in fixed and goal[s] > 2 * size[s]}
        if not over:
            break
        fixed |= over
    taken, top = Counter(), Counter()
    for r in got.collect():
        assert math.isclose(r.target, goal[r.source], rel_tol=1e-9, abs_tol=1e-9) and r.source_size == size[r.source]
        assert r.taken == r.copies * r["size"] and 0 <= r.copies <= 2
        taken[r.source] += r.taken
        top[r.source] = max(top[r.source], r["size"])
    for s in order:
        assert abs(taken[s] - goal[s]) <= 2 * top[s]
    assert bag(got, "doc_id", "taken") == bag(mixing.mix_report(odd.repartition(3)), "doc_id", "taken")
    assert mixing.take_mix(odd).count() == got.agg(F.sum("copies")).first()[0]
    assert mixing.mix_report(empty).count() == 0


def test_mixing_meets_targets_within_a_median_document(spark):
    """Whole documents of sf0.01: 50 in each source, some of them 20 times as long as the median."""
    r = mixing.mix_report(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))
    by = r.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target"), F.median("size").alias("median")).collect()
    assert len(by) > 5 and all(abs(x.taken - x.target) <= x.median for x in by)
    assert r.filter("taken > 2 * size or taken < 0").count() == 0


def test_heavy_root_is_made_good(spark):
    """One document as heavy as all others of its source together, of which more are taken than left, or the reverse."""
    rows_ = [(i, "w " * (4000 if i == 0 else 10 + i % 40), "s") for i in range(150)] + [(1000 + i, "w " * (9 + i % 30), "t") for i in range(150)]
    for percent in (20, 60, 90):
        r = mixing.mix_report(spark.createDataFrame(rows_, "doc_id long, text string, source string"), percent=percent)
        for x in r.groupBy("source").agg(F.sum("taken").alias("taken"), F.first("target").alias("target")).collect():
            assert abs(x.taken - x.target) <= 10, (percent, x)


def test_pivotal_rounding_is_unbiased_and_near(spark):
    from pyspark.sql import Row
    docs = spark.createDataFrame([Row(doc_id=i, source="a" if i % 4 else "b", text="w " * (1 + i % 50)) for i in range(4000)])
    r = mixing.mix_report(docs).groupBy("source").agg(F.sum("taken").alias("t"), F.first("target").alias("g"), F.corr("copies", "size").alias("c")).collect()
    for x in r:
        assert abs(x.t - x.g) <= 25 and (x.c is None or math.isnan(x.c) or abs(x.c) < 0.1)


def test_topk(spark):
    r = np.random.default_rng(5)
    v = r.normal(size=(600, 8))
    data = [(int(i), [float(x) for x in v[i % 550]], "clash") for i in range(600)]
    data += [(700, None, ""), (750, [float("nan")] * 8, ""), (800, [None] * 8, ""), (None, [0.5] * 8, ""), (850, [0.5] * 3, ""), data[5], data[50]]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, score string")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(df).collect()}
    q = np.floor(256 * np.array([x[1] for x in data[:600]])).astype(np.int64)
    want = {}
    for i in range(0, 600, 50):
        s = q @ q[i]
        order = sorted((j for j in range(600) if j != i), key=lambda j: (-s[j], j))[:5]
        want.update({(i, k): (j, int(s[j])) for k, j in enumerate(order, 1)})
    assert got == want
    assert topk.top_k(df.limit(0)).count() == 0


def test_topk_shards_are_even_for_sparse_ids(spark, monkeypatch):
    size, score = 64, topk._score

    def bounded(k):
        inner = score(k)

        def run(key, left, right):
            assert len(left) <= 2 * size, f"{len(left)} vectors in one task"
            return inner(key, left, right)
        return run
    monkeypatch.setattr(topk, "SHARD", size)
    monkeypatch.setattr(topk, "_score", bounded)
    v = np.random.default_rng(6).integers(-9, 9, (603, 4))
    ids = [*range(300), *range(10 ** 9, 10 ** 9 + 300), 10 ** 15 + 1, 7, 7]  # blocks far apart, one very large id, an id with three vectors
    df = spark.createDataFrame([(i, [float(y) for y in x]) for i, x in zip(ids, v)], "vec_id long, embedding array<double>")
    got = {(x.query_id, x["rank"]): (x.vec_id, x.score) for x in topk.top_k(df, scale=1.0).collect()}
    want = {}
    for q in (i for i in ids if i % 50 == 0):
        s = v @ v[ids.index(q)]
        best = sorted((-int(s[j]), ids[j]) for j in range(len(ids)) if ids[j] != q)[:5]
        want.update({(q, k): (i, -x) for k, (x, i) in enumerate(best, 1)})
    assert got == want


def test_block_pruning_skips_blocks():
    rows_ = np.zeros((20 * topk.BLOCK, 4), np.int64)
    rows_[:, 0] = np.repeat(np.arange(20), topk.BLOCK)
    who, best, scored = topk.block_topk(np.arange(len(rows_)), rows_, np.array([-1]), np.array([[1, 0, 0, 0]]), 3)
    assert scored == 1 and best.tolist() == [[19, 19, 19]] and who.tolist() == [[19 * topk.BLOCK + k for k in range(3)]]


def test_sentencepiece_against_the_library(odd, empty):
    import sentencepiece as library
    from sentencepiece import sentencepiece_model_pb2 as pb
    pieces = sentencepiece.read_pieces()
    proto = pb.ModelProto()
    proto.ParseFromString(library.SentencePieceProcessor(model_file=sentencepiece.VOCABULARY).serialized_model_proto())
    proto.trainer_spec.model_type = pb.TrainerSpec.UNIGRAM
    for p, (_, score, kind) in zip(proto.pieces, pieces):
        p.score = score if kind == "normal" else 0.0
    judge = library.SentencePieceProcessor(model_proto=proto.SerializeToString())
    m = sentencepiece.make_model(pieces)
    texts = [t for _, t in rows(odd) if t and "\x00" not in t] + ["Hello  world, this is unigram text\n\ttabs é漢字 😀", "a" * 200, " lead", "trail  "]
    ids, at = sentencepiece.encode_texts(m, [t.encode() for t in texts])
    total = lambda x: sum(pieces[i][1] for i in x if pieces[i][2] == "normal")
    for k, t in enumerate(texts):
        own, other = ids[at[k]:at[k + 1]].tolist(), judge.encode(t)
        assert own == other or (abs(total(own) - total(other)) < 1e-3 * (1 + abs(total(own))) and judge.decode(own) == judge.decode(other))
    assert sentencepiece.decode_ids(m, ids.astype(np.int64), at) == [t.replace("▁", " ") for t in texts]
    back = sentencepiece.round_trip(odd)
    assert [r.doc_id for r in back.filter("not round_trip").collect()] == [i for i, t in rows(odd) if "▁" in (t or "")]
    assert sentencepiece.round_trip(empty).count() == 0


def test_viterbi_is_the_best_path():
    pieces = [("<unk>", 0.0, "control"), *((f"<0x{b:02X}>", 0.0, "byte") for b in range(256))]
    pieces += [("▁", -2.0, "normal"), ("a", -3.0, "normal"), ("b", -3.5, "normal"), ("ab", -4.0, "normal"), ("▁a", -4.2, "normal"), ("ba", -5.9, "normal"), ("▁▁", -2.5, "normal")]
    m = sentencepiece.make_model(pieces)
    score = {p.replace("▁", " "): s for p, s, k in pieces if k == "normal"}

    def best(t):
        b = [0.0] + [-math.inf] * len(t)
        for i in range(len(t)):
            for j in range(i + 1, len(t) + 1):
                s = score.get(t[i:j], m.unknown if j == i + 1 else -math.inf)
                b[j] = max(b[j], b[i] + s)
        return b[-1]
    for t in ("abab", "ba  ab", "aéb", "  ", "abba ab漢", "ab" * 60):
        ids, _ = sentencepiece.encode_texts(m, [t.encode()])
        got = sum(pieces[i][1] for i in ids if pieces[i][2] == "normal") + m.unknown * sum(ord(c) > 127 for c in t)
        assert math.isclose(got, best(" " + t), rel_tol=1e-9), t


def test_chat(spark):
    nasty = "~0 ~1 <|end|><|turn|>user<|text|> [/INST] </s> \\ é"
    data = [(1, 2, "assistant", nasty, 0), (1, 1, "user", None, 0), (1, 0, "system", "s", 0), (2, 0, "assistant", "x", 0), (3, None, None, "", 0),
            (4, 0, "user", "q", 0), (4, 1, "assistant", "a", 0), (4, 1, "assistant", "a", 0), (None, 0, "us<er", "t", 0)]
    df = spark.createDataFrame(data, "conv_id long, turn long, role string, text string, valid int")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(df)).collect()}
    assert [(t.role, t.text) for t in got[1].turns] == [("system", "s"), ("user", ""), ("assistant", nasty)]
    assert got[1].valid and got[1].loss_text == nasty and got[4].loss_text == "aa" and not got[4].valid
    assert not got[2].valid and not got[3].valid and [(t.role, t.text) for t in got[None].turns] == [("us<er", "t")]
    assert "</s>" not in got[1].formatted and got[1].formatted.count("<|end|>") == 3
    assert chat.format_chats(df.limit(0)).count() == 0


def test_toxicity_lexicon():
    lex = toxicity.Lexicon({" idiot ": 3.0, " scum": 2.0}, [toxicity.fold("scumble paint")], 0.5)
    assert lex.score("you 1D10T!") > 0.5 and lex.score("you іdіоt") > 0.5 and lex.score("ＩＤＩＯＴ") > 0.5
    assert lex.score("idiotic") == lex.score(None) == lex.score("") == 0.0
    assert lex.score("the scumble paint dries") == 0.0 < lex.score("scumble the paint")
    assert lex.score("idiot " + "word " * 5000) < lex.score("idiot")


def test_toxicity_learns_exceptions(spark):
    filler = lambda i: " ".join(f"w{chr(97 + (i * k) % 26)}q" for k in range(1, 8))
    data = [(i, f"{filler(i)} scum{chr(97 + i % 26)}{chr(97 + i // 26)}", 1) for i in range(90)]
    data += [(100 + i, f"{filler(i)} {'scumble paint' if i < 5 else 'paint'}", 0) for i in range(100)]
    data += [(300 + i, f"{filler(i)} scummed", i % 2) for i in range(2)]  # found in toxic rows too: no exception
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    lex = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    assert " scum" in lex.terms and lex.exceptions == [" scumble "]
    assert lex.score("a scumble dries") == 0.0 and lex.score("a scumzz dries") >= 0.5
    scored = {r.doc_id: r.score for r in toxicity.score(df, lex).collect()}
    assert all(scored[i] == 0.0 for i in range(100, 105)) and all(scored[i] >= 0.5 for i in range(90))


def test_toxicity_held_out(spark, empty):
    from tests.conftest import SF01
    docs, labels = (spark.read.parquet(f"{SF01}/{t}.parquet") for t in ("documents", "labels"))
    out = toxicity.op2_toxicity(spark, SF01).join(labels, "doc_id").filter("held_out").select("predicted", "toxic").collect()
    toxic = [r.predicted for r in out if r.toxic == 1]
    assert sum(r.predicted == r.toxic for r in out) >= 0.9 * len(out) and sum(toxic) >= 0.6 * len(toxic)
    lex = toxicity.learn(docs, labels.limit(0))
    assert toxicity.score(docs.limit(5), lex).agg(F.max("score")).first()[0] == 0.0
    assert toxicity.score(empty, lex).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline
    from tests.conftest import SF001
    out = corpus_pipeline.run(spark, SF001)
    docs = spark.read.parquet(f"{SF001}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF001)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    m = sentencepiece.make_model(sentencepiece.read_pieces())
    want = Counter()
    for i, t in rows(docs):
        want[i, tuple(sentencepiece.encode_texts(m, [(t or "").encode()])[0].tolist())] += 1
    assert Counter((r.doc_id, tuple(r.ids)) for r in out.collect()) == want and want


def plain_quality(docs, min_group=200):
    """(doc_id, text, lang, source) rows that pass stage 1, in plain Python."""
    judged = []
    for row in docs:
        t = row[1] or ""
        w, ls = SPLIT.findall(t), [x for x in t.split("\n") if SPLIT.search(x)]
        grams = Counter(tuple(w[k:k + 5]) for k in range(len(w) - 4))
        again = len({p for k in range(len(w) - 4) if grams[tuple(w[k:k + 5])] > 1 for p in range(k, k + 5)})
        chars = sum(map(len, w))
        per = lambda a, b, unit: a * unit // b if b else 0
        m = {"word_len": per(chars, len(w), 1000), "symbols": per(sum(t.count(c) for c in "#*$%&|<>"), chars, 10 ** 6),
             "dup_lines": per(len(ls) - len(set(ls)), len(ls), 10 ** 6), "repeats": per(again, len(w), 10 ** 6)}
        if len(w) >= 10 and 100 * again <= 20 * len(w):
            judged.append((row, m))

    def fence(row, k):
        for same in (lambda r: r[2:4] == row[2:4], lambda r: r[2] == row[2], lambda r: True):
            v = sorted((m[k] >> max(m[k].bit_length() - 6, 0)) << max(m[k].bit_length() - 6, 0) for r, m in judged if same(r))
            if len(v) >= min_group:
                break
        q1, q3 = v[-(-len(v) // 4) - 1], v[-(-3 * len(v) // 4) - 1]
        width = max((q3 - q1) * quality.RULES[k]["reach"], quality.RULES[k]["slack"])
        return q1 - width if quality.RULES[k]["low"] else -1, q3 + width
    fences = {(r[2:4], k): fence(r, k) for r in {r[2:4]: r for r, _ in judged}.values() for k in quality.RULES}
    return [r for r, m in judged if all(a <= m[k] <= b for k in m for a, b in [fences[r[2:4], k]])]


def plain_line_dedup(docs, min_docs=10):
    key = lambda x: re.sub("[A-Z]", lambda m: m[0].lower(), x.strip(" \t\n\v\f\r"))
    seen = {}
    for i, t, *_ in docs:
        for x in (t or "").split("\n"):
            seen.setdefault(key(x), set()).add((i, t if i is None else None))
    return [(i, "\n".join(x for x in (t or "").split("\n") if not key(x) or len(seen[key(x)]) < min_docs), *r) for i, t, *r in docs]


def plain_near_dedup(docs, width=5):
    sets = []
    for _, t, *_ in docs:
        w = SPLIT.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k:k + width]) for k in range(max(len(w) - width + 1, 1))} if w else set())
    comp = list(range(len(docs)))
    for a, x in enumerate(sets):
        for b, y in enumerate(sets[:a]):
            if x and y and comp[a] != comp[b] and 100 * len(x & y) >= 80 * len(x | y):
                comp = [comp[b] if c == comp[a] else c for c in comp]
    kept = []
    for c in sorted(set(comp)):
        rows_ = [d for d, k in zip(docs, comp) if k == c]
        ids = [d[0] for d in rows_ if d[0] is not None]
        least = [d for d in rows_ if d[0] == min(ids)] if ids else rows_
        assert len(set(least)) == 1 or not ids  # the fixture leaves no choice
        kept += least[:1] if ids and sets[comp.index(c)] else least
    return kept


def test_pipeline_against_plain_stages(spark, tmp_path):
    import corpus_pipeline
    from tests.llm.conftest import odd_rows
    docs = [r[:4] for r in odd_rows(n=120)]
    spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, lang string, source string, n_chars long") \
        .select("doc_id", "text", "lang", "source", "n_chars").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    stage = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for (_, spark_stage), plain in zip(corpus_pipeline.STAGES, (plain_quality, plain_line_dedup, plain_near_dedup)):
        before, docs = docs, plain(docs)
        assert Counter(docs) != Counter(before)
        stage = spark_stage(spark, stage, str(tmp_path))
        assert bag(stage, "doc_id", "text", "lang", "source") == Counter(docs)
    size = Counter()
    for _, t, _, s in docs:
        size[s] += len(SPLIT.findall(t))
    order = sorted(size, key=lambda s: (s is None, (s or "").encode()))
    w, fixed = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, set()
    while True:
        share = (1.5 * sum(size.values()) - sum(2 * size[s] for s in fixed)) / (sum(w[s] for s in order if s not in fixed) or 1)
        goal = {s: 2.0 * size[s] if s in fixed else share * w[s] for s in order}
        over = {s for s in order if s not in fixed and goal[s] > 2 * size[s]}
        if not over:
            break
        fixed |= over
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    copies, pool = Counter((r.doc_id, r.decoded, r.lang, r.source) for r in out), Counter((i, t.replace("▁", " "), *r) for i, t, *r in docs)
    assert all(n <= 2 * pool[k] for k, n in copies.items())
    for s in order:
        taken = sum(n * len(SPLIT.findall(k[1])) for k, n in copies.items() if k[3] == s)
        assert abs(taken - goal[s]) <= 2 * max(len(SPLIT.findall(t)) for _, t, _, x in docs if x == s)
    marked = {(i, t.replace("▁", " ")) for i, t, *_ in docs if "▁" in t}
    m = sentencepiece.make_model(sentencepiece.read_pieces())
    for r in out:
        assert r.round_trip == ((r.doc_id, r.decoded) not in marked)
        assert r.ids == sentencepiece.encode_texts(m, [r.decoded.encode()])[0].tolist()


def test_sentencepiece_runs_do_not_change_ids(monkeypatch):
    import numpy as np
    from agora.llm import sentencepiece as sp
    from tests.llm.conftest import odd_rows
    m = sp.make_model(sp.read_pieces())
    texts = [(r[1] or "").encode() for r in odd_rows()]
    whole, at = sp.encode_texts(m, texts)
    monkeypatch.setattr(sp, "RUN", 50)
    ids, at2 = sp.encode_texts(m, texts)
    assert np.array_equal(whole, ids) and np.array_equal(at, at2)


def test_sentencepiece_clashing_names(odd, empty):
    df = odd.select("doc_id", F.col("text").alias("body"), F.lit("mine").alias("ids"), F.lit("more").alias("_ids"), F.lit(1).alias("decoded"))
    out = sentencepiece.encode(df, text="body", back=True)
    assert out.columns == ["doc_id", "__ids", "_ids", "_decoded", "ids", "decoded", "round_trip"]
    assert {(r["__ids"], r["_ids"], r["_decoded"]) for r in out.collect()} == {("mine", "more", 1)}
    again = sentencepiece.decode(sentencepiece.encode(df, text="body"))
    assert again.columns == ["doc_id", "body", "__ids", "_ids", "_decoded", "ids", "decoded"]
    assert all(r.decoded == (r.body or "").replace("▁", " ") for r in again.collect())
    assert sentencepiece.encode(empty.withColumn("ids", F.lit(0)), back=True).count() == 0
