"""The learned lexicon and its scores against a plain learner without Spark and Aho-Corasick."""

import math
import random
from collections import Counter

import pytest

from agora.llm import toxicity


def plain_learn(data):
    """(terms, exceptions, cutoff) of (text, toxic) rows, by the rules of the docstring."""
    def terms(text):
        words = set(toxicity.fold(text).split())
        return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in (4, 5, 6, 7) if len(w) > k}
    a, b = (Counter(t for text, y in data if y == side for t in terms(text)) for side in (1, 0))
    n1, n0 = sum(y == 1 for _, y in data), sum(y == 0 for _, y in data)
    weight = {}
    for t in sorted(a, key=lambda t: (len(t.strip()), t)):
        if a[t] >= max(4, n1 // 500) and a[t] >= 0.9 * (a[t] + b[t]):
            w = math.log((a[t] + 0.5) / (n1 + 1)) - math.log((b[t] + 0.5) / (n0 + 1))
            if all(weight.get(t[:k], -1) < w - 0.7 for k in range(5, len(t))):
                weight[t] = w
    open_ = [t for t in weight if not t.endswith(" ")]
    whole = [Counter(w for text, y in data if y == side for w in set(toxicity.fold(text).split())) for side in (1, 0)]
    spared = sorted(f" {w} " for w, n in whole[1].items() if n >= 4 and w not in whole[0] and any(f" {w} ".startswith(t) and len(w) >= len(t) - 1 for t in open_))
    density = [(plain_density(text, weight, spared), y) for text, y in data]
    values = sorted({d for d, _ in density})
    best = None
    for lo, hi in zip(values, [*values[1:], None]):  # toxic above lo
        right = sum((d > lo) == (y == 1) for d, y in density)
        if best is None or right > best[0]:
            best = right, (lo + (hi if hi is not None else 2 * lo)) / 2
    return weight, spared, best[1] or 1.0


def plain_density(text, weight, spared):
    folded = toxicity.fold(text)

    def finds(t):
        return [(i, i + len(t)) for i in range(len(folded)) if folded.startswith(t, i)]
    out = [span for e in spared for span in finds(e)]
    total = sum(w for t, w in weight.items() for i, j in finds(t) if not any(x <= i and j <= y for x, y in out))
    return total / math.log(math.e + folded.count(" ") / 100)


@pytest.mark.parametrize("seed", [1, 2])
def test_learner_and_scores_against_plain(spark, seed):
    r = random.Random(seed)
    plain, bad = [f"{a}{b}lor{c}" for a in "bdf" for b in "ae" for c in "mnt"], ["vilethug", "scumlord", "m0r0n", "grotish"]
    mild = ["scumble", "grotto"]
    data = []
    for i in range(240):
        toxic = i % 4 == 0
        words = r.choices(plain, k=r.randint(3, 30)) + (r.choices(bad, k=r.randint(1, 3)) if toxic else r.choices(mild, k=i % 2))
        r.shuffle(words)
        data.append((" ".join(words), int(toxic)))
    data += [("", 0), ("scumlord " + plain[0], 0)]
    df = spark.createDataFrame([(i, t, y) for i, (t, y) in enumerate(data)], "doc_id long, text string, toxic int").repartition(3)
    lex = toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic"))
    weight, spared, cutoff = plain_learn(data)
    assert lex.terms == pytest.approx(weight) and lex.exceptions == spared and lex.cutoff == pytest.approx(cutoff)
    got = {x.doc_id: x.score for x in toxicity.score(df, lex).collect()}
    for i, (t, _) in enumerate(data):
        d = plain_density(t, weight, spared)
        assert got[i] == pytest.approx(d / (d + cutoff))


def test_every_pure_term_is_kept(spark):
    """More pure terms than any earlier bound on terms: 2,600 words, each in four toxic rows of its own block."""
    names = [f"x{''.join(chr(97 + (k // 26 ** j) % 26) for j in range(3))}" for k in range(2600)]
    data = [(i, " ".join(names[i // 4 * 100:i // 4 * 100 + 100]), 1) for i in range(104)] + [(1000 + i, "calm words only", 0) for i in range(20)]
    df = spark.createDataFrame(data, "doc_id long, text string, toxic int")
    assert len(toxicity.learn(df.select("doc_id", "text"), df.select("doc_id", "toxic")).terms) == 2600
