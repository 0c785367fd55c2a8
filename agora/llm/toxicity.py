"""Toxicity by a weighted lexicon, matched by Aho-Corasick over folded text.

Folding: lower case, look-alike letters of other scripts and full-width forms to Latin, digits and signs that stand for
letters to these letters, everything else that is no letter to a space. Terms are whole words or beginnings of words. A
hit inside an exception phrase doesn't count. The weights of the hits are summed and divided by a slowly growing
function of the text's length; the score is that density against the cutoff that parts the training rows best.

The lexicon is learned from labelled rows (at most about ``FIT_ROWS`` of them, chosen by a hash of doc_id). That bound is
the only one: terms are counted and held to the purity test in Spark, and every term that passes is kept, so terms and
exceptions are bounded by what the sample's texts hold. A term's weight is its log odds among toxic documents.
Exceptions are words that begin with a term, but are found in clean documents only, and the caller's phrases. Neither
doc_id, lang, source nor labels enter a score.

Defined results: null and empty texts score 0; without labelled rows of both kinds the lexicon is empty and every score
is 0; rows that repeat score alike; a doc_id labelled twice counts as toxic if once; other columns are ignored.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

FIT_ROWS = 20_000
LEAST, PURE = 4, 0.9
HELD = 1 << 15

# Look-alike letters, and digits and signs that stand for letters.
LOOKALIKES = {
    "а": "a", "в": "b", "с": "c", "е": "e", "ё": "e", "һ": "h", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "о": "o",
    "р": "p", "ѕ": "s", "т": "t", "у": "y", "х": "x", "α": "a", "β": "b", "ε": "e", "ι": "i", "κ": "k", "ν": "v", "ο": "o",
    "ρ": "p", "τ": "t", "υ": "u", "χ": "x", "ı": "i",
}
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s"}


class _Table(dict):
    def __missing__(self, code: int) -> str:
        c = chr(code)
        if 0xFF01 <= code <= 0xFF5E:
            c = chr(code - 0xFEE0).lower()
        c = LOOKALIKES.get(c, DIGITS.get(c, c))
        self[code] = c if c.isalpha() else " "
        return self[code]


TABLE = _Table()


def fold(text: str) -> str:
    """Words of letters with one space or more between, and around."""
    return f" {text.lower().translate(TABLE)} "


def _terms(words: set[str]) -> set[str]:
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in range(4, 8) if len(w) > k}


def _holders(words: set[str], open_: frozenset) -> set[str]:
    """The whole words that begin with one of the open terms."""
    return {f" {w} " for w in words if any(f" {w[:k]}" in open_ for k in range(4, 8))}


def _count(pick: Callable[[set[str]], set[str]]):
    def rows_of(seen: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.string()), pa.array(seen.values(), pa.int64())], names=["term", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = Counter()
        for batch in batches:
            for text in batch.column(0):
                seen.update(pick(set(fold(text.as_py() or "").split())))
                if len(seen) >= HELD:  # partial counts, summed by Spark: a worker holds about this many terms
                    yield rows_of(seen)
                    seen = Counter()
        if seen:
            yield rows_of(seen)
    return run


def _counts(texts: DataFrame, pick: Callable[[set[str]], set[str]] = _terms) -> DataFrame:
    return texts.select("text").mapInArrow(_count(pick), "term string, n long").groupBy("term").agg(F.sum("n").alias("n"))


class Lexicon:
    """terms: weight by term; exceptions: folded phrases; cutoff: the density with score 0.5."""

    def __init__(self, terms: dict[str, float], exceptions: list[str] = (), cutoff: float = 1.0):
        self.terms, self.exceptions, self.cutoff = terms, list(exceptions), cutoff
        self._machine = None

    def __getstate__(self):
        return self.terms, self.exceptions, self.cutoff

    def __setstate__(self, state):
        self.__init__(*state)

    def density(self, text: str | None) -> float:
        if not text or not self.terms:
            return 0.0
        if self._machine is None:
            self._machine = ahocorasick.Automaton()
            for t, w in self.terms.items():
                self._machine.add_word(t, (len(t), w))
            for e in self.exceptions:
                self._machine.add_word(e, (len(e), None))
            self._machine.make_automaton()
        folded = fold(text)
        hits, spared = [], []
        for end, (n, w) in self._machine.iter(folded):
            (hits if w is not None else spared).append((end + 1 - n, end + 1, w))
        if not hits:
            return 0.0
        total, i, reach = 0.0, 0, -1
        spared.sort()
        for a, b, w in sorted(hits):
            while i < len(spared) and spared[i][0] <= a:
                reach = max(reach, spared[i][1])
                i += 1
            total += w * (b > reach)
        return total / math.log(math.e + folded.count(" ") / 100)

    def score(self, text: str | None) -> float:
        d = self.density(text)
        return d / (d + self.cutoff)


def learn(docs: DataFrame, labels: DataFrame, exceptions: tuple[str, ...] = (), fit_rows: int = FIT_ROWS) -> Lexicon:
    marks = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    part = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20))
    n = marks.count()
    chosen = marks.filter(part < (1 << 20) * min(1.0, fit_rows / max(n, 1)))  # about fit_rows ids: a bounded broadcast
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").filter("text is not null").persist()
    try:
        toxic, clean = sample.filter("toxic = 1"), sample.filter("toxic = 0")
        n1, n0 = toxic.count(), clean.count()
        if not n1 or not n0:
            return Lexicon({})
        least = max(LEAST, n1 // 500)
        both = (_counts(toxic).filter(F.col("n") >= least).withColumnRenamed("n", "a")
                .join(_counts(clean).withColumnRenamed("n", "b"), "term", "left").fillna(0, "b").filter(F.col("a") >= PURE * (F.col("a") + F.col("b"))))
        weight = {}
        for t, a, b in sorted(both.select("term", "a", "b").collect(), key=lambda x: (len(x[0].strip()), x[0])):
            w = math.log((a + 0.5) / (n1 + 1)) - math.log((b + 0.5) / (n0 + 1))
            # a longer term must say more than the shorter ones that it holds
            if not any(weight.get(t[:k], -1) >= w - 0.7 for k in range(5, len(t))):
                weight[t] = w
        spared = [fold(e) for e in exceptions]
        open_ = frozenset(t for t in weight if not t.endswith(" "))
        if open_:
            holders = lambda words: _holders(words, open_)
            harmless = _counts(clean, holders).filter(F.col("n") >= LEAST).join(_counts(toxic, holders), "term", "left_anti")
            spared += sorted(r.term for r in harmless.collect())
        lexicon = Lexicon(weight, spared)
        rows = sample.select("text", F.col("toxic").cast("int")).mapInArrow(_densities(lexicon), "d double, toxic int").collect()  # about fit_rows pairs
        d, y = np.array([r.d for r in rows]), np.array([r.toxic for r in rows])
        order = np.argsort(d)
        d, y = d[order], y[order]
        right = np.concatenate([[0], np.cumsum(y == 0)]) + np.concatenate([[0], np.cumsum((y == 1)[::-1])])[::-1]
        edges = np.flatnonzero(np.concatenate([[False], d[1:] > d[:-1], [True]])) if len(d) else []
        best = max(edges, key=lambda i: (right[i], -i), default=0)
        lexicon.cutoff = float((d[best - 1] + (d[best] if best < len(d) else 2 * d[best - 1])) / 2) or 1.0
        return lexicon
    finally:
        sample.unpersist()


def _densities(lexicon: Lexicon):
    def run(batches):
        for batch in batches:
            d = [lexicon.density(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(d, pa.float64()), batch.column(1)], names=["d", "toxic"])
    return run


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id and score of each row."""
    def run(batches):
        for batch in batches:
            s = [lexicon.score(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s, pa.float64())], names=["doc_id", "score"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def op2_toxicity(spark, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.crc32(F.col("doc_id").cast("string")) % 5 == 0
    scored = score(docs, learn(docs, labels.filter(~held_out)))
    return scored.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
