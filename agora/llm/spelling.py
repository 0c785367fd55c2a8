"""Spelling variants: words of a corpus vocabulary that differ by one inserted, deleted or replaced code point, each
word led to its most frequent spelling.

Near words are found in a bit-sliced position index. For a block of vocabulary words the index holds, for every
(position, letter), the set of words with that letter there, as bits. A query word of m letters is read letter by letter
while three sets of the block's words are kept as bit vectors: those equal so far; those with one letter replaced; and
those with one letter more, whose remaining letters stand one position further on, so they meet the index at shifted
positions. One step of all sets is a few AND / OR over machine words. A pair is found from its shorter word, so
deletions are insertions seen from the other side.

1. Tokens are counted per batch and summed by word (map-side partial sums first); words under ``least`` are dropped.
2. Blocks: two words at distance one whose shorter has m letters share its first m // 2 letters or the last m - m // 2.
   Words are grouped by (m, first or last, letters), in both roles that their length allows, and groups are strung
   together into blocks of about ``BLOCK`` words of one m. A group of more than ``HOT`` words is dealt to several
   blocks by hash, and its queries go to each of them in a stream, so no task holds a group.
3. Each word's number of near words and most frequent one are partial aggregates; chains of forms are followed by
   pointer jumping joins until nothing changes (occurrences grow by ``ratio`` a step, so chains end).

Defined results: a null text has no tokens; a null doc_id is written as the empty text before the colon; repeated rows
count as often as they occur; ties go to the smaller word in code-point order; a text of one long run is one token;
an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from agora.llm.common import cut, text_chunks
from agora.llm.units import distinct
from agora.session import broadcast_if_small

BLOCK, HOT, LONG = 1024, 4096, 48
LETTER = np.zeros(256, bool)
LETTER[ord("A"):ord("Z") + 1] = LETTER[ord("a"):ord("z") + 1] = True
#: U+00C0 to U+00FF are this byte and a continuation byte.
LATIN = 0xC3


def crc_table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = (t >> np.uint32(1)) ^ np.where(t & np.uint32(1), np.uint32(0xEDB88320), np.uint32(0))
    return t


CRC = crc_table()


def crc_of(data: np.ndarray, starts: np.ndarray, lens: np.ndarray, state: np.ndarray) -> np.ndarray:
    """CRC-32 of byte ranges, going on from ``state`` (the CRC of what stands before); all ranges step together, those of
    over ``LONG`` bytes by themselves."""
    out = np.empty(len(starts), np.uint32)
    long = np.flatnonzero(lens > LONG)
    for k in long.tolist():
        out[k] = zlib.crc32(data[starts[k]:starts[k] + lens[k]].tobytes(), int(state[k]))
    order = np.argsort(-lens, kind="stable")[len(long):]
    at, c = starts[order], ~state[order]
    left = np.bincount(lens[order], minlength=LONG + 1) if len(order) else np.zeros(LONG + 1, int)
    active = len(order) - np.cumsum(left)
    for k in range(LONG):
        n = int(active[k])
        if not n:
            break
        c[:n] = CRC[(c[:n] ^ data[at[:n] + k]) & np.uint32(255)] ^ (c[:n] >> np.uint32(8))
    out[order] = ~c
    return out


def tokens(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased letters of all tokens in a row, where each token begins (one more), and the row of each."""
    if len(buf) < 2:
        buf = np.append(buf, np.zeros(2, np.uint8))
    lead = buf == LATIN
    inside = LETTER[buf] | lead
    inside[1:] |= lead[:-1]
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    edge = offs[1:-1]
    edge = edge[edge < len(buf)]
    first[edge] = inside[edge]
    data = buf[inside]
    data = np.where((data >= 0x41) & (data <= 0x5A), data | 0x20, data).astype(np.uint8)
    begin = np.flatnonzero(first)
    row = np.searchsorted(offs, begin, "right") - 1
    return data, np.append(np.cumsum(inside)[begin] - 1, len(data)).astype(np.int64), row


def word_counts(docs: DataFrame, letters: int = 6, every: int = 199) -> DataFrame:
    """(word, n) of partial counts: tokens whose CRC-32 with their doc_id ``every`` divides have lost a code point."""
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_pylist()
            for i, _, buf, offs in text_chunks(batch, limit=8 << 20):
                data, at, row = tokens(buf, offs)
                if len(at) < 2:
                    continue
                size = np.diff(at)
                points = size - np.diff(np.concatenate([[0], np.cumsum(data == LATIN)])[at])
                own = np.flatnonzero(points >= letters)
                before = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids[i:i + len(offs) - 1]], np.uint32)
                h = crc_of(data, at[own], size[own], before[row[own]])
                hit = h % np.uint32(every) == 0
                counted = np.zeros(len(size), bool)
                counted[own[~hit]] = True
                words, which = distinct(data[np.repeat(counted, size)], np.concatenate([[0], np.cumsum(size[counted])]))
                n = np.bincount(which, minlength=len(words)).tolist()
                words = [w.decode() for w in words.to_pylist()]
                for k, x in zip(own[hit].tolist(), h[hit].tolist()):
                    w = data[at[k]:at[k + 1]].tobytes().decode()
                    if len(w) > letters:
                        cutoff = x % len(w)
                        words.append(w[:cutoff] + w[cutoff + 1:])
                        n.append(1)
                yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(n, pa.int64())], names=["word", "n"])

    return docs.select(F.col("doc_id").cast("string"), "text").mapInArrow(run, "word string, n long")


# ------------------------------------------------------------------ the index of a block

class Block:
    """(position, letter) bit sets over some words, given as rows of code points (0 beyond the end)."""

    def __init__(self, points: np.ndarray, lens: np.ndarray):
        n = len(points)
        self.lens, self.words = lens, -(-n // 64)
        self.letters = np.unique(points[points > 0])
        member, place = np.nonzero(points)
        sets = np.zeros((points.shape[1] + 1, len(self.letters) + 1, self.words * 64), bool)
        sets[place, np.searchsorted(self.letters, points[member, place]), member] = True
        self.sets = self.pack(sets)

    def pack(self, bits: np.ndarray) -> np.ndarray:
        return np.packbits(bits, axis=-1, bitorder="little").view("<u8")

    def of_length(self, m: int) -> np.ndarray:
        bits = np.zeros(self.words * 64, bool)
        bits[:len(self.lens)] = self.lens == m
        return self.pack(bits)

    def near(self, points: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) for the words that differ from a query of ``m`` letters by one replaced or one added letter."""
        at = np.searchsorted(self.letters, points)
        at = np.where(self.letters[np.minimum(at, len(self.letters) - 1)] == points, at, len(self.letters))
        same = np.full((len(points), self.words), ~np.uint64(0))
        replaced, longer = np.zeros_like(same), np.zeros_like(same)
        for p in range(m):
            here, shifted = self.sets[p][at[:, p]], self.sets[p + 1][at[:, p]]
            longer = (longer | same) & shifted
            replaced = (replaced & here) | (same & ~here)
            same &= here
        found = (replaced & self.of_length(m)) | ((longer | same) & self.of_length(m + 1))
        hit = np.flatnonzero(found.any(axis=1))
        q, w = np.nonzero(np.unpackbits(found[hit].view(np.uint8), axis=1, bitorder="little"))
        return hit[q], w


def code_points(words: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    lens = words.str.len().to_numpy().astype(np.int64)
    width = max(int(lens.max(initial=0)), 1)
    return np.array(words.tolist(), dtype=f"<U{width}").view("<u4").reshape(len(words), width), lens


def _pairs_of(part: pd.DataFrame) -> pd.DataFrame:
    """Both directions of the near pairs within groups of one m; a pair of the last-letters kind that also shares the
    first letters is left to that kind."""
    m = int(part["m"].iat[0])
    points, lens = code_points(part["word"])
    group, role = part["group"].to_numpy(), part["role"].to_numpy()
    held, asks = np.flatnonzero(role != 1), np.flatnonzero((role != 0) & (lens == m))
    if not len(held) or not len(asks):
        return part.iloc[:0][["word", "n"]].assign(other="", other_n=0)
    points = points[:, :min(points.shape[1], m + 1)] if points.shape[1] > m + 1 else np.pad(points, ((0, 0), (0, m + 1 - points.shape[1])))
    index = Block(points[held], lens[held])
    out = []
    for x in range(0, len(asks), BLOCK):
        mine = asks[x:x + BLOCK]
        q, w = index.near(points[mine][:, :m], m)
        q, w = mine[q], held[w]
        ok = group[q] == group[w]
        last = part["last"].to_numpy()[q]
        ok &= ~last | (points[q][:, :m // 2] != points[w][:, :m // 2]).any(axis=1)
        out.append((q[ok], w[ok]))
    q, w = (np.concatenate(x) for x in zip(*out))
    word, n, both = part["word"].to_numpy(), part["n"].to_numpy(), lens[q] != lens[w]
    # words of equal length find each other; the longer one does not ask
    a, b = np.concatenate([q, w[both]]), np.concatenate([w, q[both]])
    return pd.DataFrame({"word": word[a], "n": n[a], "other": word[b], "other_n": n[b]})


def filled(pdf: pd.DataFrame) -> list[pd.DataFrame]:
    return [pdf] if len(pdf) else []


def _search(batches):
    """Near pairs of rows sorted by m, last, letters, sub and role: whole groups are strung into blocks; of a group larger
    than a block the indexed rows are kept and the queries stream past."""
    rest = None
    for pdf in batches:
        rest = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
        while len(rest) >= 2 * BLOCK:
            key = rest[["m", "last", "letters", "sub"]]
            fresh = (key != key.shift()).any(axis=1).to_numpy()
            fresh[0] = False
            borders = np.flatnonzero(fresh)
            if not len(borders):
                if (rest["role"] == 1).sum() < HOT:
                    break
                yield from filled(_pairs_of(rest.assign(group=0)))
                rest = rest[rest["role"] != 1].reset_index(drop=True)
                break
            new_m = borders[rest["m"].to_numpy()[borders] != rest["m"].iat[0]]
            upto = borders[borders >= min(BLOCK, borders[-1])][0]
            upto = min(upto, new_m[0]) if len(new_m) else upto
            yield from filled(_pairs_of(rest.iloc[:upto].assign(group=np.cumsum(fresh)[:upto])))
            rest = rest.iloc[upto:].reset_index(drop=True)
    while rest is not None and len(rest):
        key = rest[["m", "last", "letters", "sub"]]
        fresh = (key != key.shift()).any(axis=1).to_numpy()
        other = np.flatnonzero(rest["m"].to_numpy() != rest["m"].iat[0])
        upto = other[0] if len(other) else len(rest)
        yield from filled(_pairs_of(rest.iloc[:upto].assign(group=np.cumsum(fresh)[:upto])))
        rest = rest.iloc[upto:].reset_index(drop=True)


def near_pairs(vocabulary: DataFrame, shortest: int) -> DataFrame:
    """(word, n, other, other_n) for all ordered pairs of words, of ``shortest`` code points at least, at distance one."""
    size = F.length("word")
    keyed = (vocabulary.withColumn("m", F.explode(F.array(size, size - 1))).filter(F.col("m") >= shortest)
             .withColumn("last", F.explode(F.array(F.lit(False), F.lit(True))))
             .withColumn("half", F.floor(F.col("m") / 2).cast("int"))
             .withColumn("letters", F.when(F.col("last"), F.expr("right(word, m - half)")).otherwise(F.expr("left(word, half)"))).drop("half"))
    keys = ["m", "last", "letters"]
    hot = cut(keyed.groupBy(*keys).count().filter(F.col("count") > HOT).select(*keys, F.ceil(F.col("count") / HOT).alias("parts")), "spelling-hot")
    dealt = keyed.join(broadcast_if_small(hot), keys, "left")
    cold = dealt.filter("parts IS NULL").select(*keys, F.lit(0).cast("long").alias("sub"), F.lit(2).alias("role"), "word", "n")
    held = dealt.filter("parts IS NOT NULL").select(*keys, F.pmod(F.xxhash64("word"), "parts").alias("sub"), F.lit(0).alias("role"), "word", "n")
    asks = (dealt.filter((F.col("parts").isNotNull()) & (size == F.col("m")))
            .select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("sub"), F.lit(1).alias("role"), "word", "n"))
    rows = cold.unionByName(held).unionByName(asks)
    return (rows.repartition(*keys, "sub").sortWithinPartitions(*keys, "sub", "role", "word")
            .mapInPandas(_search, "word string, n long, other string, other_n long"))


def follow(forms: DataFrame) -> DataFrame:
    """(word, root): forms (word, form) followed to the last one, by pointer jumping joins."""
    links = cut(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    n = 0
    while True:
        up = links.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(links.join(up, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), f"spelling-roots-{n}")
        links, n = step.select("word", "root"), n + 1
        if step.filter("moved").isEmpty():
            return links


def group_variants(docs: DataFrame, letters: int = 6, least: int = 5, ratio: int = 5, every: int = 199) -> DataFrame:
    """word, form, root, n, n_near and form_n, one row for each word of the vocabulary."""
    words = cut(word_counts(docs, letters, every).groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least), "spelling-words")
    near = near_pairs(words, letters).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("n"), "other")).alias("top"))
    top_n = -F.col("top.n")
    led = cut(words.join(near, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), *(F.when(top_n >= ratio * F.col("n"), x).alias(a) for x, a in ((F.col("top.other"), "form"), (top_n, "form_n")))), "spelling-forms")
    roots = follow(led.filter("form IS NOT NULL"))
    return led.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling(spark, sf_dir: str) -> DataFrame:
    return group_variants(spark.read.parquet(f"{sf_dir}/documents.parquet"))


#: U+00C0 to U+00FF written as one byte each, so that levenshtein, which counts bytes, counts code points.
_LATIN = "".join(map(chr, range(0xC0, 0x100)))
_SIGNS = "".join(chr(c) for c in range(0x21, 0x61) if chr(c) != "'") + "{"
_UPPER, _LOWER = "".join(map(chr, range(65, 91))), "".join(map(chr, range(97, 123)))

#: CRC-32 is linear over bits: each byte, by its distance from the end, adds a value of its own.
OP11_SQL = f"""
WITH RECURSIVE runs AS MATERIALIZED (
  SELECT doc, word, count(*) AS times FROM (
    SELECT coalesce(doc_id::VARCHAR, '') AS doc, translate(unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')), '{_UPPER}', '{_LOWER}') AS word FROM documents)
  WHERE length(word) >= 6 GROUP BY doc, word),
one AS (SELECT range AS b, list_reduce([range::BIGINT] || range(8), lambda c, k: xor(c >> 1, CASE WHEN c & 1 = 1 THEN 3988292384 ELSE 0 END)) AS v FROM range(256)),
widest AS (SELECT max(strlen(doc) + 1 + strlen(word)) AS n FROM runs),
table_ AS (SELECT 0 AS d, b, v FROM one UNION ALL
  SELECT t.d + 1, t.b, xor(t.v >> 8, one.v) FROM table_ t JOIN one ON one.b = t.v & 255 WHERE t.d + 1 < (SELECT n FROM widest)),
texts AS (SELECT doc, word, doc || ':' || word AS s FROM runs),
signs AS (SELECT doc, word, s, unnest(range(1, length(s) + 1)) AS i FROM texts),
points AS (SELECT doc, word, ord(substring(s, i, 1)) AS c, strlen(substring(s, i + 1)) AS after FROM signs),
bytes AS (SELECT doc, word, after AS d, CASE WHEN c < 128 THEN c ELSE c - 64 END AS b FROM points UNION ALL SELECT doc, word, after + 1, 195 FROM points WHERE c >= 128),
sums AS (SELECT doc, word, max(d) AS d, bit_xor(v) AS v FROM bytes JOIN table_ USING (d, b) GROUP BY doc, word),
-- the register begins with ones: as if the first four bytes were inverted, as all runs with their prefix have over four
flips AS (SELECT t0.d, xor(xor(t0.v, t1.v), xor(t2.v, t3.v)) AS v FROM table_ t0 JOIN table_ t1 ON t1.d = t0.d - 1 AND t1.b = 255
  JOIN table_ t2 ON t2.d = t0.d - 2 AND t2.b = 255 JOIN table_ t3 ON t3.d = t0.d - 3 AND t3.b = 255 WHERE t0.b = 255),
hashes AS (SELECT doc, word, xor(xor(sums.v, flips.v), 4294967295) AS h FROM sums JOIN flips USING (d)),
results AS (SELECT CASE WHEN h % 199 = 0 THEN substring(word, 1, h % length(word)) || substring(word, h % length(word) + 2) ELSE word END AS word, times FROM hashes JOIN runs USING (doc, word)),
words AS MATERIALIZED (SELECT word, sum(times)::BIGINT AS n, translate(word, '{_LATIN}', '{_SIGNS}') AS flat FROM results WHERE length(word) >= 6 GROUP BY word HAVING sum(times) >= 5),
pairs AS MATERIALIZED (SELECT a.word, a.n, b.word AS other, b.n AS other_n FROM words a JOIN words b ON abs(length(a.word) - length(b.word)) <= 1 AND a.word <> b.word AND levenshtein(a.flat, b.flat) = 1),
near AS (SELECT word, count(*) AS n_near FROM pairs GROUP BY word),
best AS (SELECT word, other, other_n FROM pairs QUALIFY row_number() OVER (PARTITION BY word ORDER BY other_n DESC, other) = 1),
forms AS MATERIALIZED (SELECT word, other AS form, other_n AS form_n FROM best JOIN words USING (word) WHERE other_n >= 5 * n),
chains AS (SELECT word, form AS root, 1 AS steps FROM forms UNION ALL SELECT c.word, f.form, c.steps + 1 FROM chains c JOIN forms f ON f.word = c.root),
ends AS (SELECT word, arg_max(root, steps) AS root FROM chains GROUP BY word)
SELECT word, form, coalesce(root, word) AS root, n, coalesce(n_near, 0) AS n_near, form_n
FROM words LEFT JOIN near USING (word) LEFT JOIN forms USING (word) LEFT JOIN ends USING (word)"""
