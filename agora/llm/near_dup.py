"""MinHash near-duplicate detection with tensored banding, links confirmed on the full shingle sets.

Two collections of ``tables`` band keys are made, each key of two minhashes. A table key combines one key of the first
collection with one of the second, so tables ** 2 tables come from 4 * tables minhashes. Documents whose single band
keys meet nobody's are set aside before any pair of keys is formed. At similarity 0.8 a pair shares a table with
probability (1 - (1 - 0.8 ** 2) ** tables) ** 2, over 0.99999 at 12.

Documents with equal sets are one class from the start. Classes that share a table are joined to the least class of
that table (never pair by pair), and every component of those candidate links is verified on the full sets: inside a
component, a class is compared with all others through an inverted index of shingles until the classes that were not
compared lie in one verified component, so no link between two verified components is left out. Small components share a
task. A large one is cut into blocks of about ``BLOCK_DOCS`` classes or ``BLOCK_BYTES`` of text, and each block is verified
with the same few classes (landmarks) of the component, which hold the blocks of one group of copies together. What that
leaves outside the largest verified component is then compared with all of the blocks; classes inside it need no more.

Defined results: texts are lower-cased in A-Z; a text of fewer than ``width`` words is one shingle; null, empty or
word-free texts have no set, are linked with nothing and are kept. Rows that repeat a text are linked, with whatever
doc_id. A null doc_id never is the least of a component; a row in a component without any doc_id has a null
component_id and, as the representative can't be named, stays.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import BASES, U64, Spans, cut, mix, own_prefix, text_chunks, text_key, word_hashes, word_spans
from agora.llm.graph import components, look_up

TABLES = 12
BLOCK_DOCS, BLOCK_BYTES = 2048, 8 << 20
#: Classes of a large component that every block of it is verified with. Classes of small components in a task.
LANDMARKS, SMALL_DOCS = 64, 256
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def shingles(buf: np.ndarray, offs: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of all shingles of a chunk in order, and where each row's begin (one more at the end)."""
    buf = LOWER[buf]
    starts, ends, first = word_spans(buf, offs)
    seq = Spans(word_hashes(buf, starts, ends), BASES[1])
    words = np.diff(first)
    count = np.where(words >= width, words - width + 1, (words > 0).astype(np.int64))
    at = np.concatenate([[0], np.cumsum(count)])
    a = np.repeat(first[:-1] - at[:-1], count) + np.arange(at[-1])
    b = a + np.repeat(np.minimum(words, width), count)
    return seq.of(a, b), at


def _signatures(width: int, tables: int):
    rng = np.random.Generator(np.random.PCG64(7))
    mult = rng.integers(0, 1 << 63, 4 * tables, dtype=np.uint64) * U64(2) + U64(1)
    add = rng.integers(0, 1 << 63, 4 * tables, dtype=np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, j, buf, offs in text_chunks(batch):
                s, at = shingles(buf, offs, width)
                full = np.flatnonzero(np.diff(at))
                least = np.empty((4 * tables, len(full)), dtype=np.uint64)
                for k in range(4 * tables if len(full) else 0):
                    least[k] = np.minimum.reduceat(s * mult[k] + add[k], at[full])
                keys = mix(least[0::2] * U64(0x9E3779B97F4A7C15) + least[1::2] + np.arange(2 * tables, dtype=np.uint64)[:, None])
                n, cls, sig = [0] * (j - i), [None] * (j - i), [None] * (j - i)
                bands = np.ascontiguousarray(keys.T).view(np.int64)
                for row, x in enumerate(full):
                    u = np.unique(s[at[x]:at[x + 1]])
                    n[x], cls[x], sig[x] = len(u), xxhash.xxh3_128_digest(u.data), bands[row]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(n, pa.int64()), pa.array(cls, pa.binary()),
                     pa.array(sig, pa.list_(pa.int64())), pa.array(np.diff(offs))], names=["doc_id", "tk", "n_shingles", "c", "sig", "n_bytes"])
    return run


def _candidates(classes: DataFrame, tables: int) -> DataFrame:
    """(a, b): b is the least class of a table that holds a."""
    bands = classes.select("c", F.posexplode("sig").alias("k", "h"))
    shared = bands.groupBy("k", "h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("k", "h")
    met = bands.join(shared, ["k", "h"]).groupBy("c").agg(F.collect_list(F.struct("k", "h")).alias("bands"))  # 2 * tables at most
    left = F.filter("bands", lambda x: x["k"] < tables)
    right = F.filter("bands", lambda x: x["k"] >= tables)
    pairs = (met.select("c", F.explode(left).alias("x"), right.alias("r")).select("c", "x", F.explode("r").alias("y"))
             .select("c", F.xxhash64("x.k", "y.k", "x.h", "y.h").alias("t"), F.xxhash64("y.h", "x.h", "y.k").alias("u")))
    pairs = cut(pairs, "tables")
    least = pairs.groupBy("t", "u").agg(F.min("c").alias("b"), F.max("c").alias("top")).filter("b <> top").select("t", "u", "b")
    links = pairs.join(least, ["t", "u"]).select(F.col("c").alias("a"), "b").distinct()
    # the least classes of one class's tables (tables ** 2 at most) are linked to the least of them, not to the class:
    # members of a large group share these few links
    links = links.withColumn("m", F.min("b").over(Window.partitionBy("a")))
    return links.select("a", F.col("m").alias("b")).unionByName(links.select(F.col("b").alias("a"), F.col("m").alias("b"))).filter("a <> b").distinct()


def verified_links(sets: list[np.ndarray], percent: int, label: np.ndarray | None = None, waiting: np.ndarray | None = None) -> np.ndarray:
    """For each set the index of a set in its component under 100 * |x & y| >= percent * |x | y|. With ``waiting``, all links
    between sets that don't wait are already in ``label``."""
    n = len(sets)
    lens = np.array([len(s) for s in sets])
    who = np.repeat(np.arange(n), lens)
    _, ids = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(ids, kind="stable")
    post = who[order]
    begin = np.concatenate([[0], np.cumsum(np.bincount(ids))])
    at = np.concatenate([[0], np.cumsum(lens)])
    label = np.arange(n) if label is None else label.copy()

    def compare(x: int) -> None:
        own = ids[at[x]:at[x + 1]]
        a, c = begin[own], begin[own + 1] - begin[own]
        hits = post[np.repeat(a - np.concatenate([[0], np.cumsum(c)[:-1]]), c) + np.arange(c.sum())]
        both = np.bincount(hits, minlength=n)
        linked = label[100 * both >= percent * (lens[x] + lens - both)]
        if (linked != label[x]).any():
            merge = np.unique(linked)
            label[np.isin(label, merge)] = merge[0]

    if waiting is not None:
        for x in np.flatnonzero(waiting):
            if (label == label[0]).all():
                break
            compare(x)
        return label
    waiting = np.ones(n, dtype=bool)
    while True:
        open_ = np.flatnonzero(waiting)
        labels, sizes = np.unique(label[open_], return_counts=True)
        if len(labels) <= 1:
            return label
        top = open_[label[open_] == labels[sizes.argmax()]][0]
        for x in open_[label[open_] != label[top]]:
            if label[x] != label[top]:
                waiting[x] = False
                compare(x)


def _sets(texts: list[bytes], width: int) -> list[np.ndarray]:
    """The shingle set of each text, about 2 MiB of text at a time."""
    offs = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    out, i = [], 0
    while i < len(texts):
        j = max(i + 1, int(np.searchsorted(offs, offs[i] + (2 << 20), "right")) - 1)
        s, at = shingles(np.frombuffer(b"".join(texts[i:j]), dtype=np.uint8), offs[i:j + 1] - offs[i], width)
        out += [np.unique(s[at[k]:at[k + 1]]) for k in range(j - i)]
        i = j
    return out


def _verify(width: int, percent: int):
    """Links of the components of a group. ``sure`` names what is already one verified component, ``waits`` whom to compare."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("waits", ascending=False, kind="stable").drop_duplicates("c").reset_index(drop=True)
        sets = _sets([t.encode() for t in pdf["text"]], width)
        c, sure, waits = pdf["c"].to_numpy(), pdf["sure"], pdf["waits"].to_numpy()
        label = np.arange(len(c))
        for rows in pdf.groupby("label", sort=False).indices.values():
            own = [sets[k] for k in rows]
            if waits.all():
                label[rows] = rows[verified_links(own, percent)]
            elif waits[rows].any():
                _, first, code = np.unique(pd.factorize(sure.iloc[rows])[0], return_index=True, return_inverse=True)
                label[rows] = rows[verified_links(own, percent, first[code], waits[rows])]
        linked = np.flatnonzero(label != np.arange(len(c)))
        return pd.DataFrame({"a": c[linked], "b": c[label[linked]]})
    return run


def _compared(rows: DataFrame, width: int, percent: int) -> DataFrame:
    """(a, b): links between classes of one group (bin, x, y) and one label; rows (bin, x, y, c, text, label, sure, waits)."""
    return rows.groupBy("bin", "x", "y").applyInPandas(_verify(width, percent), "a binary, b binary")


def _rest(placed: DataFrame, texts: DataFrame, links: DataFrame, width: int, percent: int) -> DataFrame | None:
    """Links of large components that their blocks did not show: classes outside the largest verified component (main) meet
    all blocks, those of main never each other. None where nothing is outside."""
    sure = components(links.join(placed.select(F.col("c").alias("a")), "a", "left_semi"), "sure").select(F.col("v").alias("c"), F.col("label").alias("sure"))
    state = cut(placed.drop("rep").join(sure, "c", "left").withColumn("sure", F.coalesce("sure", "c")), "state")
    main = state.groupBy("label", "sure").agg(F.count(F.lit(1)).alias("n")).groupBy("label").agg(F.max(F.struct("n", "sure"))["sure"].alias("main"))
    state = cut(look_up(state, main, "label").withColumn("out", F.col("sure") != F.col("main")).drop("main"), "outside")
    some = lambda when, what: F.sum(F.when(when, what).otherwise(0))
    outside = state.groupBy("label").agg(
        F.greatest(F.ceil(some(F.col("out"), 1) / BLOCK_DOCS), F.ceil(some(F.col("out"), F.col("n_bytes")) / BLOCK_BYTES)).cast("int").alias("parts"),
        F.collect_set(F.when(~F.col("out"), F.col("x"))).alias("mains")).filter("parts > 0")
    outside = cut(outside, "parts")
    if outside.isEmpty():
        return None
    state = look_up(state, outside, "label").withColumn("parts", F.least("parts", "blocks")).join(texts.select("c", "text"), "c")
    part = lambda x: F.floor(x * F.col("parts") / F.col("blocks")).cast("int")
    each = lambda n: F.sequence(F.lit(0), F.col(n) - 1)
    state = state.withColumn("part", part(F.col("x")))
    # a part meets the members of main in every block, and the others in the blocks of its own and later parts
    ask = state.filter("out").withColumn("met", F.filter(each("blocks"), lambda y: (part(y) >= F.col("part")) | F.array_contains("mains", y)))
    ask = ask.select("c", "text", "label", "sure", F.lit(True).alias("waits"), F.col("part").alias("px"), F.explode("met").alias("py"))
    told = state.withColumn("met", F.filter(each("parts"), lambda p: ~F.col("out") | (F.col("part") >= p)))
    told = told.select("c", "text", "label", "sure", F.lit(False).alias("waits"), F.explode("met").alias("px"), F.col("x").alias("py"))
    return _compared(ask.unionByName(told).withColumnsRenamed({"px": "x", "py": "y"}).withColumn("bin", F.xxhash64("label")), width, percent)


def near_components(docs: DataFrame, width: int = 5, percent: int = 80, tables: int = TABLES) -> DataFrame:
    """doc_id, tk, n_shingles, component_id, label and kept, one row for each input row. label tells components apart, also
    two with the same least doc_id; it is null for a row without a set."""
    sigs = cut(docs.select("doc_id", text_key().alias("tk"), "text").mapInArrow(
        _signatures(width, tables), "doc_id long, tk long, n_shingles long, c binary, sig array<long>, n_bytes long"), "sigs")
    full = sigs.filter("c is not null")
    classes = full.groupBy("c").agg(F.min(F.struct("doc_id", "tk")).alias("rep"), F.min("doc_id").alias("least"), F.first("sig").alias("sig"), F.first("n_bytes").alias("n_bytes"))
    rough = components(_candidates(classes, tables), "rough").withColumnRenamed("v", "c")
    members = cut(classes.select("c", "rep", "n_bytes").join(rough, "c"), "members")
    sizes = (members.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_bytes").alias("bytes"))
             .select("label", F.greatest(F.ceil(F.col("n") / BLOCK_DOCS), F.ceil(F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks")))
    placed = cut(look_up(members, sizes, "label").select(
        "c", "rep", "n_bytes", "label", "blocks", F.pmod(F.xxhash64("c"), F.col("blocks")).cast("int").alias("x")), "placed")
    texts = cut(docs.select("doc_id", text_key().alias("tk"), "text")
                .join(placed, F.col("doc_id").eqNullSafe(F.col("rep.doc_id")) & (F.col("tk") == F.col("rep.tk")))
                .select("c", "label", "blocks", "x", "text"), "texts")
    n, size = members.agg(F.count(F.lit(1)), F.sum("n_bytes")).first()
    bins = 1 + n // SMALL_DOCS + (size or 0) // BLOCK_BYTES
    alone = [F.col("c").alias("sure"), F.lit(True).alias("waits")]
    rows = texts.filter("blocks = 1").select(F.pmod(F.xxhash64("label"), F.lit(bins)).alias("bin"), F.lit(0).alias("x"), F.lit(0).alias("y"), "c", "text", "label", *alone)
    large = texts.filter("blocks > 1")
    some_large = not large.isEmpty()
    if some_large:
        nth = F.dense_rank().over(Window.partitionBy("label").orderBy(F.xxhash64("c", F.lit(1)), "c"))  # rows may repeat
        marks = large.withColumn("nth", nth).filter(F.col("nth") <= LANDMARKS)
        marks = marks.withColumn("x", F.explode(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda y: y != F.col("x"))))
        both = large.unionByName(marks.drop("nth"))
        rows = rows.unionByName(both.select(F.xxhash64("label").alias("bin"), "x", F.lit(-1).alias("y"), "c", "text", "label", *alone))
    links = cut(_compared(rows, width, percent), "links")
    if some_large and (more := _rest(placed.filter("blocks > 1"), large, links, width, percent)) is not None:
        links = links.unionByName(more)
    links = components(links, "links")
    named = cut(classes.select("c", "least").join(links, F.col("c") == F.col("v"), "left").select(
        "c", "least", F.coalesce("label", "c").alias("label")), "named")
    named = look_up(named, named.groupBy("label").agg(F.min("least").alias("component_id")), "label").select("c", "component_id", "label")
    ids = full.join(named.select("c", F.col("component_id").alias("found"), "label"), "c")
    out = ids.select("doc_id", "tk", "n_shingles", F.col("found").alias("component_id"), "label").unionByName(
        sigs.filter("c is null").select("doc_id", "tk", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(None).cast("binary").alias("label")))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull()))


def drop_near_copies(docs: DataFrame, **how) -> DataFrame:
    """One document of each component, its smallest doc_id, stays: of several rows with that doc_id the one of the least
    tk. Documents without words and components without any doc_id stay whole."""
    p = own_prefix(docs)
    marks = cut(near_components(docs, **how).filter("kept"), "marks")
    named = F.col("label").isNotNull() & F.col("doc_id").isNotNull()
    one = marks.filter(named).groupBy("label", "doc_id").agg(F.min("tk").alias("tk"), (F.count(F.lit(1)) > 1).alias("again"))
    kept = one.drop("label").unionByName(marks.filter(~named).select("doc_id", "tk", F.lit(False).alias("again")).distinct())
    kept = kept.withColumnsRenamed({"doc_id": f"{p}id", "tk": f"{p}tk", "again": f"{p}again"})
    rows = docs.withColumn(f"{p}k", text_key()).join(kept, F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}k") == F.col(f"{p}tk")))
    if not one.filter("again").isEmpty():  # rows that repeat doc_id and text: the first by the other columns
        order = [F.col(f"`{c}`") for c, t in docs.dtypes if "map<" not in t and c != "text"]
        nth = F.row_number().over(Window.partitionBy(f"{p}id", f"{p}tk").orderBy(*order))
        first = rows.filter(f"{p}again").withColumn(f"{p}nth", nth).filter(f"{p}nth = 1").drop(f"{p}nth")
        rows = first.unionByName(rows.filter(f"not {p}again"))
    return rows.select(*docs.columns)


def op8_near_dup(spark, sf_dir: str) -> DataFrame:
    return near_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=4, percent=80).drop("tk", "label")
