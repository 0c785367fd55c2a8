"""Quality rules with adaptive thresholds. DataFrame functions only.

Each document gets integer metrics. For every (lang, source) and metric a quantile sketch is kept: counts of the metric
in buckets of a logarithmic histogram (the leading ``BITS`` bits of the value, so a bucket is at most 2 ** -(BITS - 1)
wide relative to its values). Sketches merge by adding counts, in any order and with the same result: they are built
by aggregates that combine before the shuffle, and a group with fewer than ``min_group`` rows uses the sketch of its
language, or of all rows, which are sums of the same buckets. A threshold is a fence around the sketch's quartiles
(``reach`` times their distance, at least ``slack``), so it follows each language and source, and an ordinary document
lies inside. Thresholds are joined to the documents and filter them.

Defined results: a null text has no words and fails the base rules; null lang or source form groups of their own; rows
that repeat are judged alike; an empty table gives no rows; other columns pass through.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import cut, own_prefix, text_key

BITS = 6
MIN_GROUP = 200
#: metric: (what is judged, fence in quartile distances below and above, least fence width)
RULES = {
    "word_len": {"reach": 4, "slack": 2000, "low": True},      # characters in words per 1000 words
    "symbols": {"reach": 4, "slack": 60_000, "low": False},    # symbols per million characters in words
    "dup_lines": {"reach": 4, "slack": 300_000, "low": False},  # repeated lines per million lines with a word
    "repeats": {"reach": 4, "slack": 200_000, "low": False},   # repeated words per million words
}


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column, width: int) -> Column:
    """Words in windows of ``width`` that are found twice or more: hashes of windows, sorted with their places."""
    def covered(sorted_: Column) -> Column:
        n = F.size(sorted_)
        twice = F.filter(sorted_, lambda x, i: ((i > 0) & (F.get(sorted_, i - 1)["h"] == x["h"])) | ((i < n - 1) & (F.get(sorted_, i + 1)["h"] == x["h"])))
        places = F.sort_array(F.transform(twice, lambda x: x["i"]))
        gaps = lambda p: F.aggregate(F.zip_with(p, F.slice(p, 2, F.size(p)), lambda a, b: F.least(F.lit(width), F.coalesce(b - a, F.lit(width)))), F.lit(0), lambda s, x: s + x)
        return _let(places, gaps)

    hashes = F.transform(F.sequence(F.lit(0), F.size(words) - width), lambda i: F.xxhash64(*(words[i + k] for k in range(width))))
    some = lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(
        _let(F.sort_array(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i")))), covered))
    return F.when(F.size(words) < width, 0).otherwise(_let(hashes, some))


def measured(docs: DataFrame, width: int = 5) -> DataFrame:
    """doc_id, lang, source, tk and the counts of each row."""
    text = F.coalesce("text", F.lit(""))
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(r"[^\x20\x09-\x0D]")))
    of_words = _let(words, lambda w: F.struct(
        F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"),
        _repeat_words(w, width).cast("long").alias("n_repeat_words")))
    of_lines = _let(lines, lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines")))
    symbols = F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long")
    return docs.select("doc_id", "lang", "source", text_key().alias("tk"), F.explode(F.array(F.struct(of_words.alias("w"), of_lines.alias("l")))).alias("m"), symbols.alias("n_symbols")) \
        .select("doc_id", "lang", "source", "tk", "m.w.*", "m.l.*", "n_symbols")


def _metrics() -> dict[str, Column]:
    per = lambda a, b, unit: F.when(F.col(b) > 0, F.expr(f"{a} * {unit} div {b}")).otherwise(F.lit(0)).cast("long")
    return {"word_len": per("word_chars", "n_words", 1000), "symbols": per("n_symbols", "word_chars", 1_000_000),
            "dup_lines": per("n_dup_lines", "n_lines", 1_000_000), "repeats": per("n_repeat_words", "n_words", 1_000_000)}


def bucket(value: Column) -> Column:
    """The value with all but its leading BITS bits cleared: the least value of its bucket."""
    drop = F.greatest(F.length(F.bin(value)) - BITS, F.lit(0))
    return F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)


def thresholds(counts: DataFrame, rules: dict = RULES, min_group: int = MIN_GROUP) -> DataFrame:
    """(lang, source, <metric>_low, <metric>_high): one row for each language and source."""
    values = F.explode(F.array(*(F.struct(F.lit(k).alias("metric"), bucket(m).alias("b")) for k, m in _metrics().items())))
    base = counts.select("lang", "source", values.alias("v")).groupBy("lang", "source", "v.metric", "v.b").agg(F.count(F.lit(1)).alias("n"))
    base = cut(base, "sketches")
    groups = base.select("lang", "source").distinct()
    by_lang = base.groupBy("lang", "metric", "b").agg(F.sum("n").alias("n"))
    by_all = by_lang.groupBy("metric", "b").agg(F.sum("n").alias("n"))

    def quartiles(sketch: DataFrame, keys: list[str], level: int) -> DataFrame:
        w = Window.partitionBy(*keys, "metric")
        s = sketch.withColumn("total", F.sum("n").over(w)).withColumn("upto", F.sum("n").over(w.orderBy("b")))
        return s.groupBy(*keys, "metric").agg(
            F.max("total").alias("total"), F.min(F.when(F.col("upto") * 4 >= F.col("total"), F.col("b"))).alias("q1"),
            F.min(F.when(F.col("upto") * 4 >= F.col("total") * 3, F.col("b"))).alias("q3")).withColumn("level", F.lit(level))

    cols = ["lang", "source", "metric", "level", "total", "q1", "q3"]
    own = quartiles(base, ["lang", "source"], 0).select(cols)
    lang = quartiles(by_lang, ["lang"], 1).withColumnRenamed("lang", "l2")
    lang = groups.join(lang, F.col("lang").eqNullSafe(F.col("l2"))).select(cols)
    every = groups.crossJoin(F.broadcast(quartiles(by_all, [], 2))).select(cols)  # the right side has one row for each metric
    usable = own.unionByName(lang).unionByName(every).filter((F.col("total") >= min_group) | (F.col("level") == 2))
    best = usable.groupBy("lang", "source", "metric").agg(F.min(F.struct("level", "q1", "q3")).alias("s"))
    fence = []
    for k, r in rules.items():
        pick = lambda c, k=k: F.max(F.when(F.col("metric") == k, F.col(c)))
        width = F.greatest((pick("s.q3") - pick("s.q1")) * r["reach"], F.lit(r["slack"]))
        fence.append((pick("s.q3") + width).alias(f"{k}_high"))
        fence.append((pick("s.q1") - width if r["low"] else F.lit(None).cast("long")).alias(f"{k}_low"))
    return best.groupBy("lang", "source").agg(*fence)


def judged(docs: DataFrame, rules: dict = RULES, min_group: int = MIN_GROUP) -> DataFrame:
    """The counts of each row with base_failed and kept. The sketches cover the rows that pass the base rules."""
    counts = cut(measured(docs), "counts")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    counts = counts.withColumn("base_failed", failed)
    fences = cut(thresholds(counts.filter("not base_failed"), rules, min_group), "fences")
    few = fences.limit(20_001).count() <= 20_000
    t = fences.withColumnsRenamed({"lang": "__l", "source": "__s"})
    rows = counts.join(F.broadcast(t) if few else t, F.col("lang").eqNullSafe(F.col("__l")) & F.col("source").eqNullSafe(F.col("__s")), "left")
    inside = F.lit(True)
    for k, m in _metrics().items():
        if k in rules:
            inside = inside & F.coalesce(m <= F.col(f"{k}_high"), F.lit(True)) & F.coalesce(m >= F.col(f"{k}_low"), F.lit(True))
    return rows.withColumn("kept", ~F.col("base_failed") & inside).drop("__l", "__s")


def keep_quality(docs: DataFrame, **how) -> DataFrame:
    """The rows of ``docs`` that are kept."""
    p = own_prefix(docs)
    kept = judged(docs, **how).filter("kept").select(F.col("doc_id").alias(f"{p}id"), F.col("tk").alias(f"{p}tk")).distinct()
    return docs.withColumn(f"{p}k", text_key()).join(
        kept, F.col("doc_id").eqNullSafe(F.col(f"{p}id")) & (F.col(f"{p}k") == F.col(f"{p}tk")), "left_semi").select(*docs.columns)


def op1_quality(spark, sf_dir: str) -> DataFrame:
    return judged(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
g AS (SELECT rid, i, ws[i:i + 4] AS win FROM (SELECT rid, ws, unnest(range(1, len(ws) - 3)) AS i FROM w)),
g2 AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, win) AS c FROM g) WHERE c >= 2),
rep AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 5)) AS p FROM g2) GROUP BY rid),
c AS (SELECT w.rid, doc_id, lang, source, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols, len(ls)::BIGINT AS n_lines,
  (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words
  FROM w LEFT JOIN rep ON w.rid = rep.rid),
f AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
  CASE WHEN n_words > 0 THEN word_chars * 1000 // n_words ELSE 0 END AS m1,
  CASE WHEN word_chars > 0 THEN n_symbols * 1000000 // word_chars ELSE 0 END AS m2,
  CASE WHEN n_lines > 0 THEN n_dup_lines * 1000000 // n_lines ELSE 0 END AS m3,
  CASE WHEN n_words > 0 THEN n_repeat_words * 1000000 // n_words ELSE 0 END AS m4 FROM c),
v AS (SELECT lang, source, unnest([1, 2, 3, 4]) AS k, unnest([m1, m2, m3, m4]) AS x FROM f WHERE NOT base_failed),
b AS (SELECT lang, source, k, (x >> greatest(length(bin(x)) - 6, 0)) << greatest(length(bin(x)) - 6, 0) AS b FROM v),
s AS (SELECT lang, source, k, b, count(*) AS n FROM b GROUP BY ALL),
grp AS (SELECT DISTINCT lang, source FROM s),
lv AS (SELECT lang, source, 0 AS level, k, b, n FROM s
  UNION ALL SELECT grp.lang, grp.source, 1, k, b, sum(n) FROM grp JOIN s ON s.lang IS NOT DISTINCT FROM grp.lang GROUP BY ALL
  UNION ALL SELECT grp.lang, grp.source, 2, k, b, sum(n) FROM grp, s GROUP BY ALL),
q0 AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, level, k) AS total, sum(n) OVER (PARTITION BY lang, source, level, k ORDER BY b) AS upto FROM lv),
q AS (SELECT lang, source, level, k, min(b) FILTER (WHERE upto * 4 >= total) AS q1, min(b) FILTER (WHERE upto * 4 >= total * 3) AS q3
  FROM q0 WHERE total >= 200 OR level = 2 GROUP BY ALL),
best AS (SELECT lang, source, k, arg_min(q1, level) AS q1, arg_min(q3, level) AS q3 FROM q GROUP BY ALL),
t AS (SELECT lang, source,
  max(q1 - greatest((q3 - q1) * 4, 2000)) FILTER (WHERE k = 1) AS low1, max(q3 + greatest((q3 - q1) * 4, 2000)) FILTER (WHERE k = 1) AS high1,
  max(q3 + greatest((q3 - q1) * 4, 60000)) FILTER (WHERE k = 2) AS high2, max(q3 + greatest((q3 - q1) * 4, 300000)) FILTER (WHERE k = 3) AS high3,
  max(q3 + greatest((q3 - q1) * 4, 200000)) FILTER (WHERE k = 4) AS high4 FROM best GROUP BY ALL)
SELECT f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(m1 BETWEEN low1 AND high1, true) AND coalesce(m2 <= high2, true) AND coalesce(m3 <= high3, true) AND coalesce(m4 <= high4, true) AS kept
FROM f LEFT JOIN t ON f.lang IS NOT DISTINCT FROM t.lang AND f.source IS NOT DISTINCT FROM t.source
"""
