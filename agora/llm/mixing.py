"""Mixing sources to target weights by pivotal rounding of fractional copy numbers. DataFrame functions only.

Each source gets a target of words: sources in code point order (null last) weigh ``weights`` in turn and share
``percent`` of all words; a target stops at ``most`` times its source's size and the excess is shared again by weight
(closed form: a water level over the sources sorted by size per weight). A document is taken floor(target / size)
times, and once more with the fractional probability that is left.

These fractions are rounded dependently. In a pair, probability is moved from one document to the other until one of
them is 0 or 1; the amount is counted in words, so the pair's expected words do not change, and the direction is drawn
with odds that leave each document's expected copies unchanged. A bucket of about ``FAN`` documents is folded to at
most one fractional document; these residuals are folded again, level by level, until one is left in each source.
That one is often a heavy document, so what its rounding, up or down, adds or takes away is made good by settled ones:
from each size class (powers of two) up to ``REPAIR`` of the source's settled documents are drawn, and from the
heaviest to the lightest each is turned over that is no heavier than what is still missing. Of both roundings the one
that ends nearer holds. A source with documents of many sizes then misses its target by less than a light one.
Draws are hashes of ids and level, so reruns agree.

Defined results: null texts have size 0; documents of size 0 are taken floor(target / size) times like the others and
never change a sum; rows that repeat doc_id, source and size are one item of that many times the words and share its
copies, so a source that is mostly one repeated row may miss by up to half of that row's words; a null source is a source; a null doc_id is an id; an empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from agora.llm.common import WORD, cut, own_prefix

WEIGHTS = (5, 2, 1)
FAN, REPAIR = 32, 256
ITEM = "struct<w:double,p:double,doc_id:bigint,source:string,size:bigint>"


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def targets(sizes: DataFrame, weights=WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """(source, source_size, target): one row for each source; only these rows meet in one window."""
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(by_name) - 1) % len(weights) + 1).cast("int")).cast("double")
    s = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", w)
    s = s.withColumn("cap", (F.col("source_size") * most).cast("double"))
    everything = Window.partitionBy(F.lit(0))
    full_first = Window.partitionBy(F.lit(0)).orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = full_first.rowsBetween(Window.unboundedPreceding, -1)
    s = s.withColumn("budget", F.sum("source_size").over(everything) * percent / 100)
    left = F.col("budget") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    open_weight = F.sum("weight").over(full_first.rowsBetween(0, Window.unboundedFollowing))
    s = s.withColumn("level", left / open_weight)
    # sources fill up in this order; the first that doesn't sets the level of the rest
    s = s.withColumn("level", F.min(F.when(F.col("level") * F.col("weight") < F.col("cap"), F.struct(F.col("cap") / F.col("weight"), F.col("level").alias("l")))).over(everything)["l"])
    target = F.coalesce(F.least("cap", F.col("level") * F.col("weight")), F.col("cap"))
    return s.select("source", "source_size", target.alias("target"))


def _uniform(*keys: Column) -> Column:
    """In (0, 1), from a hash."""
    return (F.shiftrightunsigned(F.xxhash64(*keys), 12).cast("double") + 0.5) / float(1 << 52)


def _fold(items: Column, level: int) -> Column:
    """From the items of a bucket: carry (the fractional item left, or null) and done (items with p 0 or 1)."""
    def item(x: Column, p: Column) -> Column:
        return F.struct(x["w"].alias("w"), p.alias("p"), x["doc_id"].alias("doc_id"), x["source"].alias("source"), x["size"].alias("size"))

    def settle(done: Column, a: Column, b: Column) -> Column:
        """a and b after a transfer: at least one is integral."""
        whole = lambda x: (x["p"] <= 0.0) | (x["p"] >= 1.0)
        return (F.when(whole(a) & whole(b), F.struct(F.lit(None).cast(ITEM).alias("carry"), F.concat(done, F.array(a, b)).alias("done")))
                .when(whole(a), F.struct(b.alias("carry"), F.concat(done, F.array(a)).alias("done")))
                .otherwise(F.struct(a.alias("carry"), F.concat(done, F.array(b)).alias("done"))))

    def meet(acc: Column, x: Column) -> Column:
        a = acc["carry"]

        def draw(m: Column) -> Column:  # m: words that x can give to a, and a to x
            give, take = m["give"], m["take"]
            to_a = _uniform(a["doc_id"], a["source"], x["doc_id"], x["size"], F.lit(level)) * (give + take) < take
            a_up = F.when(give >= (1.0 - a["p"]) * a["w"], 1.0).otherwise(a["p"] + give / a["w"])
            x_down = F.when(give >= x["p"] * x["w"], 0.0).otherwise(x["p"] - give / x["w"])
            a_down = F.when(take >= a["p"] * a["w"], 0.0).otherwise(a["p"] - take / a["w"])
            x_up = F.when(take >= (1.0 - x["p"]) * x["w"], 1.0).otherwise(x["p"] + take / x["w"])
            after = F.when(to_a, F.struct(a_up.alias("a"), x_down.alias("x"))).otherwise(F.struct(a_down.alias("a"), x_up.alias("x")))
            return _let(after, lambda q: settle(acc["done"], item(a, q["a"]), item(x, q["x"])))

        moved = F.struct(F.least((1.0 - a["p"]) * a["w"], x["p"] * x["w"]).alias("give"), F.least(a["p"] * a["w"], (1.0 - x["p"]) * x["w"]).alias("take"))
        return F.when(a.isNull(), F.struct(x.alias("carry"), acc["done"].alias("done"))).otherwise(_let(moved, draw))

    start = F.struct(F.lit(None).cast(ITEM).alias("carry"), F.array().cast(f"array<{ITEM}>").alias("done"))
    return F.aggregate(items, start, meet)


def repairs(settled: DataFrame, root: DataFrame) -> DataFrame:
    """(doc_id, source, size, turn): settled documents that are taken once more (1) or once less (-1), and the roots that
    are rounded up (1)."""
    up = root.withColumn("up", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        F.col("source").alias("__s"), "up", ((F.col("up") - F.col("p")) * F.col("w")).alias("error"), F.struct("w", "doc_id", "size", F.col("up").alias("turn")).alias("root"))
    up = F.broadcast(up) if _few(up) else up
    turn = F.when(F.col("p") >= 1.0, -1).otherwise(1)
    near = settled.withColumns({"turn": turn, "class": F.length(F.bin(F.col("w").cast("long")))})
    near = near.join(up, F.col("source").eqNullSafe(F.col("__s")) & (F.col("up") == (F.col("turn") < 0).cast("int")) & (F.col("w") <= F.abs("error")))
    draw = Window.partitionBy("source", "up", "class").orderBy(F.xxhash64("doc_id", "size"), "doc_id", "size")
    near = near.withColumn("n", F.row_number().over(draw)).filter(F.col("n") <= REPAIR)
    drawn = near.select("__s", "up", "error", "root", F.struct("w", "doc_id", "size", "turn").alias("item"))
    drawn = drawn.unionByName(up.withColumn("item", F.lit(None).cast("struct<w:double,doc_id:bigint,size:bigint,turn:int>")))
    heavy_first = drawn.groupBy("__s", "up").agg(F.first("error").alias("error"), F.first("root").alias("root"), F.sort_array(F.collect_list("item"), asc=False).alias("items"))
    start = F.struct(F.col("error").alias("left"), F.array("root").alias("turned"))

    def step(acc: Column, x: Column) -> Column:
        after = acc["left"] + x["turn"] * x["w"]
        return F.when(x["w"] <= F.abs(acc["left"]), F.struct(after.alias("left"), F.concat(acc["turned"], F.array(x)).alias("turned"))).otherwise(acc)

    ends = heavy_first.select("__s", "up", "error", F.aggregate("items", start, step).alias("end"))
    best = ends.groupBy("__s").agg(F.min_by("end", F.struct(F.abs("end.left"), F.abs("error"), "up")).alias("end"))
    return best.select(F.col("__s").alias("source"), F.explode("end.turned").alias("x")).filter("x.turn <> 0").select("x.doc_id", "source", "x.size", "x.turn")


def copies(sizes: DataFrame, goal: DataFrame) -> DataFrame:
    """(doc_id, source, size, copies): the distinct items and how often each is taken."""
    items = sizes.groupBy("doc_id", "source", "size").agg(F.count(F.lit(1)).alias("times"))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    items = cut(items.join(F.broadcast(goal) if _few(goal) else goal, F.col("source").eqNullSafe(F.col("s")))
                .withColumn("ratio", ratio).withColumn("base", F.floor("ratio"))
                .select("doc_id", "source", "size", (F.col("size") * F.col("times")).cast("double").alias("w"),
                        "base", (F.col("ratio") - F.col("base")).alias("p")), "items")
    todo = items.filter("p > 0 and w > 0").select("source", F.struct("w", "p", "doc_id", "source", "size").cast(ITEM).alias("item"))
    most = todo.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    done, level, root = [], 0, None
    while most > 0:
        n = -(-most // FAN)
        counts = todo.groupBy("source").agg(F.count(F.lit(1)).alias("__n")).withColumnRenamed("source", "__s")
        counts = counts.withColumn("__b", F.ceil(F.col("__n") / FAN))
        few = F.broadcast(counts) if _few(counts) else counts
        # heavier items first: a heavy carry meets the lighter ones, which settle
        bucketed = todo.join(few, F.col("source").eqNullSafe(F.col("__s"))).withColumn(
            "__b", F.pmod(F.xxhash64("item.doc_id", "item.size", F.lit(level)), F.col("__b")))
        folded = cut(bucketed.groupBy("source", "__b").agg(F.sort_array(F.collect_list("item"), asc=False).alias("items"))
                     .select("source", _fold(F.col("items"), level).alias("f")).select("source", "f.carry", "f.done"), f"fold{level}")
        done.append(folded.select(F.explode("done").alias("x")).select("x.*"))
        todo = folded.filter("carry is not null").select("source", F.col("carry").alias("item"))
        level += 1
        if n == 1:
            root = todo.select("item.*")
            break
        most = todo.groupBy("source").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    if not done:
        return items.select("doc_id", "source", "size", F.col("base").cast("long").alias("copies"))
    extra = done[0]
    for d in done[1:]:
        extra = extra.unionByName(d)
    turned = cut(repairs(extra, root), "repairs").select(F.col("doc_id").alias("__rd"), F.col("source").alias("__rs"), F.col("size").alias("__rz"), "turn")
    extra = extra.select(F.col("doc_id").alias("__d"), F.col("source").alias("__s"), F.col("size").alias("__z"), F.col("p").alias("__p"))
    for more, d, c, z in ((extra, "__d", "__s", "__z"), (F.broadcast(turned) if _few(turned) else turned, "__rd", "__rs", "__rz")):
        items = items.join(more, F.col("doc_id").eqNullSafe(F.col(d)) & F.col("source").eqNullSafe(F.col(c)) & (F.col("size") == F.col(z)), "left")
    return items.select("doc_id", "source", "size", (F.col("base") + F.coalesce(F.col("__p"), F.lit(0.0)) + F.coalesce(F.col("turn"), F.lit(0))).cast("long").alias("copies"))


def _few(rows: DataFrame, most: int = 10_000) -> bool:
    return rows.limit(most + 1).count() <= most


def sizes_of(docs: DataFrame) -> DataFrame:
    words = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    return docs.select("doc_id", "source", words.alias("size"))


def mix_report(docs: DataFrame, weights=WEIGHTS, percent: int = 150, most: int = 2) -> DataFrame:
    """doc_id, source, size, source_size, target, copies and taken, one row for each input row."""
    sizes = cut(sizes_of(docs), "sizes")
    goal = cut(targets(sizes, weights, percent, most).withColumnRenamed("source", "s"), "targets")
    plan = copies(sizes, goal).select(F.col("doc_id").alias("d"), F.col("source").alias("c"), F.col("size").alias("z"), "copies")
    out = sizes.join(plan, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("c")) & (F.col("size") == F.col("z")))
    out = out.join(F.broadcast(goal) if _few(goal) else goal, F.col("source").eqNullSafe(F.col("s")))
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def take_mix(docs: DataFrame, **how) -> DataFrame:
    """Each row of ``docs`` as often as the mix takes it."""
    p = own_prefix(docs)
    plan = mix_report(docs, **how).filter("copies > 0").select(
        F.col("doc_id").alias(f"{p}d"), F.col("source").alias(f"{p}s"), F.col("size").alias(f"{p}z"), F.col("copies").alias(f"{p}n")).distinct()
    sized = docs.withColumn(f"{p}size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))
    same = F.col("doc_id").eqNullSafe(F.col(f"{p}d")) & F.col("source").eqNullSafe(F.col(f"{p}s")) & (F.col(f"{p}size") == F.col(f"{p}z"))
    return sized.join(plan, same).withColumn(f"{p}i", F.explode(F.sequence(F.lit(1), F.col(f"{p}n").cast("int")))).select(*docs.columns)


def op10_mixing(spark, sf_dir: str) -> DataFrame:
    return mix_report(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("source", "copies")
