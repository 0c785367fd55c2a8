"""Registered queries: name -> (spark, sf_dir) -> DataFrame.

Each query reads the driver tables (through the forum fixtures) and returns
a DataFrame whose column names and rounding match its oracle statement in
``oracle.py``.  Floats are rounded to 6 decimals for the cross-engine check.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import trends as tr
from ..sources import fixtures as fx

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(name: str):
    """Register ``fn``; the session time zone is pinned to UTC (day buckets and
    timestamps are UTC-based, as in the analysed application)."""
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            spark.conf.set("spark.sql.session.timeZone", "UTC")
            return fn(spark, sf_dir)
        run.__name__ = run.__qualname__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        return fn
    return deco


def r6(c) -> F.Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6)


def forum(spark: SparkSession, sf_dir: str):
    return fx.threads(spark, sf_dir), fx.comments(spark, sf_dir)


# --------------------------------------------------------------- trending core
@query("topic_trends")
def q_topic_trends(spark, sf_dir):
    threads, comments = forum(spark, sf_dir)
    t = tr.topic_trends(threads, comments, fx.topics(spark, sf_dir))
    return t.select("topic_id", r6("topic_trend_score").alias("topic_trend_score"), "thread_count", "last_activity")


# --------------------------------------------------------------- text functions
from ..functions import scoring as sc  # noqa: E402
from ..functions import text as tx  # noqa: E402
from ..operators import activity as act  # noqa: E402
from ..operators import cleaning as cl  # noqa: E402
from ..operators import ranking as rk  # noqa: E402
from ..sources.tables import table  # noqa: E402


def docs_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", "text")


def _text_query(name, out, fn):
    query(name)(lambda spark, sf_dir: fx.planted_texts(spark, sf_dir).select("doc_id", fn(F.col("text")).alias(out)))


_text_query("collapse_ws", "collapsed", tx.collapse_ws)
_text_query("remove_urls", "no_urls", tx.remove_urls)
_text_query("remove_emojis", "no_emojis", tx.remove_emojis)
_text_query("remove_quotes", "unquoted", tx.remove_quotes)
_text_query("blank_markers", "unmarked", tx.blank_markers)
_text_query("normalize_text", "normalized", tx.normalize_text)
_text_query("word_count", "n_words", tx.word_count)


@query("flair_norm")
def q_flair_norm(spark, sf_dir):
    return fx.threads(spark, sf_dir).select("thread_id", tx.flair_norm("link_flair_text").alias("flair"))


@query("title_and_selftext")
def q_title_and_selftext(spark, sf_dir):
    return fx.threads(spark, sf_dir).select(
        "thread_id", tx.title_and_selftext("title", "selftext").alias("title_and_selftext"))


@query("snippet")
def q_snippet(spark, sf_dir):
    return fx.threads(spark, sf_dir).select(
        "thread_id",
        tx.snippet("selftext", 300, "after").alias("cut_then_flat"),
        tx.snippet("selftext", 250, "before").alias("flat_then_cut"),
        tx.snippet("selftext", 200, "none").alias("card_title"),
        tx.short_label("title").alias("chart_label"),
    )


@query("resolve_url")
def q_resolve_url(spark, sf_dir):
    t = fx.threads(spark, sf_dir)
    trending = tx.resolve_url(t, ["external_url", "url", "permalink"])
    with_permalink = trending.withColumn(
        "permalink", F.when(F.col("score").isNull(), F.col("external_url"))
        .otherwise(F.concat(F.lit("/r/forum/comments/"), F.col("thread_id")))).drop("external_url")
    return tx.resolve_url(with_permalink, ["thread_url_given", "permalink"], out="permalink_url").select(
        "thread_id", "thread_url", "permalink_url")


# --------------------------------------------------------------- time / score functions
@query("parse_ts")
def q_parse_ts(spark, sf_dir):
    c = fx.comments(spark, sf_dir)
    raw = F.when(F.col("score").isNull(), F.lit("not a time")).otherwise(
        F.date_format("created_utc", "yyyy-MM-dd HH:mm:ss.SSSSSS"))
    return c.select("comment_id", sc.parse_ts(raw).alias("parsed"))


@query("relative_time")
def q_relative_time(spark, sf_dir):
    threads, comments = forum(spark, sf_dir)
    end = act.window_end(comments, threads)
    return threads.where(F.col("created_utc").isNotNull()).select(
        "thread_id", sc.relative_time("created_utc", end).alias("age"))


@query("comment_priority")
def q_comment_priority(spark, sf_dir):
    threads, comments = forum(spark, sf_dir)
    end = act.window_end(comments, threads)
    win = act.windowed_comments(comments, threads, 14, end)
    return win.select("comment_id", r6(sc.comment_priority("score", "created_utc", end)).alias("comment_priority"))


@query("trend_score")
def q_trend_score(spark, sf_dir):
    threads, comments = forum(spark, sf_dir)
    end = act.window_end(comments, threads)
    active = act.active_threads(threads, act.windowed_comments(comments, threads, 14, end))
    return active.select("thread_id", r6(sc.trend_score("score", "num_comments", "created_utc", end)).alias("trend_score"))


# --------------------------------------------------------------- filters / joins
@query("drop_short_comments")
def q_drop_short_comments(spark, sf_dir):
    return cl.drop_short_comments(fx.comments(spark, sf_dir)).select("comment_id", "body_len")


@query("known_thread_comments")
def q_known_thread_comments(spark, sf_dir):
    threads, comments = forum(spark, sf_dir)
    return act.known_thread_comments(comments, threads).select("comment_id", "thread_id")


@query("active_window")
def q_active_window(spark, sf_dir):
    threads, comments = forum(spark, sf_dir)
    return act.windowed_comments(comments, threads).select("comment_id", "thread_id", "created_utc")


@query("active_threads")
def q_active_threads(spark, sf_dir):
    threads, comments = forum(spark, sf_dir)
    return act.active_threads(threads, act.windowed_comments(comments, threads)).select("thread_id", "created_utc")


@query("embedding_scan")
def q_embedding_scan(spark, sf_dir):
    v = fx.store_vectors(spark, sf_dir)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x))
    return v.select("thread_id", F.size("embedding").alias("dim"), r6(norm).alias("norm"))


@query("active_embeddings")
def q_active_embeddings(spark, sf_dir):
    from ..operators.vectors import active_embeddings
    threads, comments = forum(spark, sf_dir)
    active = act.active_threads(threads, act.windowed_comments(comments, threads))
    return active_embeddings(active, fx.store_vectors(spark, sf_dir)).select("thread_id", "embedding")


# --------------------------------------------------------------- ranking
@query("dedupe_threads")
def q_dedupe_threads(spark, sf_dir):
    t = fx.threads(spark, sf_dir)
    number = F.regexp_replace("thread_id", "^moved-", "").cast("long")  # some threads are known by another id
    dup = t.where(number % 5 == 0).withColumn("score", F.col("score") - 1)
    return rk.dedupe_threads(t.unionByName(dup)).select("thread_id", "score", "created_utc", "external_url")


@query("top_comments_by_priority")
def q_top_comments_by_priority(spark, sf_dir):
    threads, comments = forum(spark, sf_dir)
    end = act.window_end(comments, threads)
    win = act.windowed_comments(comments, threads, 14, end).withColumn(
        "comment_priority", sc.comment_priority("score", "created_utc", end))
    return rk.top_comments_by_priority(win).select("thread_id", "comment_id", "rank")


@query("top_comments_by_score")
def q_top_comments_by_score(spark, sf_dir):
    return rk.top_comments_by_score(fx.big_comments(spark, sf_dir)).select("thread_id", "comment_id", "score", "rank")


def scored_topic_threads(spark, sf_dir):
    threads, comments = forum(spark, sf_dir)
    end = act.window_end(comments, threads)
    active = act.active_threads(threads, act.windowed_comments(comments, threads, 14, end))
    return tr.score_topic_threads(active, fx.topics(spark, sf_dir), end)


@query("latest_threads_per_topic")
def q_latest_threads_per_topic(spark, sf_dir):
    return rk.latest_threads_per_topic(scored_topic_threads(spark, sf_dir)).select(
        "topic_id", "thread_id", "created_utc", "rank")


@query("top_threads_by_trend")
def q_top_threads_by_trend(spark, sf_dir):
    return rk.top_threads_by_trend(scored_topic_threads(spark, sf_dir)).select(
        "topic_id", "thread_id", r6("trend_score").alias("trend_score"), "rank")


@query("top_topics")
def q_top_topics(spark, sf_dir):
    t = tr.aggregate_trends(scored_topic_threads(spark, sf_dir))
    return rk.top_topics(t).select("topic_id", r6("topic_trend_score").alias("topic_trend_score"), "thread_count")


# --------------------------------------------------------------- documents
def trending_threads(spark, sf_dir):
    """Fixture threads carrying ``title_and_selftext`` (T10) as the processed table does."""
    t = fx.threads(spark, sf_dir)
    return t.withColumn("title_and_selftext", tx.title_and_selftext("title", "selftext"))


@query("top_comments_text")
def q_top_comments_text(spark, sf_dir):
    threads, comments = forum(spark, sf_dir)
    end = act.window_end(comments, threads)
    return act.top_comments_text(act.windowed_comments(comments, threads, 14, end), end)


@query("build_docs")
def q_build_docs(spark, sf_dir):
    docs = act.build_docs(trending_threads(spark, sf_dir), fx.keyed_comments(spark, sf_dir), bodies=fx.bodies(spark, sf_dir))
    return docs.select("thread_id", "thread_url", "created_utc", "score", "num_comments",
                       "top_comments_text", "thread_doc")


# --------------------------------------------------------------- cleaning
@query("clean_threads")
def q_clean_threads(spark, sf_dir):
    return cl.clean_threads(fx.threads(spark, sf_dir)).select(
        "thread_id", "link_flair_text", "has_image", "title_and_selftext")


@query("has_image")
def q_has_image(spark, sf_dir):
    """J6 with the ids of the crawled pages as the set of ids that have an image."""
    ids = table(spark, sf_dir, "pages").select(F.col("page_id").alias("thread_id"))
    return cl.with_has_image(fx.threads(spark, sf_dir), ids).select("thread_id", "has_image")


@query("clean_comments")
def q_clean_comments(spark, sf_dir):
    return cl.clean_comments(fx.comments(spark, sf_dir)).select("comment_id", "thread_id", "body", "body_len")


# --------------------------------------------------------------- sentiment
from ..functions import sentiment as se  # noqa: E402
from ..operators import cards as cd  # noqa: E402
from ..operators import rollups as ru  # noqa: E402
from . import trending as tg  # noqa: E402


def comments_scored(spark, sf_dir):
    return cd.scored_comments(fx.comments(spark, sf_dir))


@query("sentiment_compound")
def q_sentiment_compound(spark, sf_dir):
    return comments_scored(spark, sf_dir).select("comment_id", r6("compound").alias("compound"))


@query("sentiment_bucket")
def q_sentiment_bucket(spark, sf_dir):
    return comments_scored(spark, sf_dir).select("comment_id", se.sentiment_bucket("compound").alias("bucket"))


@query("sentiment_dist")
def q_sentiment_dist(spark, sf_dir):
    return comments_scored(spark, sf_dir).groupBy("thread_id").agg(*se.dist_aggs())


@query("sentiment_avg")
def q_sentiment_avg(spark, sf_dir):
    return comments_scored(spark, sf_dir).groupBy("thread_id").agg(se.avg_agg())


@query("daily_timeline")
def q_daily_timeline(spark, sf_dir):
    return cd.daily_counts(fx.comments(spark, sf_dir), "thread_id")


# --------------------------------------------------------------- contexts, cards, roll-ups
def trending_given_topics(spark, sf_dir) -> tg.TrendingResult:
    return tg.trending_from_topics(trending_threads(spark, sf_dir), fx.keyed_comments(spark, sf_dir),
                                   fx.topics(spark, sf_dir), bodies=fx.bodies(spark, sf_dir))


def scored_trending(spark, sf_dir):
    return tg.scored_docs(trending_threads(spark, sf_dir), fx.keyed_comments(spark, sf_dir), fx.topics(spark, sf_dir),
                          bodies=fx.bodies(spark, sf_dir))[1]


@query("topic_context")
def q_topic_context(spark, sf_dir):
    return cd.topic_context(scored_trending(spark, sf_dir))


@query("topic_headline")
def q_topic_headline(spark, sf_dir):
    return cd.summarise_topics(cd.topic_context(scored_trending(spark, sf_dir)))


@query("topic_cards")
def q_topic_cards(spark, sf_dir):
    c = trending_given_topics(spark, sf_dir).cards
    return c.select(
        "topic_id", "headline", "summary", r6("topic_trend_score").alias("topic_trend_score"),
        F.array_join(F.transform("threads", lambda t: t["thread_id"]), ",").alias("thread_ids"),
        F.col("sentiment_dist.positive").alias("positive"), F.col("sentiment_dist.neutral").alias("neutral"),
        F.col("sentiment_dist.negative").alias("negative"), "total_comments", "last_updated",
        F.size("comment_timeline").cast("long").alias("n_days"),
        F.aggregate("comment_timeline", F.lit(0).cast("long"), lambda a, p: a + p["count"]).alias("timeline_count"))


@query("overall_timeline")
def q_overall_timeline(spark, sf_dir):
    return ru.overall_timeline(trending_given_topics(spark, sf_dir).cards)


@query("overall_sentiment")
def q_overall_sentiment(spark, sf_dir):
    return ru.overall_sentiment(trending_given_topics(spark, sf_dir).cards)


@query("recent_activity")
def q_recent_activity(spark, sf_dir):
    return ru.recent_activity(trending_given_topics(spark, sf_dir).cards)


@query("trend_bars")
def q_trend_bars(spark, sf_dir):
    return ru.trend_bars(trending_given_topics(spark, sf_dir).cards)


@query("sentiment_over_time")
def q_sentiment_over_time(spark, sf_dir):
    return ru.sentiment_over_time(trending_given_topics(spark, sf_dir).cards)


@query("home_feed")
def q_home_feed(spark, sf_dir):
    """X8 with the nested arrays written as text: one line for each card in order, and date=count points."""
    f = ru.home_feed(trending_given_topics(spark, sf_dir).cards)
    card = lambda t: F.concat_ws(
        "|", t["topic_id"].cast("string"), t["headline"], t["summary"], F.array_join(F.transform(t["threads"], lambda x: x["thread_id"]), ","),
        *[t["sentiment_dist"][k].cast("string") for k in ("positive", "neutral", "negative")], t["total_comments"].cast("string"),
        t["last_updated"], F.size(t["comment_timeline"]).cast("string"))
    return f.select(
        F.array_join(F.transform("topics", card), "\n").alias("topics"),
        F.array_join(F.transform("overall_timeline", lambda p: F.concat(p["date"], F.lit("="), p["count"].cast("string"))), ",").alias("overall_timeline"))


# --------------------------------------------------------------- vectors and search
from ..operators import search as sr  # noqa: E402
from ..operators import vectors as vx  # noqa: E402


def label_queries(spark, sf_dir):
    """Search queries derived from the data: one unit centroid per label of the planted vectors."""
    return vx.centroids(fx.planted_vectors(spark, sf_dir), "label", "label-")


def _round_vec(c):
    return F.transform(c, lambda x: F.round(x, 6))


@query("l2_normalize")
def q_l2_normalize(spark, sf_dir):
    v = fx.store_vectors(spark, sf_dir)
    return v.select("thread_id", _round_vec(vx.l2_normalize("embedding")).alias("unit"))


@query("query_centroids")
def q_query_centroids(spark, sf_dir):
    return label_queries(spark, sf_dir).select("query_id", _round_vec("embedding").alias("embedding"))


@query("cosine_topk")
def q_cosine_topk(spark, sf_dir):
    top = vx.cosine_topk(label_queries(spark, sf_dir), fx.planted_vectors(spark, sf_dir), k=5)
    return top.select("query_id", "thread_id", r6("score").alias("score"), "rank")


@query("greedy_dedup")
def q_greedy_dedup(spark, sf_dir):
    vec = fx.planted_vectors(spark, sf_dir)
    kept = vx.greedy_dedup(vx.cosine_topk(label_queries(spark, sf_dir), vec, k=20, with_vectors=True))
    return kept.select("query_id", "thread_id", r6("score").alias("score"), "rank")


def _search_parts(spark, sf_dir):
    q = label_queries(spark, sf_dir)
    matched = sr.matched_threads(q, fx.planted_vectors(spark, sf_dir))  # written once
    return q, matched, trending_threads(spark, sf_dir), fx.keyed_comments(spark, sf_dir), fx.bodies(spark, sf_dir)


@query("query_context")
def q_query_context(spark, sf_dir):
    q, matched, threads, comments, bodies = _search_parts(spark, sf_dir)
    return sr.query_context(q, matched, threads, comments, bodies=bodies)


@query("query_summary")
def q_query_summary(spark, sf_dir):
    q, matched, threads, comments, bodies = _search_parts(spark, sf_dir)
    return sr.query_context(q, matched, threads, comments, bodies=bodies).select("query_id", tx.query_summary("context").alias("summary"))


def _flat_cards(spark, sf_dir):
    q, matched, threads, comments, bodies = _search_parts(spark, sf_dir)
    c = sr.thread_cards(matched, threads, comments, bodies=bodies)
    return c.select(
        "query_id", "thread_id", "title", "url", "score", "num_comments", "similarity", "sentiment_avg",
        F.col("sentiment_dist.positive").alias("positive"), F.col("sentiment_dist.neutral").alias("neutral"),
        F.col("sentiment_dist.negative").alias("negative"),
        F.size("comment_timeline").cast("long").alias("n_days"),
        F.aggregate("comment_timeline", F.lit(0).cast("long"), lambda a, p: a + p["count"]).alias("timeline_count"))


@query("thread_cards")
def q_thread_cards(spark, sf_dir):
    return _flat_cards(spark, sf_dir)


@query("similarity_pct")
def q_similarity_pct(spark, sf_dir):
    return _flat_cards(spark, sf_dir).select("query_id", "thread_id", sc.similarity_pct("similarity").alias("similarity_pct"))


@query("sentiment_share")
def q_sentiment_share(spark, sf_dir):
    c = _flat_cards(spark, sf_dir)
    s = sc.sentiment_share("positive", "neutral", "negative")
    return c.select("query_id", "thread_id", s.alias("s")).select(
        "query_id", "thread_id", *[r6(F.col(f"s.{k}")).alias(k) for k in ("positive_pct", "neutral_pct", "negative_pct")])


@query("search")
def q_search(spark, sf_dir):
    """X4, one row for each card in order (one row without a card where nothing matched)."""
    found = sr.search(label_queries(spark, sf_dir), fx.planted_vectors(spark, sf_dir), trending_threads(spark, sf_dir),
                      fx.keyed_comments(spark, sf_dir), bodies=fx.bodies(spark, sf_dir))
    c = found.select("query_id", "query_text", "summary", F.posexplode_outer("threads").alias("position", "card"))
    return c.select(
        "query_id", "query_text", "summary", "position",
        *[F.col(f"card.{k}").alias(k) for k in ("thread_id", "title", "url", "score", "num_comments", "similarity", "sentiment_avg")],
        *[F.col(f"card.sentiment_dist.{k}").alias(k) for k in ("positive", "neutral", "negative")],
        F.size("card.comment_timeline").cast("long").alias("n_days"),
        F.aggregate("card.comment_timeline", F.lit(0).cast("long"), lambda a, p: a + p["count"]).alias("timeline_count"))


# --------------------------------------------------------------- clustering, embedding, batch
from ..operators import cluster as cu  # noqa: E402
from ..operators import embed as em  # noqa: E402
from ..operators import prompts as pr  # noqa: E402
from ..sources import html as hx  # noqa: E402


@query("reduce_dims")
def q_reduce_dims(spark, sf_dir):
    return cu.reduce_dims(fx.planted_vectors(spark, sf_dir, alpha=2.0).select("thread_id", "embedding"))


@query("topic_clusters")
def q_topic_clusters(spark, sf_dir):
    v = fx.planted_vectors(spark, sf_dir, alpha=2.0).select("thread_id", "embedding")
    return cu.topic_clusters(v)


@query("trending_topics")
def q_trending_topics(spark, sf_dir):
    store = fx.planted_vectors(spark, sf_dir, alpha=2.0).select("thread_id", "embedding")
    return tg.trending_topics(trending_threads(spark, sf_dir), fx.keyed_comments(spark, sf_dir), store, bodies=fx.bodies(spark, sf_dir)).cards


@query("embed_texts")
def q_embed_texts(spark, sf_dir):
    return em.embed(trending_threads(spark, sf_dir), "title_and_selftext")


@query("strip_html")
def q_strip_html(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", hx.strip_html("html").alias("text"))


@query("page_main_text")
def q_page_main_text(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", "url", hx.page_main_text("html").alias("text"))


@query("prompt_payloads")
def q_prompt_payloads(spark, sf_dir):
    """X9, all four payloads: topics, queries, the queries' clustered comments and their linked articles."""
    topic = pr.topic_prompts(cd.topic_context(scored_trending(spark, sf_dir))).select(
        F.concat(F.lit("topic-"), F.col("topic_id").cast("string")).alias("key"), "prompt")
    q, matched, threads, comments, bodies = _search_parts(spark, sf_dir)
    threads, comments = sr.matched_rows(matched, threads, comments, bodies)
    listed = sr.listed_threads(matched, threads)
    prompts = {
        "query-": pr.query_prompts(sr.query_context(q, matched, threads, comments)),
        "community-": pr.community_prompts(q, sr.comment_clusters(matched, comments)),
        "articles-": pr.article_prompts(q, listed, sr.linked_articles(listed, table(spark, sf_dir, "pages").select("url", "html"))),
    }
    for kind, p in prompts.items():
        topic = topic.unionByName(p.select(F.concat(F.lit(kind), F.col("query_id")).alias("key"), "prompt"))
    return topic


@query("extract_json")
def q_extract_json(spark, sf_dir):
    """T17 on the JSON objects embedded in ``events.props``."""
    e = table(spark, sf_dir, "events")
    j = tx.extract_json("props", "k INT")
    return e.select("event_id", j["k"].alias("k"), j.isNotNull().alias("is_valid"))


@query("response_text")
def q_response_text(spark, sf_dir):
    """T18 on every document's text, wrapped in the response shapes."""
    return fx.model_responses(spark, sf_dir).select("doc_id", tx.response_text("response").alias("text"))


@query("text_search")
def q_text_search(spark, sf_dir):
    """V1 + V2 + X4: benchmark passages as query texts against thread texts, one fitted encoder."""
    threads = trending_threads(spark, sf_dir)
    model = em.fit_hashing_encoder(threads, "title_and_selftext")
    vecs = em.embed_with(model, threads, "title_and_selftext")
    qs = table(spark, sf_dir, "benchmark").select(
        F.concat(F.lit("bench-"), F.col("item_id").cast("string")).alias("query_id"), F.col("text").alias("query_text"))
    qv = em.embed_with(model, qs, "query_text", "query_id").join(qs, "query_id")
    return sr.search(qv, vecs, threads, fx.keyed_comments(spark, sf_dir), bodies=fx.bodies(spark, sf_dir))
