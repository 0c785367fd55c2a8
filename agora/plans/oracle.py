"""DuckDB oracle SQL for every SQL-checkable query in the catalog.

Each statement runs against the driver's pre-registered views (documents,
events, embeddings, pages, orders, lineitem, ...).  The forum fixtures of
FIXTURES.md are inlined as CTEs.  Regexes are written for DuckDB's engine
(RE2: ASCII ``\\s``/``\\b``) and never shared with the Java dialect.
"""

from __future__ import annotations

FX = {
    "fx_threads": """
SELECT CASE WHEN d.doc_id % 17 = 3 THEN 'moved-' ELSE '' END || d.doc_id AS thread_id, split_part(d.text, chr(10), 1) AS title,
  substr(d.text, length(split_part(d.text, chr(10), 1)) + 2) AS selftext,
  CASE WHEN d.doc_id % 4 = 0 THEN NULL ELSE ' ' || upper(d.source) || ' ' END AS link_flair_text,
  CASE WHEN d.doc_id % 13 = 5 THEN NULL
       ELSE TIMESTAMP '2024-01-10 00:00:00' + to_hours(CAST(d.doc_id * 7 % 470 AS INTEGER)) END AS created_utc,
  CASE WHEN d.doc_id % 11 = 0 THEN NULL ELSE CAST(d.n_chars % 500 - 50 AS INTEGER) END AS score,
  CAST(d.n_chars % 37 AS INTEGER) AS num_comments, p.url AS external_url
FROM documents d LEFT JOIN pages p ON p.page_id = d.doc_id""",
    "fx_planted": """
SELECT doc_id, CASE doc_id % 4 WHEN 1 THEN text || '  https://ex.org/a?b=' || doc_id || ' www.ex.org/c end'
  WHEN 2 THEN '> quoted line' || chr(10) || text || chr(10) || '  > another'
  WHEN 3 THEN text || ' ' || chr(128512) || '  ok' || chr(160) || chr(9) || ' end' ELSE text END AS text FROM documents
UNION ALL SELECT -doc_id - 1, CASE WHEN doc_id % 2 = 0 THEN ' [deleted] ' ELSE '[removed]' END FROM documents WHERE doc_id % 7 = 0""",
    "fx_comments": """
SELECT CAST(e.event_id AS VARCHAR) AS comment_id, CAST(e.user_id AS VARCHAR) AS thread_id,
  d.text AS body,
  CASE WHEN e.event_id % 53 = 0 THEN NULL ELSE CAST(floor(e.value) AS INTEGER) - 30 END AS score,
  CASE WHEN e.event_id % 97 = 0 THEN NULL ELSE e.ts END AS created_utc
FROM events e CROSS JOIN (SELECT count(*) AS n FROM documents) k
JOIN documents d ON d.doc_id = e.event_id % k.n""",
    "fx_topics": """
SELECT CASE WHEN vec_id % 7 = 6 THEN 'moved-' ELSE '' END || vec_id AS thread_id, CASE WHEN label = 0 THEN -1 ELSE label END AS topic_id
FROM embeddings""",
    "fx_vec3": """
SELECT CAST(vec_id AS VARCHAR) AS thread_id, label,
  list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS embedding
FROM (SELECT vec_id, label, list_transform(range(1, 65), lambda i: CAST(embedding[i] AS DOUBLE)
        + CASE WHEN i = label + 1 THEN 3.0 ELSE 0.0 END) AS v FROM embeddings)""",
    "fx_store": """
SELECT CAST(vec_id AS VARCHAR) AS thread_id, CAST(embedding AS DOUBLE[]) AS embedding FROM embeddings""",
    "fx_big_threads": """
SELECT CAST(o_orderkey AS VARCHAR) AS thread_id, concat_ws(' ', o_orderstatus, o_orderpriority) AS title,
  '' AS selftext, o_orderpriority AS link_flair_text, o_orderdate AS created_utc,
  CAST(floor(o_totalprice / 1000) AS INTEGER) AS score, CAST(o_custkey % 37 AS INTEGER) AS num_comments,
  CAST(NULL AS VARCHAR) AS external_url
FROM orders""",
    "fx_big_comments": """
SELECT concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey,
         CAST(round(l_extendedprice * 100) AS BIGINT)) AS comment_id,
  CAST(l_orderkey AS VARCHAR) AS thread_id, l_returnflag || ' ' || l_linestatus AS body,
  CAST(l_quantity AS INTEGER) - 10 AS score, l_shipdate AS created_utc
FROM lineitem""",
}

# Shared derived CTEs (written once, reused by several statements).
DERIVED = {
    "known": "SELECT * FROM fx_comments WHERE thread_id IN (SELECT thread_id FROM fx_threads) AND created_utc IS NOT NULL",
    "bounds": "SELECT max(created_utc) AS window_end FROM known",
    "win": """SELECT k.* FROM known k, bounds b
  WHERE k.created_utc BETWEEN b.window_end - INTERVAL 14 DAY AND b.window_end""",
    "active": "SELECT * FROM fx_threads WHERE thread_id IN (SELECT thread_id FROM win) AND created_utc IS NOT NULL",
    "scored": """SELECT a.*, t.topic_id,
  ln(1 + (CASE WHEN a.score < 0 THEN 0 ELSE a.score END)
       + (CASE WHEN a.num_comments < 0 THEN 0 ELSE a.num_comments END))
  / (1 + (epoch_us(b.window_end) - epoch_us(a.created_utc)) / 3.6e9) AS trend_score
FROM active a JOIN fx_topics t ON t.thread_id = a.thread_id CROSS JOIN bounds b WHERE t.topic_id <> -1""",
    "trends": """SELECT topic_id, coalesce(sum(trend_score), 0) / sqrt(count(thread_id)) AS topic_trend_score,
  count(thread_id) AS thread_count, max(created_utc) AS last_activity FROM scored GROUP BY topic_id""",
}

DEPENDS = {
    "known": ["fx_comments", "fx_threads"], "bounds": ["known"], "win": ["known", "bounds"],
    "active": ["fx_threads", "win"], "scored": ["active", "fx_topics", "bounds"], "trends": ["scored"],
}


def _closure(names: list[str]) -> list[str]:
    order: list[str] = []

    def visit(n: str) -> None:
        if n in order:
            return
        for d in DEPENDS.get(n, []):
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    return order


def sql(uses: list[str], body: str, ctes: list[tuple[str, str]] = ()) -> str:
    """WITH [RECURSIVE] <fixtures and shared CTEs used> [, own ctes] <body>."""
    parts = []
    for n in _closure(uses):
        text = FX.get(n) or DERIVED[n]
        parts.append(f"{n} AS ({text.strip()})")
    parts += [f"{n} AS ({t.strip()})" for n, t in ctes]
    head = "WITH RECURSIVE " if any("RECURSIVE" in t for _, t in ctes) else "WITH "
    parts = [p.replace("/*RECURSIVE*/", "") for p in parts]
    return (head + ",\n".join(parts) + "\n" if parts else "") + body.strip()


ORACLE: dict[str, str] = {}


def oracle(name: str, uses: list[str], body: str, ctes: list[tuple[str, str]] = ()) -> None:
    ORACLE[name] = sql(uses, body, ctes)


# --------------------------------------------------------------- trending core
oracle("topic_trends", ["trends"], """
SELECT topic_id, round(topic_trend_score, 6) AS topic_trend_score, thread_count, last_activity FROM trends""")

# --------------------------------------------------------------- DuckDB text helpers
# Unicode White_Space, spelled out for RE2 (its \s is ASCII only).
WS = r"[\t\n\x0b\f\r\x1c-\x1f \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
LINEBREAK = r"[\n\x0b\f\r\x1c-\x1e\x{85}\x{2028}\x{2029}]"
EMOJI = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
         r"\x{2600}-\x{2B55}\x{200D}\x{23CF}\x{23E9}\x{231A}\x{FE0F}\x{3030}]+")


WS_STRIP = WS


def d_strip(x: str) -> str:
    return f"regexp_replace({x}, '^{WS_STRIP}+|{WS_STRIP}+$', '', 'g')"


def d_collapse(x: str) -> str:
    return f"regexp_replace({x}, '{WS}{{2,}}', ' ', 'g')"


def d_urls(x: str) -> str:
    return f"regexp_replace({x}, '(?:https|http)?://\\S+\\b', '', 'g')"


def d_emoji(x: str) -> str:
    return f"regexp_replace({x}, '{EMOJI}', '', 'g')"


def d_blank(x: str) -> str:
    return f"CASE WHEN {x} IS NULL OR lower({x}) IN ('[deleted]', '[removed]', 'nan', 'none') THEN '' ELSE {x} END"


def d_flatten(x: str) -> str:
    return f"replace(replace(replace({x}, chr(13) || chr(10), ' '), chr(10), ' '), chr(13), ' ')"


def d_quotes(x: str) -> str:
    unix = f"replace({x}, chr(13) || chr(10), chr(10))"
    lines = f"string_split_regex(regexp_replace({unix}, '{LINEBREAK}$', ''), '{LINEBREAK}')"
    return f"array_to_string(list_filter({lines}, lambda l: NOT regexp_matches(l, '^{WS}*>')), chr(10))"


def d_normalize(x: str) -> str:
    # HTML step is identity + strip on markup-free text (documents hold no '<' and no entity).
    return d_strip(d_collapse(d_emoji(d_urls(d_strip(d_flatten(d_blank(x)))))))


def d_words(x: str) -> str:
    return f"len(list_filter(string_split_regex({d_strip(f'coalesce({x}, {chr(39)}{chr(39)})')}, '{WS}+'), lambda w: w <> ''))"


def d_tas(t: str, s: str) -> str:
    return f"concat({d_strip(f'coalesce({t}, {chr(39)}{chr(39)})')}, chr(10) || chr(10), {d_strip(f'coalesce({s}, {chr(39)}{chr(39)})')})"


def d_clip0(x: str) -> str:
    return f"(CASE WHEN {x} < 0 THEN 0 ELSE {x} END)"


def d_hours(as_of: str, ts: str) -> str:
    return f"((epoch_us({as_of}) - epoch_us({ts})) / 3.6e9)"


# --------------------------------------------------------------- text functions
oracle("collapse_ws", ["fx_planted"], f"SELECT doc_id, {d_collapse('text')} AS collapsed FROM fx_planted")
oracle("remove_urls", ["fx_planted"], f"SELECT doc_id, {d_urls('text')} AS no_urls FROM fx_planted")
oracle("remove_emojis", ["fx_planted"], f"SELECT doc_id, {d_emoji('text')} AS no_emojis FROM fx_planted")
oracle("remove_quotes", ["fx_planted"], f"SELECT doc_id, {d_quotes('text')} AS unquoted FROM fx_planted")
oracle("blank_markers", ["fx_planted"], f"SELECT doc_id, {d_blank('text')} AS unmarked FROM fx_planted")
oracle("normalize_text", ["fx_planted"], f"SELECT doc_id, {d_normalize('text')} AS normalized FROM fx_planted")
oracle("word_count", ["fx_planted"], f"SELECT doc_id, {d_words('text')} AS n_words FROM fx_planted")
oracle("has_image", ["fx_threads"], "SELECT thread_id, thread_id IN (SELECT CAST(page_id AS VARCHAR) FROM pages) AS has_image FROM fx_threads")
oracle("flair_norm", ["fx_threads"],
       f"SELECT thread_id, lower({d_strip(chr(39).join(['coalesce(link_flair_text, ', '[No Flair]', ')']))}) AS flair FROM fx_threads")
oracle("title_and_selftext", ["fx_threads"],
       f"SELECT thread_id, {d_tas('title', 'selftext')} AS title_and_selftext FROM fx_threads")
oracle("snippet", ["fx_threads"], f"""
SELECT thread_id,
  {d_strip("replace(substr(coalesce(selftext, ''), 1, 300), chr(10), ' ')")} AS cut_then_flat,
  substr(replace(coalesce(selftext, ''), chr(10), ' '), 1, 250) AS flat_then_cut,
  {d_strip("substr(coalesce(selftext, ''), 1, 200)")} AS card_title,
  CASE WHEN length(title) > 18 THEN substr(title, 1, 18) || '...' ELSE title END AS chart_label
FROM fx_threads""")
oracle("resolve_url", ["fx_threads"], """
SELECT thread_id, coalesce(external_url, '') AS thread_url,
  CASE WHEN starts_with(coalesce(p, ''), 'http') THEN coalesce(p, '') ELSE 'https://www.reddit.com' || coalesce(p, '') END
    AS permalink_url
FROM (SELECT *, CASE WHEN score IS NULL THEN external_url ELSE '/r/forum/comments/' || thread_id END AS p FROM fx_threads)""")

# --------------------------------------------------------------- time / score functions
oracle("parse_ts", ["fx_comments"], """
SELECT comment_id, TRY_CAST(raw AS TIMESTAMP) AS parsed FROM (
  SELECT comment_id, CASE WHEN score IS NULL THEN 'not a time' ELSE strftime(created_utc, '%Y-%m-%d %H:%M:%S.%f') END AS raw
  FROM fx_comments)""")
oracle("relative_time", ["fx_threads", "bounds"], """
SELECT thread_id,
  CASE WHEN m < 60 THEN CAST(m AS VARCHAR) || 'm ago'
       WHEN floor(m / 60) < 24 THEN CAST(CAST(floor(m / 60) AS BIGINT) AS VARCHAR) || 'h ago'
       ELSE CAST(CAST(floor(floor(m / 60) / 24) AS BIGINT) AS VARCHAR) || 'd ago' END AS age
FROM (SELECT t.thread_id, CAST(floor((epoch_us(b.window_end) - epoch_us(t.created_utc)) / 60000000.0) AS BIGINT) AS m
      FROM fx_threads t CROSS JOIN bounds b WHERE t.created_utc IS NOT NULL)""")
oracle("comment_priority", ["win", "bounds"], f"""
SELECT w.comment_id, round({d_clip0('w.score')} / (1 + {d_hours('b.window_end', 'w.created_utc')}), 6) AS comment_priority
FROM win w CROSS JOIN bounds b""")
oracle("trend_score", ["active", "bounds"], f"""
SELECT a.thread_id, round(ln(1 + {d_clip0('a.score')} + {d_clip0('a.num_comments')})
  / (1 + {d_hours('b.window_end', 'a.created_utc')}), 6) AS trend_score
FROM active a CROSS JOIN bounds b""")

# --------------------------------------------------------------- filters / joins
oracle("drop_short_comments", ["fx_comments"], f"""
SELECT comment_id, n_words AS body_len FROM (SELECT comment_id, {d_words('body')} AS n_words FROM fx_comments)
WHERE n_words >= 3""")
oracle("known_thread_comments", ["known"], "SELECT comment_id, thread_id FROM fx_comments WHERE thread_id IN (SELECT thread_id FROM fx_threads)")
oracle("active_window", ["win"], "SELECT comment_id, thread_id, created_utc FROM win")
oracle("active_threads", ["active"], "SELECT thread_id, created_utc FROM active")
oracle("embedding_scan", ["fx_store"], """
SELECT thread_id, len(embedding) AS dim, round(sqrt(list_dot_product(embedding, embedding)), 6) AS norm FROM fx_store""")
oracle("active_embeddings", ["active", "fx_store"], """
SELECT a.thread_id, s.embedding FROM active a JOIN fx_store s ON s.thread_id = a.thread_id""")

# --------------------------------------------------------------- ranking
oracle("dedupe_threads", ["fx_threads"], """
SELECT thread_id, score, created_utc, external_url FROM (
  SELECT *, row_number() OVER (PARTITION BY thread_id ORDER BY score DESC NULLS LAST, created_utc ASC NULLS LAST,
      external_url ASC NULLS LAST, title ASC NULLS LAST, selftext ASC NULLS LAST) AS rn
  FROM (SELECT * FROM fx_threads UNION ALL
        SELECT thread_id, title, selftext, link_flair_text, created_utc, score - 1, num_comments, external_url
        FROM fx_threads WHERE CAST(replace(thread_id, 'moved-', '') AS BIGINT) % 5 = 0))
WHERE rn = 1""")
oracle("top_comments_by_priority", ["win", "bounds"], f"""
SELECT thread_id, comment_id, rank FROM (
  SELECT w.thread_id, w.comment_id, row_number() OVER (PARTITION BY w.thread_id
      ORDER BY {d_clip0('w.score')} / (1 + {d_hours('b.window_end', 'w.created_utc')}) DESC NULLS LAST, w.comment_id) AS rank
  FROM win w CROSS JOIN bounds b) WHERE rank <= 5""")
oracle("top_comments_by_score", ["fx_big_comments"], """
SELECT thread_id, comment_id, score, rank FROM (
  SELECT thread_id, comment_id, score,
    row_number() OVER (PARTITION BY thread_id ORDER BY score DESC NULLS LAST, comment_id) AS rank
  FROM fx_big_comments) WHERE rank <= 5""")
oracle("latest_threads_per_topic", ["scored"], """
SELECT topic_id, thread_id, created_utc, rank FROM (
  SELECT topic_id, thread_id, created_utc,
    row_number() OVER (PARTITION BY topic_id ORDER BY created_utc DESC NULLS LAST, thread_id) AS rank
  FROM scored) WHERE rank <= 5""")
oracle("top_threads_by_trend", ["scored"], """
SELECT topic_id, thread_id, round(trend_score, 6) AS trend_score, rank FROM (
  SELECT topic_id, thread_id, trend_score,
    row_number() OVER (PARTITION BY topic_id ORDER BY trend_score DESC NULLS LAST, thread_id) AS rank
  FROM scored) WHERE rank <= 5""")
oracle("top_topics", ["trends"], """
SELECT topic_id, round(topic_trend_score, 6) AS topic_trend_score, thread_count
FROM trends ORDER BY topic_trend_score DESC NULLS LAST, topic_id LIMIT 3""")

# --------------------------------------------------------------- documents
DERIVED["topc"] = f"""SELECT thread_id, string_agg(b, ' ' ORDER BY rank) AS top_comments_text FROM (
  SELECT w.thread_id, substr(replace(coalesce(w.body, ''), chr(10), ' '), 1, 250) AS b,
    row_number() OVER (PARTITION BY w.thread_id
      ORDER BY {d_clip0('w.score')} / (1 + {d_hours('b.window_end', 'w.created_utc')}) DESC NULLS LAST, w.comment_id) AS rank
  FROM win w CROSS JOIN bounds b) WHERE rank <= 5 GROUP BY thread_id"""
DEPENDS["topc"] = ["win", "bounds"]
DERIVED["docs"] = f"""SELECT a.thread_id, coalesce(a.external_url, '') AS thread_url, a.created_utc, a.score, a.num_comments,
  {d_tas('a.title', 'a.selftext')} AS title_and_selftext, coalesce(c.top_comments_text, '') AS top_comments_text
FROM active a LEFT JOIN topc c ON c.thread_id = a.thread_id"""
DEPENDS["docs"] = ["active", "topc"]
oracle("top_comments_text", ["topc"], "SELECT thread_id, top_comments_text FROM topc")
oracle("build_docs", ["docs"], f"""
SELECT thread_id, thread_url, created_utc, score, num_comments, top_comments_text,
  {d_strip("title_and_selftext || ' ' || top_comments_text")} AS thread_doc FROM docs""")

# --------------------------------------------------------------- cleaning
oracle("clean_threads", ["fx_threads"], f"""
SELECT thread_id, lower({d_strip(chr(39).join(['coalesce(link_flair_text, ', '[No Flair]', ')']))}) AS link_flair_text,
  false AS has_image, {d_normalize(d_tas('title', 'selftext'))} AS title_and_selftext
FROM fx_threads""")
oracle("clean_comments", ["fx_comments"], f"""
SELECT comment_id, thread_id, body, body_len FROM (
  SELECT comment_id, thread_id, b AS body, {d_words('b')} AS body_len
  FROM (SELECT comment_id, thread_id, {d_normalize(d_quotes("coalesce(body, '')"))} AS b FROM fx_comments))
WHERE body_len >= 3""")

# --------------------------------------------------------------- sentiment
from ..functions import sentiment as _se  # noqa: E402


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _map_sql(d: dict) -> str:
    return ("MAP([" + ", ".join(_q(k) for k in d) + "], CAST(["
            + ", ".join(repr(float(v)) for v in d.values()) + "] AS DOUBLE[]))")


LEX_SQL = _map_sql(_se.DEFAULT_LEXICON)
BOOST_SQL = _map_sql(_se.BOOSTERS)
NEG_SQL = "[" + ", ".join(_q(w) for w in _se.NEGATORS) + "]"


def d_raw_tokens(x: str) -> str:
    return f"list_filter(string_split_regex(coalesce({x}, ''), '[^\\pL\\pN'']+'), lambda t: t <> '')"


def _d_token_value() -> str:
    """Per-token valence (lambda t, i over ``low``; 1-based i) with all word-level rules."""
    base = f"map_extract_value({LEX_SQL}, t)"
    caps = (f"CASE WHEN mixed AND upper(raw[i]) = raw[i] AND lower(raw[i]) <> raw[i] "
            f"THEN sign({base}) * {_se.CAPS_EMPHASIS} ELSE 0.0 END")
    boost = " + ".join(
        f"CASE WHEN i > {k} THEN coalesce(map_extract_value({BOOST_SQL}, low[i - {k}]), 0.0) * {damp} ELSE 0.0 END"
        for k, damp in enumerate(_se.BOOSTER_DAMPING, start=1))
    v1 = f"({base} + {caps} + CASE WHEN {base} < 0 THEN -({boost}) ELSE ({boost}) END)"
    neg = f"list_has_any(list_slice(low, greatest(i - {_se.NEGATION_WINDOW}, 1), i - 1), {NEG_SQL})"
    v2 = f"(CASE WHEN {neg} THEN {v1} * ({_se.NEGATION_SCALE}) ELSE {v1} END)"
    v3 = (f"(CASE WHEN butp > 0 THEN CASE WHEN i < butp THEN {v2} * {_se.BUT_BEFORE} "
          f"WHEN i > butp THEN {v2} * {_se.BUT_AFTER} ELSE {v2} END ELSE {v2} END)")
    return f"CASE WHEN {base} IS NOT NULL THEN {v3} ELSE 0.0 END"


def d_sentiment_cte(src: str, text: str) -> str:
    """SELECT *, compound FROM src, scoring column ``text``."""
    ex = f"least(length(txt) - length(replace(txt, '!', '')), {_se.EXCLAMATION_MAX}) * {_se.EXCLAMATION_WEIGHT}"
    q = "(length(txt) - length(replace(txt, '?', '')))"
    qe = (f"CASE WHEN {q} > 1 THEN CASE WHEN {q} <= {_se.QUESTION_MAX} THEN {q} * {_se.QUESTION_WEIGHT} "
          f"ELSE {_se.QUESTION_CAP} END ELSE 0.0 END")
    return f"""SELECT *, s2 / sqrt(s2 * s2 + {_se.COMPOUND_ALPHA}) AS compound FROM (
  SELECT *, CASE WHEN s > 0 THEN s + ep WHEN s < 0 THEN s - ep ELSE s END AS s2 FROM (
    SELECT *, coalesce(list_sum(list_transform(low, lambda t, i: {_d_token_value()})), 0.0) AS s,
      {ex} + {qe} AS ep FROM (
      SELECT *, len(list_filter(raw, lambda u: u <> upper(u))) > 0 AS mixed,
        coalesce(list_position(low, 'but'), 0) AS butp FROM (
        SELECT *, list_transform(raw, lambda t: lower(t)) AS low FROM (
          SELECT *, coalesce({text}, '') AS txt, {d_raw_tokens(text)} AS raw FROM {src})))))"""


def d_bucket(c: str) -> str:
    return f"CASE WHEN {c} >= 0.05 THEN 'positive' WHEN {c} <= -0.05 THEN 'negative' ELSE 'neutral' END"


DERIVED["csent"] = d_sentiment_cte("fx_comments", "body")
DEPENDS["csent"] = ["fx_comments"]
oracle("sentiment_compound", ["csent"], "SELECT comment_id, round(compound, 6) AS compound FROM csent")
oracle("sentiment_bucket", ["csent"], f"SELECT comment_id, {d_bucket('compound')} AS bucket FROM csent")
DIST = """count(*) FILTER (WHERE compound >= 0.05) AS positive,
  count(*) FILTER (WHERE compound > -0.05 AND compound < 0.05) AS neutral,
  count(*) FILTER (WHERE compound <= -0.05) AS negative, count(*) AS total_comments"""
oracle("sentiment_dist", ["csent"], f"SELECT thread_id, {DIST} FROM csent GROUP BY thread_id")
oracle("sentiment_avg", ["csent"], "SELECT thread_id, round(coalesce(avg(compound), 0.0), 3) AS sentiment_avg FROM csent GROUP BY thread_id")
oracle("daily_timeline", ["fx_comments"], """
SELECT thread_id, strftime(created_utc, '%Y-%m-%d') AS date, count(*) AS count FROM fx_comments
WHERE created_utc IS NOT NULL GROUP BY 1, 2""")

# --------------------------------------------------------------- contexts, cards, roll-ups
DERIVED["dscored"] = f"""SELECT s.*, coalesce(s.external_url, '') AS thread_url,
  {d_tas('s.title', 's.selftext')} AS title_and_selftext, coalesce(c.top_comments_text, '') AS top_comments_text
FROM scored s LEFT JOIN topc c ON c.thread_id = s.thread_id"""
DEPENDS["dscored"] = ["scored", "topc"]
DERIVED["allctx"] = f"""SELECT topic_id, substr(string_agg(line, chr(10) ORDER BY rank), 1, 2500) AS context FROM (
  SELECT topic_id,
    '- ' || {d_strip("replace(substr(title_and_selftext, 1, 220), chr(10), ' ')")} || chr(10) || '  '
      || {d_strip("replace(substr(top_comments_text, 1, 350), chr(10), ' ')")} AS line,
    row_number() OVER (PARTITION BY topic_id ORDER BY trend_score DESC NULLS LAST, thread_id) AS rank
  FROM dscored) WHERE rank <= 5 GROUP BY topic_id"""
DEPENDS["allctx"] = ["dscored"]
_head = d_strip("trim(substr(split_part(context, chr(10), 1), 1, 60), '- ')")
DERIVED["allsum"] = f"""SELECT topic_id, CASE WHEN h <> '' THEN substr(h, 1, 40) ELSE 'Topic ' || topic_id END AS headline,
  'Placeholder summary for topic ' || topic_id || '.' AS summary FROM (SELECT topic_id, {_head} AS h FROM allctx)"""
DEPENDS["allsum"] = ["allctx"]
DERIVED["toptop"] = """SELECT topic_id, topic_trend_score, thread_count FROM trends
  ORDER BY topic_trend_score DESC NULLS LAST, topic_id LIMIT 3"""
DEPENDS["toptop"] = ["trends"]
DERIVED["listed"] = """SELECT * FROM (SELECT d.*, row_number() OVER (PARTITION BY d.topic_id
    ORDER BY d.created_utc DESC NULLS LAST, d.thread_id) AS rank
  FROM dscored d WHERE d.topic_id IN (SELECT topic_id FROM toptop)) WHERE rank <= 5"""
DEPENDS["listed"] = ["dscored", "toptop"]
DERIVED["tcoms"] = "SELECT l.topic_id, c.* FROM csent c JOIN listed l ON c.thread_id = l.thread_id"
DEPENDS["tcoms"] = ["csent", "listed"]
DERIVED["tstats"] = f"SELECT topic_id, {DIST}, max(created_utc) AS last_updated FROM tcoms GROUP BY topic_id"
DEPENDS["tstats"] = ["tcoms"]
DERIVED["tdaily"] = """SELECT topic_id, strftime(created_utc, '%Y-%m-%d') AS date, count(*) AS count FROM tcoms
  WHERE created_utc IS NOT NULL GROUP BY 1, 2"""
DEPENDS["tdaily"] = ["tcoms"]
DERIVED["cards"] = """SELECT t.topic_id, s.headline, s.summary, t.topic_trend_score,
  (SELECT string_agg(l.thread_id, ',' ORDER BY l.rank) FROM listed l WHERE l.topic_id = t.topic_id) AS thread_ids,
  coalesce(st.positive, 0) AS positive, coalesce(st.neutral, 0) AS neutral, coalesce(st.negative, 0) AS negative,
  coalesce(st.total_comments, 0) AS total_comments,
  strftime(st.last_updated, '%Y-%m-%d %H:%M:%S+00:00') AS last_updated,
  (SELECT count(*) FROM tdaily d WHERE d.topic_id = t.topic_id) AS n_days,
  (SELECT CAST(coalesce(sum(d.count), 0) AS BIGINT) FROM tdaily d WHERE d.topic_id = t.topic_id) AS timeline_count
FROM toptop t LEFT JOIN allsum s ON s.topic_id = t.topic_id LEFT JOIN tstats st ON st.topic_id = t.topic_id"""
DEPENDS["cards"] = ["toptop", "allsum", "tstats", "tdaily", "listed"]
DERIVED["otl"] = "SELECT date, CAST(sum(count) AS BIGINT) AS count FROM tdaily GROUP BY date"
DEPENDS["otl"] = ["tdaily"]

oracle("topic_context", ["allctx"], "SELECT topic_id, context FROM allctx")
oracle("topic_headline", ["allsum"], "SELECT topic_id, headline, summary FROM allsum")
oracle("topic_cards", ["cards"], """
SELECT topic_id, headline, summary, round(topic_trend_score, 6) AS topic_trend_score, thread_ids, positive, neutral,
  negative, total_comments, last_updated, n_days, timeline_count FROM cards""")
oracle("overall_timeline", ["otl"], "SELECT date, count FROM otl")
oracle("overall_sentiment", ["tstats"], """
SELECT name, value FROM (
  SELECT 'Positive' AS name, CAST(coalesce(sum(positive), 0) AS BIGINT) AS value FROM tstats UNION ALL
  SELECT 'Neutral', CAST(coalesce(sum(neutral), 0) AS BIGINT) FROM tstats UNION ALL
  SELECT 'Negative', CAST(coalesce(sum(negative), 0) AS BIGINT) FROM tstats) WHERE value > 0""")
oracle("home_feed", ["cards", "otl"], """
SELECT (SELECT string_agg(concat_ws('|', CAST(topic_id AS VARCHAR), headline, summary, thread_ids, CAST(positive AS VARCHAR),
    CAST(neutral AS VARCHAR), CAST(negative AS VARCHAR), CAST(total_comments AS VARCHAR), last_updated, CAST(n_days AS VARCHAR)),
    chr(10) ORDER BY topic_trend_score DESC, topic_id) FROM cards) AS topics,
  (SELECT string_agg(date || '=' || count, ',' ORDER BY date) FROM otl) AS overall_timeline""")
oracle("recent_activity", ["otl"], """
SELECT substr(date, 6, 5) AS date, count FROM (SELECT * FROM otl ORDER BY date DESC LIMIT 14)""")
oracle("trend_bars", ["cards"], """
SELECT CASE WHEN length(headline) > 18 THEN substr(headline, 1, 18) || '...' ELSE headline END AS name,
  floor(topic_trend_score * 100 + 0.5) / 100 AS score FROM cards""")
oracle("sentiment_over_time", ["otl", "tstats", "tdaily"], """
SELECT substr(l.date, 6, 5) AS date,
  CASE WHEN coalesce(x.pos, 0) + coalesce(x.neu, 0) + coalesce(x.neg, 0) > 0
       THEN floor((x.pos - x.neg) / (x.pos + x.neu + x.neg) * 100 + 0.5) / 100 ELSE 0.0 END AS sentiment
FROM (SELECT date FROM otl ORDER BY date DESC LIMIT 14) l
LEFT JOIN (
  SELECT d.date,
    sum(CAST(s.positive AS DOUBLE) / (s.positive + s.neutral + s.negative) * d.count) AS pos,
    sum(CAST(s.neutral AS DOUBLE) / (s.positive + s.neutral + s.negative) * d.count) AS neu,
    sum(CAST(s.negative AS DOUBLE) / (s.positive + s.neutral + s.negative) * d.count) AS neg
  FROM tdaily d JOIN tstats s ON s.topic_id = d.topic_id
  WHERE s.total_comments > 0 AND s.positive + s.neutral + s.negative > 0 GROUP BY d.date) x ON x.date = l.date""")

# --------------------------------------------------------------- vectors and search
DERIVED["qcent"] = """SELECT 'label-' || label AS query_id, 'label-' || label AS query_text,
  list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS embedding FROM (
  SELECT label, list(x ORDER BY pos) AS v FROM (
    SELECT label, pos, avg(x) AS x FROM (
      SELECT label, unnest(embedding) AS x, unnest(range(0, len(embedding))) AS pos FROM fx_vec3)
    GROUP BY label, pos) GROUP BY label)"""
DEPENDS["qcent"] = ["fx_vec3"]


def _ctop(k: int) -> str:
    return f"""SELECT query_id, thread_id, score, rank FROM (
  SELECT q.query_id, v.thread_id, list_dot_product(v.embedding, q.embedding) AS score,
    row_number() OVER (PARTITION BY q.query_id ORDER BY list_dot_product(v.embedding, q.embedding) DESC, v.thread_id) AS rank
  FROM qcent q CROSS JOIN fx_vec3 v) WHERE rank <= {k}"""


def _greedy(k: int) -> list[tuple[str, str]]:
    return [
        ("cand", f"""SELECT c.query_id, c.thread_id, c.score, c.rank, v.embedding AS u
  FROM ({_ctop(k)}) c JOIN fx_vec3 v ON v.thread_id = c.thread_id"""),
        ("walk", """/*RECURSIVE*/ SELECT query_id, rank, [thread_id] AS kept_ids, [u] AS kept_vecs FROM cand WHERE rank = 1
  UNION ALL
  SELECT w.query_id, c.rank,
    CASE WHEN len(list_filter(w.kept_vecs, lambda y: list_dot_product(y, c.u) > 0.92)) > 0
         THEN w.kept_ids ELSE list_append(w.kept_ids, c.thread_id) END,
    CASE WHEN len(list_filter(w.kept_vecs, lambda y: list_dot_product(y, c.u) > 0.92)) > 0
         THEN w.kept_vecs ELSE list_append(w.kept_vecs, c.u) END
  FROM walk w JOIN cand c ON c.query_id = w.query_id AND c.rank = w.rank + 1"""),
        ("kept", """SELECT c.query_id, c.thread_id, c.score, c.rank FROM cand c
  JOIN (SELECT w.query_id, w.kept_ids FROM walk w
        JOIN (SELECT query_id, max(rank) AS r FROM cand GROUP BY query_id) m ON m.query_id = w.query_id AND m.r = w.rank) f
    ON f.query_id = c.query_id WHERE list_contains(f.kept_ids, c.thread_id)"""),
    ]


oracle("l2_normalize", ["fx_store"], """
SELECT thread_id, list_transform(embedding, lambda x: round(x / sqrt(list_dot_product(embedding, embedding)), 6)) AS unit
FROM fx_store""")
oracle("query_centroids", ["qcent"], "SELECT query_id, list_transform(embedding, lambda x: round(x, 6)) AS embedding FROM qcent")
oracle("cosine_topk", ["qcent", "fx_vec3"], f"SELECT query_id, thread_id, round(score, 6) AS score, rank FROM ({_ctop(5)})")
oracle("greedy_dedup", ["qcent", "fx_vec3"], "SELECT query_id, thread_id, round(score, 6) AS score, rank FROM kept",
       _greedy(20))

_SEARCH_CTES = _greedy(5) + [
    ("sthreads", f"SELECT *, {d_tas('title', 'selftext')} AS title_and_selftext FROM fx_threads"),
    ("mcom", """SELECT k.query_id, c.* FROM csent c JOIN kept k ON k.thread_id = c.thread_id"""),
    ("ctopc", f"""SELECT query_id, thread_id, string_agg('  - ' || b, chr(10) ORDER BY rank) AS clines FROM (
  SELECT query_id, thread_id, {d_strip("replace(substr(coalesce(body, ''), 1, 200), chr(10), ' ')")} AS b,
    row_number() OVER (PARTITION BY query_id, thread_id ORDER BY score DESC NULLS LAST, comment_id) AS rank
  FROM mcom) WHERE rank <= 5 AND b <> '' GROUP BY query_id, thread_id"""),
    ("blocks", f"""SELECT k.query_id, t.thread_id,
  concat_ws(chr(10), 'Thread: ' || {d_strip("replace(substr(t.title_and_selftext, 1, 300), chr(10), ' ')")}, x.clines, '') AS block
  FROM kept k JOIN sthreads t ON t.thread_id = k.thread_id
  LEFT JOIN ctopc x ON x.query_id = k.query_id AND x.thread_id = k.thread_id"""),
    ("qctx", """SELECT q.query_id, substr(CASE WHEN b.body IS NULL THEN h ELSE h || chr(10) || b.body END, 1, 3000) AS context
  FROM (SELECT query_id, 'USER QUERY: ' || query_text || chr(10) || chr(10) || 'RELEVANT REDDIT THREADS:' || chr(10) AS h
        FROM qcent) q
  LEFT JOIN (SELECT query_id, string_agg(block, chr(10) ORDER BY thread_id) AS body FROM blocks GROUP BY query_id) b
    ON b.query_id = q.query_id"""),
    ("tcards", f"""SELECT k.query_id, k.thread_id, {d_strip("substr(t.title_and_selftext, 1, 200)")} AS title,
  coalesce(t.external_url, '') AS url, coalesce(t.score, 0) AS score, coalesce(t.num_comments, 0) AS num_comments,
  round(coalesce(k.score, 0.0), 3) AS similarity,
  coalesce(st.sentiment_avg, 0.0) AS sentiment_avg, coalesce(st.positive, 0) AS positive,
  coalesce(st.neutral, 0) AS neutral, coalesce(st.negative, 0) AS negative,
  (SELECT count(DISTINCT strftime(m.created_utc, '%Y-%m-%d')) FROM mcom m
     WHERE m.query_id = k.query_id AND m.thread_id = k.thread_id AND m.created_utc IS NOT NULL) AS n_days,
  (SELECT count(m.created_utc) FROM mcom m WHERE m.query_id = k.query_id AND m.thread_id = k.thread_id) AS timeline_count
  FROM kept k JOIN sthreads t ON t.thread_id = k.thread_id
  LEFT JOIN (SELECT query_id, thread_id, {DIST}, round(coalesce(avg(compound), 0.0), 3) AS sentiment_avg
             FROM mcom GROUP BY 1, 2) st ON st.query_id = k.query_id AND st.thread_id = k.thread_id"""),
]
_SEARCH_USES = ["qcent", "fx_vec3", "fx_threads", "csent"]
oracle("query_context", _SEARCH_USES, "SELECT query_id, context FROM qctx", _SEARCH_CTES)
_SUMMARY = f"""
SELECT query_id, '[Placeholder summary] Based on the matched threads: ' || substr(array_to_string(list_slice(
  list_transform(list_filter(string_split(context, chr(10)), lambda l: {d_strip('l')} <> '' AND NOT starts_with(l, 'USER QUERY')),
                 lambda l: {d_strip('l')}), 1, 3), ' '), 1, 200) || '...' AS summary FROM qctx"""
oracle("query_summary", _SEARCH_USES, _SUMMARY, _SEARCH_CTES)
oracle("search", _SEARCH_USES, f"""
SELECT q.query_id, q.query_text, s.summary,
  CASE WHEN c.thread_id IS NOT NULL THEN CAST(row_number() OVER (PARTITION BY q.query_id ORDER BY c.similarity DESC, k.rank) - 1 AS INTEGER) END AS position,
  c.thread_id, c.title, c.url, c.score, c.num_comments, c.similarity, c.sentiment_avg, c.positive, c.neutral, c.negative,
  c.n_days, c.timeline_count
FROM qcent q LEFT JOIN ({_SUMMARY.strip()}) s ON s.query_id = q.query_id LEFT JOIN tcards c ON c.query_id = q.query_id
LEFT JOIN kept k ON k.query_id = c.query_id AND k.thread_id = c.thread_id""", _SEARCH_CTES)
oracle("thread_cards", _SEARCH_USES, "SELECT * FROM tcards", _SEARCH_CTES)
oracle("similarity_pct", _SEARCH_USES,
       "SELECT query_id, thread_id, CAST(floor(similarity * 100 + 0.5) AS BIGINT) AS similarity_pct FROM tcards",
       _SEARCH_CTES)
oracle("sentiment_share", _SEARCH_USES, """
SELECT query_id, thread_id,
  CASE WHEN t > 0 THEN round(100.0 * positive / t, 6) END AS positive_pct,
  CASE WHEN t > 0 THEN round(100.0 * neutral / t, 6) END AS neutral_pct,
  CASE WHEN t > 0 THEN round(100.0 - 100.0 * positive / t - 100.0 * neutral / t, 6) END AS negative_pct
FROM (SELECT *, positive + neutral + negative AS t FROM tcards)""", _SEARCH_CTES)

# --------------------------------------------------------------- JSON extraction
oracle("extract_json", [], """
SELECT event_id, TRY_CAST(json_extract(NULLIF(regexp_extract(props, '(?s)\\{.*\\}', 0), ''), '$.k') AS INTEGER) AS k,
  regexp_extract(props, '(?s)\\{.*\\}', 0) <> '' AS is_valid FROM events""")

oracle("response_text", [], "SELECT doc_id, coalesce(text, '') AS text FROM documents")

# --------------------------------------------------------------- markup
_SPACES = "".join(c for c in map(chr, range(0x3001)) if c.isspace())


def _unescaped(x: str) -> str:
    for name, c in (("&quot;", '"'), ("&copy;", "©"), ("&middot;", "·")):
        x = f"replace({x}, '{name}', '{c}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def _nodes(x: str, without: list[str]) -> str:
    """The texts between tags, stripped, empty ones dropped; for markup whose hidden elements are closed and not nested."""
    x = f"regexp_replace({x}, '<!--.*?-->', chr(1), 'gs')"
    for tag in without:
        x = f"regexp_replace({x}, '<{tag}( [^>]*)?>.*?</{tag}>', chr(1), 'gs')"
    x = _unescaped(f"regexp_replace({x}, '</?[A-Za-z!][^>]*>', chr(1), 'g')")
    return f"array_to_string(list_filter(list_transform(string_split({x}, chr(1)), lambda t: trim(t, '{_SPACES}')), lambda t: t <> ''), ' ')"


oracle("strip_html", [], f"SELECT page_id, {_nodes(_unescaped('html'), ['script', 'style', 'template'])} AS text FROM pages")
_HIDDEN = ["script", "style", "noscript", "header", "footer", "nav", "aside"]
_PAGE_TEXT = f"substr(trim(regexp_replace({_nodes('html', _HIDDEN)}, '[{_SPACES}]+', ' ', 'g'), ' '), 1, 8000)"
oracle("page_main_text", [], f"""
SELECT page_id, url, {_PAGE_TEXT} AS text FROM pages""")

# --------------------------------------------------------------- prompts
from ..operators.prompts import ARTICLES_INSTRUCTIONS, COMMUNITY_INSTRUCTIONS, QUERY_INSTRUCTIONS, TOPIC_INSTRUCTIONS  # noqa: E402
from ..params import SEARCH as _SEARCH  # noqa: E402

_BEST = "score DESC NULLS LAST, comment_id NULLS LAST, md5(body)"
_PROMPT_CTES = _SEARCH_CTES + [
    ("ctexts", f"""SELECT *, list_distinct(list_transform({d_raw_tokens('body')}, lambda t: lower(t))) AS words FROM (
  SELECT query_id, body, score, comment_id, count(*) OVER (PARTITION BY query_id, body) AS n,
    row_number() OVER (PARTITION BY query_id, body ORDER BY {_BEST}) AS r
  FROM (SELECT * REPLACE (coalesce(body, '') AS body) FROM mcom)) WHERE r = 1"""),
    ("seeds", f"""SELECT query_id, rank, words FROM (
  SELECT query_id, words, row_number() OVER (PARTITION BY query_id ORDER BY {_BEST}) - 1 AS rank FROM ctexts WHERE len(words) > 0)
  WHERE rank < {_SEARCH.comment_clusters}"""),
    ("csims", """SELECT t.query_id, t.body, s.rank, len(list_intersect(t.words, s.words)) AS both_,
    len(t.words) + len(s.words) AS total FROM ctexts t JOIN seeds s ON s.query_id = t.query_id"""),
    ("cnear", """SELECT query_id, body, rank, sim FROM (
  SELECT *, row_number() OVER (PARTITION BY query_id, body ORDER BY sim DESC, rank) AS r
  FROM (SELECT *, CAST(both_ AS DOUBLE) / (total - both_) AS sim FROM csims)) WHERE r = 1 AND sim > 0"""),
    ("cgroups", f"""SELECT *, row_number() OVER (PARTITION BY query_id, cluster_id ORDER BY sim DESC, {_BEST}) AS place FROM (
  SELECT t.*, coalesce(c.rank, -1) AS cluster_id, coalesce(c.sim, 0.0) AS sim
  FROM ctexts t LEFT JOIN cnear c ON c.query_id = t.query_id AND c.body = t.body)"""),
    ("cclusters", f"""SELECT query_id, cluster_id, CAST(sum(n) AS BIGINT) AS size,
    list({{'comment_id': coalesce(comment_id, ''), 'text': body}} ORDER BY place) FILTER (WHERE place <= {_SEARCH.rep_comments}) AS rep_comments
  FROM cgroups GROUP BY query_id, cluster_id"""),
    ("pcomm", """SELECT query_id, list({'cluster_id': cluster_id, 'size': size, 'rep_comments': rep_comments} ORDER BY cluster_id) AS clusters
  FROM cclusters GROUP BY query_id"""),
    ("plisted", f"""SELECT k.query_id, t.thread_id, {d_strip("substr(t.title_and_selftext, 1, 200)")} AS title, coalesce(t.external_url, '') AS url
  FROM kept k JOIN sthreads t ON t.thread_id = k.thread_id"""),
    ("pthreads", """SELECT query_id, list({'thread_id': thread_id, 'title': title, 'url': url} ORDER BY thread_id, title, url) AS threads
  FROM plisted GROUP BY query_id"""),
    ("ppages", f"SELECT DISTINCT url, coalesce({_PAGE_TEXT}, '') AS text FROM pages WHERE url IN (SELECT url FROM plisted)"),
    ("particles", """SELECT query_id, list({'thread_id': thread_id, 'url': url, 'text': text} ORDER BY thread_id, url, text) AS articles
  FROM (SELECT l.query_id, l.thread_id, l.url, coalesce(p.text, '') AS text
        FROM (SELECT DISTINCT query_id, thread_id, url FROM plisted WHERE url <> '') l LEFT JOIN ppages p ON p.url = l.url) GROUP BY query_id"""),
]
oracle("prompt_payloads", _SEARCH_USES + ["allctx"], f"""
SELECT 'topic-' || topic_id AS key, {_q(TOPIC_INSTRUCTIONS)} || context AS prompt FROM allctx
UNION ALL
SELECT 'query-' || query_id AS key, {_q(QUERY_INSTRUCTIONS)} || context AS prompt FROM qctx
UNION ALL
SELECT 'community-' || q.query_id AS key, {_q(COMMUNITY_INSTRUCTIONS)}
  || CAST(to_json({{'query': q.query_text, 'comment_clusters': coalesce(c.clusters, [])}}) AS VARCHAR) AS prompt
FROM qcent q LEFT JOIN pcomm c ON c.query_id = q.query_id
UNION ALL
SELECT 'articles-' || q.query_id AS key, {_q(ARTICLES_INSTRUCTIONS)}
  || CAST(to_json({{'query': q.query_text, 'threads': coalesce(t.threads, []), 'articles': coalesce(a.articles, [])}}) AS VARCHAR) AS prompt
FROM qcent q LEFT JOIN pthreads t ON t.query_id = q.query_id LEFT JOIN particles a ON a.query_id = q.query_id""", _PROMPT_CTES)
