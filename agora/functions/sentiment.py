"""Lexicon sentiment (E1), buckets (E2) and their aggregates.

The lexicon is data (token -> valence).  A lexicon of checked size becomes
one map literal shipped with the plan, so scoring is a per-row JVM expression
(no shuffle, no Python).  Beyond the size bound ``with_compound`` takes
``compound_by_join``: explode + join, with the same rules.

Rules, after the published heuristics of Hutto & Gilbert (2014); numeric
parity with any particular library is not claimed:
  * tokens: runs of letters, digits and apostrophes, matched lower-cased;
  * booster words within the three preceding tokens add (or, before a
    negative word, subtract) their weight, damped by distance;
  * an ALL-CAPS sentiment word in mixed-case text gains emphasis;
  * a negator within the three preceding tokens flips and damps the valence;
  * words before the first "but" count half, words after it one and a half;
  * '!' (up to 4) and '?' (more than one) push the sum away from zero;
  * compound = s / sqrt(s^2 + 15), s = the adjusted sum.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import SENTIMENT_NEGATIVE, SENTIMENT_POSITIVE

# Normalisation constant and rule weights (Hutto & Gilbert 2014).
COMPOUND_ALPHA = 15.0
NEGATION_SCALE = -0.74
NEGATION_WINDOW = 3
BOOSTER_WEIGHT = 0.293
BOOSTER_DAMPING = [1.0, 0.95, 0.9]
CAPS_EMPHASIS = 0.733
BUT_BEFORE, BUT_AFTER = 0.5, 1.5
EXCLAMATION_WEIGHT, EXCLAMATION_MAX = 0.292, 4
QUESTION_WEIGHT, QUESTION_MAX, QUESTION_CAP = 0.18, 3, 0.96
# Negators (English, French, German, Spanish).
NEGATORS = ["not", "no", "never", "none", "nobody", "nothing", "neither", "nor", "cannot",
            "isn't", "aren't", "wasn't", "don't", "doesn't", "didn't", "won't", "can't",
            "ne", "pas", "jamais", "nicht", "kein", "keine", "nie", "nunca", "nada"]
# Booster words (+ weight) and dampeners (- weight); our own short list.
BOOSTERS = {w: BOOSTER_WEIGHT for w in [
    "absolutely", "completely", "deeply", "extremely", "highly", "hugely", "incredibly", "really",
    "so", "totally", "truly", "utterly", "very", "especially", "particularly", "remarkably", "most"]}
BOOSTERS.update({w: -BOOSTER_WEIGHT for w in [
    "almost", "barely", "hardly", "kinda", "less", "marginally", "partly", "scarcely", "slightly", "somewhat"]})
# The default lexicon (our own small general-purpose list).
DEFAULT_LEXICON = {
    "good": 1.9, "great": 3.1, "excellent": 3.2, "best": 3.2, "better": 1.9, "love": 3.2,
    "like": 1.5, "nice": 1.8, "happy": 2.7, "glad": 2.0, "helpful": 1.8, "thanks": 1.9,
    "thank": 1.5, "agree": 1.5, "fair": 1.3, "support": 1.7, "win": 2.8, "free": 1.5,
    "safe": 1.9, "amazing": 2.8, "awesome": 3.1, "wonderful": 2.7, "hope": 1.9, "fun": 2.3,
    "bad": -2.5, "worse": -2.1, "worst": -3.1, "hate": -2.7, "terrible": -2.5, "awful": -2.0,
    "sad": -2.1, "angry": -2.3, "wrong": -2.1, "problem": -1.7, "fail": -2.5, "failed": -2.3,
    "crisis": -3.1, "poor": -2.1, "stupid": -2.4, "scam": -2.3, "corrupt": -2.4, "crime": -2.5,
    "expensive": -0.9, "disaster": -3.1, "lie": -1.9, "unfair": -2.1, "broken": -1.9, "kill": -3.7,
    "bien": 1.9, "bon": 1.9, "bonne": 1.9, "mauvais": -2.5, "gut": 1.9, "schlecht": -2.5,
    "bueno": 1.9, "buena": 1.9, "malo": -2.5, "mala": -2.5,
}
MAX_MAP_LEXICON = 500_000
TOKEN_SPLIT = r"[^\p{L}\p{N}']+"
#: Words of such a lexicon stay whole where a lower-cased text is split at everything else.
PLAIN_KEY, PLAIN_SPLIT = re.compile("[a-z']+"), "[^a-z']+"


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` as a lambda variable."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _map(d: dict) -> Column:
    """A map literal from one JSON string literal (constant-folded by the optimizer)."""
    return F.from_json(F.lit(json.dumps({k: float(v) for k, v in d.items()})), "map<string,double>")


def _str_array(words) -> Column:
    return F.from_json(F.lit(json.dumps(list(words))), "array<string>")


def lexicon_map(lexicon: DataFrame | dict | None = None, with_keys: bool = False):
    """Map literal from a lexicon whose size is checked against ``MAX_MAP_LEXICON``."""
    if lexicon is None:
        lexicon = DEFAULT_LEXICON
    if isinstance(lexicon, DataFrame):
        n = lexicon.count()
        if n > MAX_MAP_LEXICON:
            raise ValueError(f"lexicon has {n} entries; use compound_by_join")
        lexicon = {r["token"]: float(r["valence"]) for r in lexicon.collect()}
    m = _map(lexicon)
    return (m, list(lexicon)) if with_keys else m


def raw_tokens(c) -> Column:
    return F.filter(F.split(F.coalesce(_c(c), F.lit("")), TOKEN_SPLIT), lambda t: t != "")


def tokens(c) -> Column:
    """Lower-cased tokens."""
    return F.transform(raw_tokens(c), lambda t: F.lower(t))


def compound_from_sum(s: Column) -> Column:
    return s / F.sqrt(s * s + F.lit(COMPOUND_ALPHA))


def _count_char(text: Column, ch: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(ch), F.lit("")))


def punctuation_emphasis(text: Column) -> Column:
    def with_q(q):
        return F.when(q > 1, F.when(q <= QUESTION_MAX, q * F.lit(QUESTION_WEIGHT)).otherwise(F.lit(QUESTION_CAP))) \
            .otherwise(F.lit(0.0))
    ex = F.least(_count_char(text, "!"), F.lit(EXCLAMATION_MAX)) * F.lit(EXCLAMATION_WEIGHT)
    return ex + _let(_count_char(text, "?"), with_q)


def _adjust(base: Column, i: Column, raw: Column, neg: Column, boost: Column, but: Column, mixed: Column) -> Column:
    """Valence of the lexicon word at 0-based position ``i`` after all word-level rules.

    Every value used more than once is let-bound, so the expression stays linear in size.
    """
    def with_base(bv):
        r = F.get(raw, i)
        caps = F.when(mixed & (r == F.upper(r)) & (r != F.lower(r)), F.signum(bv) * F.lit(CAPS_EMPHASIS)) \
            .otherwise(F.lit(0.0))
        b = F.lit(0.0)
        for k, damp in enumerate(BOOSTER_DAMPING, start=1):
            b = b + F.when(i >= k, F.coalesce(F.get(boost, i - k), F.lit(0.0)) * F.lit(damp)).otherwise(F.lit(0.0))
        negated = F.lit(False)
        for k in range(1, NEGATION_WINDOW + 1):
            negated = negated | ((i >= k) & F.coalesce(F.get(neg, i - k), F.lit(False)))
        scale = F.when(negated, F.lit(NEGATION_SCALE)).otherwise(F.lit(1.0))
        pos = but - 1  # 0-based index of the first "but", -1 when absent
        shift = F.when((but > 0) & (i < pos), F.lit(BUT_BEFORE)).when((but > 0) & (i > pos), F.lit(BUT_AFTER)) \
            .otherwise(F.lit(1.0))
        return (bv + caps + F.when(bv < 0, -b).otherwise(b)) * scale * shift

    return _let(base, with_base)


def _finish(s: Column, text: Column) -> Column:
    ep = punctuation_emphasis(text)
    return _let(s, lambda s1: _let(s1 + F.signum(s1) * ep, compound_from_sum))


def _row_arrays(raw: Column, body, low: Column | None = None):
    """Bind the per-row arrays once: lower tokens, negator flags, booster weights, 'but' position, mixed case."""
    boost_map, boost_keys = _map(BOOSTERS), list(BOOSTERS)

    def with_low(low):
        def with_neg(neg):
            def with_boost(boost):
                but = F.array_position(low, "but")
                mixed = F.exists(raw, lambda t: t != F.upper(t))
                return body(low, neg, boost, but, mixed)
            return _let(F.transform(low, lambda t: F.when(t.isin(boost_keys), F.element_at(boost_map, t))
                                    .otherwise(F.lit(0.0))), with_boost)
        return _let(F.transform(low, lambda t: t.isin(NEGATORS)), with_neg)
    if low is not None:
        return with_low(low)
    return _let(F.transform(raw, lambda t: F.lower(t)), with_low)


def sentiment_compound(c, lexicon: DataFrame | dict | None = None) -> Column:
    """Compound polarity in [-1, 1]; null text scores 0.

    Where all lexicon words are of a-z and apostrophes, the whole text is first lower-cased and split once: without
    a lexicon word in those parts no token is one, and the text scores 0.  Otherwise tokens are bound once.  A
    hash-based ``arrays_overlap`` with the lexicon keys decides whether any rule work is needed at all (most texts hold no
    sentiment word); for texts that do, each token is tested with a hash set
    (InSet) and only hits do the map lookup and the rules.
    """
    lex, keys = lexicon_map(lexicon, with_keys=True)
    key_arr = _str_array(keys)

    def with_text(text):
        def with_raw(raw):
            def body(low, neg, boost, but, mixed):
                vals = F.transform(low, lambda t, i: F.when(
                    t.isin(keys), _adjust(F.element_at(lex, t), i, raw, neg, boost, but, mixed)).otherwise(F.lit(0.0)))
                return _finish(F.aggregate(vals, F.lit(0.0), lambda a, x: a + x), text)

            return _let(F.transform(raw, lambda t: F.lower(t)), lambda low: F.when(
                F.arrays_overlap(low, key_arr), _row_arrays(raw, body, low)).otherwise(F.lit(0.0)))

        scored = _let(raw_tokens(text), with_raw)
        if not all(PLAIN_KEY.fullmatch(k) for k in keys):
            return scored
        return F.when(F.arrays_overlap(F.split(F.lower(text), PLAIN_SPLIT), key_arr), scored).otherwise(F.lit(0.0))

    return _let(F.coalesce(_c(c), F.lit("")), with_text)


def compound_by_join(df: DataFrame, id_col: str, text_col: str, lexicon: DataFrame) -> DataFrame:
    """E1 for lexicons too large for a map literal: explode, join, the hits of a text as a map from position to valence.

    Same tokens and rules; adds ``compound`` to ``df``, whose ``id_col`` is unique. Only positions and tokens are
    exploded; only lexicon hits survive the join.
    """
    words = df.select(id_col, F.posexplode(tokens(text_col)).alias("_i", "token"))
    values = lexicon.groupBy("token").agg(F.max("valence").cast("double").alias("valence"))
    hits = words.join(values, "token").groupBy(id_col).agg(
        F.map_from_entries(F.collect_list(F.struct("_i", "valence"))).alias("_hits"))

    def body(low, neg, boost, but, mixed):
        value = lambda t, i: F.element_at(F.col("_hits"), i)
        return F.aggregate(F.transform(low, lambda t, i: F.when(value(t, i).isNotNull(), _adjust(
            value(t, i), i, F.col("_raw"), neg, boost, but, mixed)).otherwise(F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)

    out = df.join(hits, id_col, "left").withColumn("_raw", raw_tokens(text_col))
    total = F.when(F.col("_hits").isNotNull(), _row_arrays(F.col("_raw"), body)).otherwise(F.lit(0.0))
    return out.withColumn("compound", _finish(total, F.coalesce(F.col(text_col), F.lit("")))).drop("_hits", "_raw")


def with_compound(df: DataFrame, text_col: str, lexicon: DataFrame | dict | None = None,
                  max_map: int = MAX_MAP_LEXICON) -> DataFrame:
    """E1 as a column ``compound``: by a map literal, or by joins where the lexicon table has over ``max_map`` rows.

    The score depends on the text alone, so the joins run over distinct texts (by SHA-256), whatever ids ``df`` has.
    """
    if not isinstance(lexicon, DataFrame) or lexicon.count() <= max_map:
        return df.withColumn("compound", sentiment_compound(text_col, lexicon))
    keyed = df.withColumn("_text", F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    texts = keyed.select("_text", F.coalesce(F.col(text_col), F.lit("")).alias("_whole")).dropDuplicates(["_text"])
    return keyed.join(compound_by_join(texts, "_text", "_whole", lexicon).select("_text", "compound"), "_text").drop("_text")


def sentiment_bucket(c) -> Column:
    """>= 0.05 positive, <= -0.05 negative, else neutral."""
    c = _c(c)
    return (F.when(c >= SENTIMENT_POSITIVE, F.lit("positive"))
            .when(c <= SENTIMENT_NEGATIVE, F.lit("negative")).otherwise(F.lit("neutral")))


def dist_aggs(compound="compound") -> list[Column]:
    """A4 as conditional aggregates (zero-filled, total counts every comment)."""
    c = _c(compound)
    return [
        F.count_if(c >= SENTIMENT_POSITIVE).alias("positive"),
        F.count_if((c > SENTIMENT_NEGATIVE) & (c < SENTIMENT_POSITIVE)).alias("neutral"),
        F.count_if(c <= SENTIMENT_NEGATIVE).alias("negative"),
        F.count(F.lit(1)).alias("total_comments"),
    ]


def avg_agg(compound="compound") -> Column:
    """Mean compound, 0.0 without comments, 3 decimals."""
    return F.round(F.coalesce(F.avg(_c(compound)), F.lit(0.0)), 3).alias("sentiment_avg")
