"""Text column functions (Column -> Column), all JVM-side regex/HOF expressions.

Java regex notes: ``(?U)`` makes ``\\s``, ``\\S`` and ``\\b`` Unicode-aware,
matching Python 3 ``re`` on str.  Spark's ``trim`` removes spaces only, so
``strip_ws`` is the whitespace-stripping helper used everywhere a Python
``str.strip()`` is meant.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..params import PERMALINK_PREFIX

# ---------------------------------------------------------------------------
# Fixed values (must equal the analysed application's behaviour)
# Blank markers compared case-insensitively, untrimmed:
BLANK_MARKERS = ["[deleted]", "[removed]", "nan", "none"]
# Emoji removed: U+1F600-1F64F, U+1F300-1F5FF, U+1F680-1F6FF, U+1F1E0-1F1FF,
# U+2600-2B55 and the single code points U+200D, U+23CF, U+23E9, U+231A,
# U+FE0F, U+3030 (U+1F900 and above are not covered).
EMOJI_CLASS = (r"[\x{1F600}-\x{1F64F}\x{1F300}-\x{1F5FF}\x{1F680}-\x{1F6FF}\x{1F1E0}-\x{1F1FF}"
               r"\x{2600}-\x{2B55}\x{200D}\x{23CF}\x{23E9}\x{231A}\x{FE0F}\x{3030}]+")
# URL pattern: optional https/http, '://', a non-space run ending at a word boundary.
URL_PATTERN = r"(?U)(?:https|http)?://[^\s\x1C-\x1F]+\b"
# Python whitespace (str.isspace) = Unicode White_Space plus U+001C-U+001F;
# Python line breaks (str.splitlines) = \n \r \r\n \v \f U+001C-U+001E U+0085 U+2028 U+2029.
PY_WS_CLASS = r"(?U)[\s\x1C-\x1F]"
# The same without the space.
ODD_WS_CLASS = r"(?U)[\s\x1C-\x1F&&[^ ]]"
# Quote lines: first non-blank character is '>'.
#: Line breaks besides '\n', and any break as one match.
ODD_BREAKS = "\r\x0b\x0c\x1c\x1d\x1e\x85\u2028\u2029"
ANY_BREAK = r"\r\n|[\r\x0B\f\x1C-\x1E\x85\u2028\u2029]"
# Default flair when missing.
NO_FLAIR = "[No Flair]"
# Characters Python's str.strip() removes (str.isspace()).
PY_WHITESPACE = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
                 + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")
# ---------------------------------------------------------------------------


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` (a lambda variable), so
    guards like ``when(test(v), f(v)).otherwise(v)`` do not copy ``value``."""
    return F.element_at(F.transform(F.array(value), body), 1)


def strip_ws(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing whitespace (``btrim`` over the
    ``str.isspace()`` set: linear in the trimmed ends, no regex)."""
    return F.btrim(_c(c), F.lit(PY_WHITESPACE))


def collapse_ws(c) -> Column:
    """Runs of two or more whitespace characters -> one space (a lone tab stays)."""
    return F.regexp_replace(_c(c), PY_WS_CLASS + "{2,}", " ")


def remove_urls(c) -> Column:
    """Drop URLs; a scheme-less '://x' also goes, trailing punctuation stays.

    The regex only runs on values containing '://' (a plain substring test)."""
    return _let(_c(c), lambda v: F.when(F.contains(v, F.lit("://")), F.regexp_replace(v, URL_PATTERN, "")).otherwise(v))


def remove_emojis(c) -> Column:
    """T4: drop the fixed emoji ranges.

    Every listed code point is above U+200C, so values without such a
    character skip the (costly, astral-range) replacement, and values of
    one byte a character the test for one."""
    return _let(_c(c), lambda v: F.when((F.octet_length(v) > F.length(v)) & v.rlike(r"[^\x{0}-\x{200C}]"), F.regexp_replace(v, EMOJI_CLASS, ""))
                .otherwise(v))


def remove_quotes(c) -> Column:
    """T5: drop lines whose stripped form starts with '>'; lines re-joined with '\\n'.

    Line breaks are Python ``splitlines`` breaks, first made '\\n' where a text holds any other; a single trailing
    break does not produce an empty last line.  Only texts with a '>' are split into lines.
    """
    def with_breaks(x):
        body = F.when(x.endswith("\n"), F.left(x, F.length(x) - 1)).otherwise(x)
        return _let(body, lambda v: F.when(F.contains(v, F.lit(">")), F.array_join(F.filter(
            F.split(v, "\n", -1), lambda ln: ~F.ltrim(ln, F.lit(PY_WHITESPACE)).startswith(">")), "\n")).otherwise(v))

    def odd(v):  # substring tests are far cheaper than one pass of a character class
        return reduce(lambda a, b: a | b, [F.contains(v, F.lit(x)) for x in ODD_BREAKS])

    return _let(_c(c), lambda v: _let(F.when(odd(v), F.regexp_replace(v, ANY_BREAK, "\n")).otherwise(v), with_breaks))


def blank_markers(c) -> Column:
    """T6: '[deleted]', '[removed]', 'nan', 'none' (any case, untrimmed) and null -> ''."""
    longest = max(map(len, BLANK_MARKERS))  # no longer text is lower-cased
    return _let(_c(c), lambda v: F.when(v.isNull() | ((F.octet_length(v) <= 3 * longest) & F.lower(v).isin(*BLANK_MARKERS)), F.lit("")).otherwise(v))


def flatten_newlines(c) -> Column:
    """'\\r\\n', '\\n', '\\r' -> ' ' (each)."""
    x = _c(c)
    for br in ("\r\n", "\n", "\r"):
        x = F.replace(x, F.lit(br), F.lit(" "))
    return x


def normalize_text(c, html: bool = True) -> Column:
    """Markers -> newlines -> HTML text -> URLs -> emoji -> whitespace -> strip.

    The HTML step runs the Arrow-batched parser only on rows containing '<' or
    '&' (others get null and pass through the cheap ``strip_ws`` branch).
    """
    return _let(html_text(flatten_newlines(blank_markers(c)), html), _post_html)


def _post_html(v: Column) -> Column:
    return strip_ws(collapse_ws(remove_emojis(remove_urls(strip_ws(v)))))


def html_text(x: Column, html: bool = True) -> Column:
    """T2 inside T7: the Arrow-batched parser only sees rows holding '<' or '&'."""
    if not html:
        return x
    from ..sources.html import html_text_barrier_udf
    # Python UDFs cannot sit inside a lambda, so this step is not let-bound.
    needs = F.contains(x, F.lit("<")) | F.contains(x, F.lit("&"))
    return F.coalesce(html_text_barrier_udf(F.when(needs, x)), x)


def pre_html(c) -> Column:
    """T7 steps before the HTML parse: blank markers, newlines -> spaces."""
    return flatten_newlines(blank_markers(c))


def normalize_from_pre(pre, html: bool = True, with_words: bool = False) -> Column:
    """T7 from the ``pre_html`` value (best bound to a column first, as the HTML
    test reads it several times); ``with_words`` adds T9 as struct(text, n_words)."""
    v = html_text(_c(pre), html)
    if not with_words:
        return _let(v, _post_html)
    return _let(v, lambda x: _let(_post_html(x), lambda b: F.struct(b.alias("text"), _collapsed_word_count(b).alias("n_words"))))


def _collapsed_word_count(v: Column) -> Column:
    """T9 of a stripped value without runs of whitespace: one word more than spaces, unless another whitespace is left."""
    return (F.when(v == "", F.lit(0)).when(v.rlike(ODD_WS_CLASS), word_count(v))
            .otherwise(F.length(v) - F.length(F.replace(v, F.lit(" "), F.lit(""))) + 1))


def flair_norm(c) -> Column:
    """Null -> '[No Flair]', strip, lower."""
    return F.lower(strip_ws(F.coalesce(_c(c), F.lit(NO_FLAIR))))


def has_words(c, n: int) -> Column:
    """Whether T9 is at least ``n``: the text is split no further than that."""
    if n <= 0:
        return F.lit(True)
    return _let(strip_ws(F.coalesce(_c(c), F.lit(""))), lambda v: (v != "") & (F.size(F.split(v, PY_WS_CLASS + "+", n)) >= n))


def word_count(c) -> Column:
    """Number of whitespace-separated words (Python ``len(s.split())``)."""
    words = F.split(strip_ws(F.coalesce(_c(c), F.lit(""))), PY_WS_CLASS + "+")
    return F.size(F.filter(words, lambda w: w != F.lit("")))


def title_and_selftext(title, selftext) -> Column:
    """strip(title) + '\\n\\n' + strip(selftext), nulls as ''."""
    return F.concat(strip_ws(F.coalesce(_c(title), F.lit(""))), F.lit("\n\n"),
                    strip_ws(F.coalesce(_c(selftext), F.lit(""))))


def permalink_url(c, prefix: str = PERMALINK_PREFIX) -> Column:
    p = F.coalesce(_c(c), F.lit(""))
    return F.when(p.startswith("http"), p).otherwise(F.concat(F.lit(prefix), p))


def resolve_url(df: DataFrame, order: Sequence[str] = ("external_url", "url", "permalink"),
                out: str = "thread_url", prefix: str = PERMALINK_PREFIX) -> DataFrame:
    """Column-level URL precedence: the first *existing* column in ``order``.

    A ``permalink`` gets the site prefix unless it starts with 'http'; nulls
    become ''.  With none of the columns present the URL is ''.
    """
    for name in order:
        if name in df.columns:
            if name == "permalink":
                return df.withColumn(out, permalink_url(name, prefix))
            return df.withColumn(out, F.coalesce(F.col(name), F.lit("")))
    return df.withColumn(out, F.lit(""))


def snippet(c, n: int, flatten: str = "after") -> Column:
    """``flatten='after'``: cut to n, newline -> space, strip;
    ``'before'``: newline -> space, then cut to n; ``'none'``: cut and strip."""
    c = F.coalesce(_c(c), F.lit(""))
    if flatten == "after":
        return strip_ws(F.translate(F.substring(c, 1, n), "\n", " "))
    if flatten == "before":
        return F.substring(F.translate(c, "\n", " "), 1, n)
    return strip_ws(F.substring(c, 1, n))


def short_label(c, n: int = 18) -> Column:
    """T16 chart label: longer than n -> first n characters + '...'."""
    c = _c(c)
    return F.when(F.length(c) > n, F.concat(F.substring(c, 1, n), F.lit("..."))).otherwise(c)


HEADLINE_SCHEMA = "headline STRING, summary STRING"


def extract_json(c, schema: str = HEADLINE_SCHEMA) -> Column:
    """First '{' .. last '}' (dot-all, greedy) parsed with ``schema``; none -> null."""
    raw = F.regexp_extract(_c(c), r"(?s)\{.*\}", 0)
    return F.when(raw != "", F.from_json(raw, schema))


def response_text(c) -> Column:
    """Text of a model response JSON.

    ``text`` when it is a string, else ``output`` when a string, else
    ``candidates[0].content.parts[0].text``, else the raw response.
    """
    v = F.try_parse_json(_c(c))

    def string_field(path: str) -> Column:
        node = F.try_variant_get(v, path, "variant")
        return F.when(F.schema_of_variant(node) == "STRING", F.try_variant_get(v, path, "string"))

    return F.coalesce(string_field("$.text"), string_field("$.output"),
                      F.get_json_object(_c(c), "$.candidates[0].content.parts[0].text"), _c(c))


def topic_headline(ctx, topic_id) -> Column:
    """X5 placeholder summariser: first context line[:60] stripped of '- ', then [:40]; else 'Topic <id>'."""
    first = F.substring(F.split_part(F.coalesce(_c(ctx), F.lit("")), F.lit("\n"), F.lit(1)), 1, 60)
    head = strip_ws(F.btrim(first, F.lit("- ")))
    return F.when(head != "", F.substring(head, 1, 40)).otherwise(
        F.concat(F.lit("Topic "), _c(topic_id).cast("string")))


def topic_summary_placeholder(topic_id) -> Column:
    return F.concat(F.lit("Placeholder summary for topic "), _c(topic_id).cast("string"), F.lit("."))


def query_summary(ctx) -> Column:
    """X5 placeholder for a query: the first 3 non-blank stripped lines (not the
    'USER QUERY' header) joined by ' ', cut to 200, with a fixed prefix."""
    lines = F.filter(F.split(F.coalesce(_c(ctx), F.lit("")), "\n", -1),
                     lambda ln: (strip_ws(ln) != "") & ~ln.startswith("USER QUERY"))
    text = F.substring(F.array_join(F.slice(F.transform(lines, lambda ln: strip_ws(ln)), 1, 3), " "), 1, 200)
    return F.concat(F.lit("[Placeholder summary] Based on the matched threads: "), text, F.lit("..."))
