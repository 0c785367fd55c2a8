from pyspark.sql import functions as F

from agora.functions import text as tx
from agora.sources import html as hx


def one(spark, value, fn):
    df = spark.createDataFrame([(value,)], "x string")
    return df.select(fn(F.col("x")).alias("y")).first()["y"]


def test_remove_urls_keeps_trailing_punctuation(spark):
    assert one(spark, "see http://a.com/x). ok ://b c", tx.remove_urls) == "see ). ok  c"


def test_remove_quotes_keeps_entity_form(spark):
    assert one(spark, "x\n\t> q\ny &gt; z", tx.remove_quotes) == "x\ny &gt; z"
    assert one(spark, "x\n", tx.remove_quotes) == "x"
    assert one(spark, "", tx.remove_quotes) == ""


def test_remove_emojis_fixed_ranges_only(spark):
    assert one(spark, "a\U0001F600b☃c\U0001F914d", tx.remove_emojis) == "abc\U0001F914d"


def test_collapse_ws_unicode(spark):
    assert one(spark, "a  b", tx.collapse_ws) == "a b"
    assert one(spark, "a\tb", tx.collapse_ws) == "a\tb"


def test_blank_markers(spark):
    assert one(spark, "[Deleted]", tx.blank_markers) == ""
    assert one(spark, " [deleted]", tx.blank_markers) == " [deleted]"
    assert one(spark, None, tx.blank_markers) == ""


def test_strip_html_unescapes_first(spark):
    assert one(spark, "&lt;b&gt;x&lt;/b&gt; y", hx.strip_html) == "x y"
    assert one(spark, "<p>a <script>var x=1;</script>b</p>", hx.strip_html) == "a b"


def test_normalize_text(spark):
    got = one(spark, "Hello\n<b>world</b>  http://x.io/a \U0001F600 ok", tx.normalize_text)
    assert got == "Hello world ok"
    assert one(spark, "nan", tx.normalize_text) == ""


def test_word_count_and_flair(spark):
    assert one(spark, "  a  b\tc ", tx.word_count) == 3
    assert one(spark, "", tx.word_count) == 0
    assert one(spark, None, tx.flair_norm) == "[no flair]"
    assert one(spark, "\t News \n", tx.flair_norm) == "news"


def test_snippets(spark):
    assert one(spark, "ab\ncd  ", lambda c: tx.snippet(c, 4, "after")) == "ab c"
    assert one(spark, "abcdefghijklmnopqrstuvwxyz", tx.short_label) == "abcdefghijklmnopqr..."


def test_extract_json(spark):
    df = spark.createDataFrame([('pre {"headline":"H","summary":"S"} post',), ("none",)], "x string")
    rows = df.select(tx.extract_json("x").alias("j")).collect()
    assert rows[0]["j"]["headline"] == "H" and rows[0]["j"]["summary"] == "S"
    assert rows[1]["j"] is None


def test_response_text_shapes(spark):
    df = spark.createDataFrame([
        ('{"text":{"x":1},"output":"o"}',), ('{"text":"t"}',),
        ('{"candidates":[{"content":{"parts":[{"text":"c"}]}}]}',), ("not json",)], "x string")
    got = [r["y"] for r in df.select(tx.response_text("x").alias("y")).collect()]
    assert got == ["o", "t", "c", "not json"]


def test_page_main_text_drops_boilerplate():
    html = ("<html><head><style>p{}</style></head><body><nav>menu</nav><header>h</header>"
            "<article><p>Main  text</p><aside>side</aside></article><noscript>n</noscript>"
            "<footer>f</footer></body></html>")
    assert hx.page_text(html) == "Main text"
    assert hx.page_text(None) == "" and hx.page_text("  ") == ""
    assert len(hx.page_text("<p>" + "x " * 9000 + "</p>")) == 8000


def test_topic_headline_placeholder(spark):
    df = spark.createDataFrame([("- Some title here\n  comments", 3), ("", 4)], "ctx string, tid int")
    got = [r[0] for r in df.select(tx.topic_headline("ctx", "tid")).collect()]
    assert got == ["Some title here", "Topic 4"]


def test_python_whitespace_and_line_parity(spark):
    import re
    cases = ["a\x1c\x1db c", "x\r\n> q\r\ny\x1e> z\n", "  a  b\t c  ", "line1\nline2\n", "\x1f>quoted\nkeep", "",
             "a\rb\r\n", " x  y　"]
    df = spark.createDataFrame([(c,) for c in cases], "s string")
    got = df.select(tx.remove_quotes("s").alias("q"), tx.collapse_ws("s").alias("w"), tx.word_count("s").alias("n"),
                    tx.strip_ws("s").alias("t")).collect()
    for c, r in zip(cases, got):
        assert r.q == "\n".join(ln for ln in c.splitlines() if not ln.strip().startswith(">"))
        assert r.w == re.sub(r"\s{2,}", " ", c)
        assert r.n == len(c.split())
        assert r.t == c.strip()


def test_text_node_around_a_bare_less_than_stays_whole():
    from agora.sources.html import html_to_text
    assert html_to_text("I <3 you") == "I <3 you"
    assert html_to_text("a < b and <b>c</b> d<!-- x -->e") == "a < b and c d e"
    assert html_to_text("x<script>y < z</script> w") == "x w"


def test_planted_texts_change_every_text_operator(spark):
    from agora.functions import text as tx
    from agora.sources import fixtures as fx
    from pyspark.sql import functions as F
    t = fx.planted_texts(spark, "/root/testdata/sf0.001")
    n = t.count()
    for fn in (tx.collapse_ws, tx.remove_urls, tx.remove_emojis, tx.remove_quotes, tx.blank_markers, tx.normalize_text):
        assert t.where(~fn(F.col("text")).eqNullSafe(F.col("text"))).count() > 0.05 * n, fn.__name__
