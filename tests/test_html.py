"""Text of broken markup: golden rows, a plain tree for random markup, planted pages in Spark."""

import random

import pytest

from agora.sources import html as hx

BROKEN = [
    # an element that is never closed ends with its parent
    ("<body><div><nav>menu</div><p>Body text</p></body>", "Body text"),
    ("<div><header>top<b>more</div>after", "after"),
    ("<nav>menu<p>inside", ""),
    # end tags that close nothing change nothing
    ("</nav>a</footer><p>b</p></aside>c", "a b c"),
    ("<footer>x</nav>y</footer>z", "z"),
    ("a</b>c <i>d</i>", "ac d"),
    ("a</p>c", "a c"),
    # crossing tags; a lower rank does not reach over a higher one
    ("<b><aside>x</b>y</aside>z", "yz"),
    ("<table><tr><td><nav>m</td><td>cell</td></tr></table>t", "cell t"),
    ("<nav><div>a</nav>b</div>c</nav>d", "d"),
    # implied ends
    ("<ul><li>one<li>two<li><nav>m</ul>three", "one two three"),
    ("<p>a<p>b<div>c</p>d</div>", "a b c d"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t d u"),
    ("<select><option>a<option>b</select>c", "a b c"),
    ("<head><title>T</title><p>x", "T x"),
    # void and self-closing elements
    ("a<br>b<br/>c<img src=x>d</br>e", "a b c de"),
    ("<nav/>text<aside/>more", "text more"),
    ("<header><br><input></header>text", "text"),
    # nested boilerplate of one name
    ("<nav>a<nav>b</nav>c</nav>d", "d"),
    ("<NAV>a</nav>B", "B"),
    ("", ""), ("plain", "plain"), ("<", "<"),
]


@pytest.mark.parametrize("page, want", BROKEN)
def test_broken_markup(page, want):
    assert " ".join(hx.html_to_text(page, hx.BOILERPLATE_TAGS, False).split()) == want


def test_random_well_formed_markup_against_a_tree():
    r = random.Random(5)
    tags = ["div", "section", "nav", "b", "aside", "footer", "span", "article", "i"]

    def node(depth):
        """(markup, visible texts)"""
        if depth == 0 or r.random() < 0.3:
            word = f"w{r.randint(0, 999)}"
            return f" {word} ", [word]
        tag = r.choice(tags)
        parts = [node(depth - 1) for _ in range(r.randint(0, 4))]
        texts = [w for _, x in parts for w in x]
        return f"<{tag}>{'<br>'.join(m for m, _ in parts)}</{tag}>", [] if tag in hx.BOILERPLATE_TAGS else texts
    for _ in range(300):
        markup, texts = node(6)
        stray = markup.replace("<br>", "</header><br></noscript>")  # end tags of what is never open
        assert hx.html_to_text(markup, hx.BOILERPLATE_TAGS, False) == " ".join(texts) == hx.html_to_text(stray, hx.BOILERPLATE_TAGS, False)


def test_deep_and_long_markup():
    assert hx.html_to_text("<div>" * 5000 + "x" + "</div>" * 5000 + "y") == "x y"
    assert hx.html_to_text("<nav>" * 3000 + "x" + "</nav>" * 2999 + "y</nav>z", hx.BOILERPLATE_TAGS, False) == "z"


def test_pages_with_cut_end_tags_keep_their_articles(spark):
    """Every page of the table with its </nav> taken away and the list in a <div>: the article's text must stay."""
    from pyspark.sql import functions as F
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    whole = F.regexp_replace("html", "</?footer>", "")
    cut = F.replace(F.replace(F.col("html"), F.lit("<nav>"), F.lit("<div><nav>")), F.lit("</nav>"), F.lit("</div>"))
    got = pages.select(hx.page_main_text("html").alias("a"), hx.page_main_text(cut).alias("b"), hx.page_main_text(whole).alias("c")).collect()
    assert got and all(x.a and x.a == x.b and x.c.startswith(x.a[:7000]) for x in got)
