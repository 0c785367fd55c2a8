"""HTML -> text (T2) and crawled-page main text.

No HTML library ships with Spark, so the parse is a small stdlib helper run in
Arrow batches (``pandas_udf``).  Callers pass null for rows that cannot hold
markup, so the Python worker only sees the rows that need parsing.

Semantics: text nodes, each stripped, empties dropped, joined by one space.
Contents of ``script``/``style``/``template`` are not text.

Broken markup is read with a stack of open elements.  An end tag closes the
nearest open element of its name with all that is open inside it, unless an
element of higher rank lies between; an end tag that closes nothing is as if it
were not there (but ``</p>`` still ends a text node).  A start tag first closes what
cannot hold it: a paragraph ends at a block, an item at the next item, a cell
at the next cell or row.  Void elements are never open.  So an element that is
never closed reaches to the end of its parent, and no further.
"""

from __future__ import annotations

import html as _html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Elements whose contents are never text, and the page
# boilerplate elements dropped before extracting a page's main text.
NON_TEXT_TAGS = frozenset(["script", "style", "template"])
BOILERPLATE_TAGS = frozenset(["script", "style", "noscript", "header", "footer", "nav", "aside"])
PAGE_TEXT_CHARS = 8000


# Elements without content; ranks over which an end tag of lower
# rank does not reach (others: 100); what a start tag closes if it is open innermost.
VOID_TAGS = frozenset(["area", "base", "basefont", "br", "col", "embed", "frame", "hr", "img", "input", "isindex", "link", "meta",
                       "param", "source", "track", "wbr"])
END_RANK = {"div": 150, "td": 160, "th": 160, "tr": 170, "thead": 180, "tbody": 180, "tfoot": 180, "table": 190,
            "head": 200, "body": 200, "html": 220}
BLOCK_TAGS = frozenset(["address", "blockquote", "body", "caption", "center", "dd", "dir", "div", "dl", "dt", "fieldset", "form",
                        "h1", "h2", "h3", "h4", "h5", "h6", "hr", "li", "menu", "ol", "p", "pre", "table", "tbody", "td", "tfoot",
                        "th", "thead", "tr", "ul"])
SECTION_TAGS = frozenset(["thead", "tbody", "tfoot"])
CLOSED_BY = {
    "p": BLOCK_TAGS,
    "li": frozenset(["li"]),
    "dt": frozenset(["dt", "dd"]),
    "dd": frozenset(["dt", "dd"]),
    "option": frozenset(["option", "optgroup"]),
    "td": SECTION_TAGS | {"td", "th", "tr"},
    "th": SECTION_TAGS | {"td", "th", "tr"},
    "tr": SECTION_TAGS | {"tr"},
    "thead": SECTION_TAGS,
    "tbody": SECTION_TAGS,
    "head": BLOCK_TAGS | {"a", "article", "aside", "footer", "header", "main", "nav", "section", "span"},
}


class _TextCollector(HTMLParser):
    def __init__(self, skip: frozenset[str]):
        super().__init__(convert_charrefs=True)
        self.skip = skip
        self.open: list[str] = []
        self.hidden = 0
        self.parts: list[str] = []
        self.held: list[str] = []

    def flush(self):
        """One text node ends: the parser may have handed it over in several pieces around a bare '<'."""
        s = "".join(self.held).strip()
        self.held = []
        if s:
            self.parts.append(s)

    def leave(self):
        self.hidden -= self.open.pop() in self.skip

    def handle_starttag(self, tag, attrs):
        self.flush()
        while self.open and tag in CLOSED_BY.get(self.open[-1], ()):
            self.leave()
        if tag not in VOID_TAGS:
            self.open.append(tag)
            self.hidden += tag in self.skip

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self.leave()

    def handle_endtag(self, tag):
        rank = END_RANK.get(tag, 100)
        for depth in range(len(self.open) - 1, -1, -1):
            if self.open[depth] == tag:
                self.flush()
                while len(self.open) > depth:
                    self.leave()
                return
            if END_RANK.get(self.open[depth], 100) > rank:
                break
        if tag == "p":
            self.flush()

    def handle_data(self, data):
        if not self.hidden:
            self.held.append(data)

    def handle_comment(self, data):
        self.flush()


def html_to_text(x: str, skip: frozenset[str] = NON_TEXT_TAGS, unescape_first: bool = True) -> str:
    p = _TextCollector(skip)
    p.feed(_html.unescape(x) if unescape_first else x)
    p.close()
    p.flush()
    return " ".join(p.parts)


def page_text(x: str | None, max_chars: int = PAGE_TEXT_CHARS) -> str:
    if not isinstance(x, str) or not x.strip():
        return ""
    try:
        text = html_to_text(x, BOILERPLATE_TAGS, unescape_first=False)
    except Exception:
        return ""
    return " ".join(text.split())[:max_chars]


@F.pandas_udf(T.StringType())
def html_text_udf(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else html_to_text(x))


# The parse is deterministic; this handle is marked otherwise only to act as an
# optimizer barrier: Catalyst then neither copies the cleaned-text projection
# into a later filter nor inlines its input into several consumers, so the
# regex chain around the parse runs once per row.
html_text_barrier_udf = html_text_udf.asNondeterministic()


@F.pandas_udf(T.StringType())
def page_text_udf(s: pd.Series) -> pd.Series:
    return s.map(page_text)


def strip_html(c) -> Column:
    """Entity-unescape first, then text of the markup; rows without '<'/'&' only strip."""
    from ..functions.text import strip_ws
    c = F.col(c) if isinstance(c, str) else c
    needs = (F.instr(c, "<") > 0) | (F.instr(c, "&") > 0)
    return F.when(c.isNull(), F.lit(None)).when(needs, html_text_udf(F.when(needs, c))).otherwise(strip_ws(c))


def page_main_text(c) -> Column:
    """Page text without boilerplate elements, whitespace collapsed, <= 8000 chars."""
    c = F.col(c) if isinstance(c, str) else c
    return page_text_udf(c)
