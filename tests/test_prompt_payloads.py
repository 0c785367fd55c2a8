"""All four payloads are made; groups of comments equal a plain version."""

import json
import re
from collections import Counter, defaultdict
from datetime import datetime, timedelta

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as E
from agora.operators import prompts as pr
from agora.operators import search as sr


def plain_clusters(rows, k, k_reps):
    """{cluster_id: (size, rep_comments)} of rows (comment_id, score, text) of one query."""
    order = lambda r: (r[1] is None, -(r[1] or 0), r[0] is None, r[0] or "")
    words = lambda t: frozenset(w.lower() for w in re.split(r"[^\w']+|_", t) if w)
    size, best = Counter(), {}
    for r in sorted(((c, s, t or "") for c, s, t in rows), key=order):
        size[r[2]] += 1
        best.setdefault(r[2], r)
    texts = sorted(best.values(), key=order)
    seeds = [words(r[2]) for r in texts if words(r[2])][:k]
    groups = defaultdict(list)
    for r in texts:
        sims = [len(words(r[2]) & s) / len(words(r[2]) | s) for s in seeds]
        top = max(sims, default=0.0)
        groups[sims.index(top) if top else -1].append((-top, order(r), r))
    return {c: (sum(size[r[2]] for *_, r in g), [(r[0] or "", r[2]) for *_, r in sorted(g)[:k_reps]]) for c, g in groups.items()}


@pytest.mark.parametrize("bound", [None, 0])
def test_comment_clusters_equal_a_plain_version(spark, monkeypatch, bound):
    if bound is not None:  # beyond the bound of a broadcast
        monkeypatch.setattr("agora.session.MAX_BROADCAST_ROWS", bound)
        monkeypatch.setattr(sr, "MAX_SEED_QUERIES", bound)
    texts = ["rent is up", "Rent is UP again", "trains are late", "trains and rent", "nothing shared here", "...", "", None, "é è ß", "late late late trains",
             "it's only words " * 40, "why is rent up", "buses"]
    rows = [(f"c{i:03d}", "ab"[i % 2], None if i % 7 == 0 else i * 5 % 11 - 3, texts[i * i % len(texts)]) for i in range(60)]
    rows += [(None, "a", 9, "no id of its own"), (None, "a", 9, "no id of its own"), ("c004", "a", 4, "buses"), ("c004", "a", 4, "buses"),
             ("x", "gone", 99, "not matched"), ("y", None, 99, "no thread"), ("z1", "blank", 1, ""), ("z2", "blank", None, None)]
    comments = spark.createDataFrame(rows, "comment_id string, thread_id string, score int, body string")
    pairs = [("q1", "a"), ("q1", "b"), ("q2", "b"), ("q3", "blank"), ("q4", "unknown")]
    matched = spark.createDataFrame([(*p, 0.5) for p in pairs], "query_id string, thread_id string, score double")
    for k, reps in ((6, 5), (2, 1)):
        got = defaultdict(dict)
        for r in sr.comment_clusters(matched, comments, k, reps).collect():
            got[r.query_id][r.cluster_id] = (r["size"], [tuple(c) for c in r.rep_comments])
        want = {q: plain_clusters([(c, s, b) for c, t, s, b in rows if (q, t) in pairs], k, reps) for q, _ in pairs}
        assert dict(got) == {q: g for q, g in want.items() if g}


def test_articles_are_pages_of_listed_urls(spark):
    listed = spark.createDataFrame([("q", "t1", "x", "http://x"), ("q", "t2", "y", "http://gone"), ("q", "t3", "z", ""), ("q", "t1", "x", "http://x")],
                                   "query_id string, thread_id string, title string, url string")
    pages = spark.createDataFrame([("http://x", "<nav>menu</nav><p>A  text</p>")] * 2 + [("http://other", "<p>no</p>"), (None, "<p>no</p>")], "url string, html string")
    got = sorted(tuple(r) for r in sr.linked_articles(listed, pages).collect())
    assert got == [("q", "t1", "http://x", "A text"), ("q", "t2", "http://gone", "")]


def test_every_query_has_all_its_payloads(spark, tmp_path):
    n = 14
    docs = [f"title {i}\nbody of {'rent' if i % 2 else 'trains'} number {i}" for i in range(n)]
    write = lambda name, **cols: pq.write_table(pa.table(cols), tmp_path / f"{name}.parquet")
    write("documents", doc_id=list(range(n)), text=docs, lang=["en"] * n, source=["s"] * n, n_chars=[len(d) for d in docs])
    write("pages", page_id=list(range(6)), url=[f"http://p/{i}" for i in range(6)], html=[f"<header>top</header><p>page {i}</p>" for i in range(6)])
    day = datetime(2024, 1, 30)
    write("events", event_id=list(range(90)), ts=pa.array([day - timedelta(hours=i) for i in range(90)], pa.timestamp("us")),
          user_id=[i * 5 % n for i in range(90)], event_type=["e"] * 90, value=[float(i % 60) for i in range(90)], props=["{}"] * 90)
    ids = [i for i in range(n) if i != 3]  # thread 3 is known by another id
    write("embeddings", vec_id=ids, label=pa.array([1 + i % 2 for i in ids], pa.int32()),
          embedding=pa.array([[1.0 if j == 10 + i else 0.01 for j in range(64)] for i in ids], pa.list_(pa.float32())))
    got = {r.key: r.prompt for r in E.queries()["prompt_payloads"](spark, str(tmp_path)).collect()}
    kinds = Counter(k.split("-")[0] for k in got)
    assert {k: kinds[k] for k in ("query", "community", "articles")} == {"query": 2, "community": 2, "articles": 2} and kinds["topic"]
    matched = 0
    for q in ("label-1", "label-2"):
        links = json.loads(got[f"articles-{q}"][len(pr.ARTICLES_INSTRUCTIONS):])
        assert links["query"] == q and links["threads"]
        ids = [t["thread_id"] for t in links["threads"]]
        assert links["articles"] == [{"thread_id": t, "url": f"http://p/{t}", "text": f"page {t}"} for t in ids if int(t) < 6]
        matched += len(links["articles"])
        talk = json.loads(got[f"community-{q}"][len(pr.COMMUNITY_INSTRUCTIONS):])["comment_clusters"]
        rows = [(str(e), None if e % 53 == 0 else e % 60 - 30, docs[e % n]) for e in range(90) if str(e * 5 % n) in ids]
        want = plain_clusters(rows, 6, 5)
        assert rows and {c["cluster_id"]: (c["size"], [(r["comment_id"], r["text"]) for r in c["rep_comments"]]) for c in talk} == want
    assert matched
