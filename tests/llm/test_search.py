"""op3, op9: vectors and pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from eventloom.llm import pages, topk
from eventloom.llm.common import read
from eventloom.llm.queries import QUERIES
from tests.llm.conftest import SMALL


def _brute(ids, vectors, k=5):
    whole = [[int(np.floor(256 * float(x))) for x in v] for v in vectors]
    out = {}
    for q, v in zip(ids, whole):
        if q % 50 == 0:
            scored = [(-sum(a * b for a, b in zip(v, w)), c) for c, w in zip(ids, whole) if c != q and len(v) == len(w)]
            out[q] = [(c, -s) for s, c in sorted(scored)[:k]]
    return out


def test_op3_equals_brute_force(lab, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rows = [r for r in read(lab, SMALL, "embeddings").collect() if r.embedding is not None]
    want = _brute([r.vec_id for r in rows], [r.embedding for r in rows])
    found = {}
    for r in QUERIES["op3_topk"](lab, SMALL).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert found == want


@pytest.mark.parametrize("kind", ["ties", "huge", "one"])
def test_a_block_keeps_ties_and_large_numbers(kind):
    random = np.random.default_rng(4)
    n = 1 if kind == "one" else 300
    vectors = random.integers(-2, 3, (n, 6)) if kind == "ties" else random.integers(-9, 10, (n, 6)) * (1 << 40 if kind == "huge" else 1)
    ids, queries = np.arange(n), np.arange(0, n, 50)
    found = {}
    for q, c, s in topk.block_top(queries, vectors[queries], ids, vectors):
        found.setdefault(q, []).append((c, s))
    for q in queries.tolist():
        scored = sorted((-sum(int(a) * int(b) for a, b in zip(vectors[q], vectors[c])), c) for c in range(n) if c != q)[:5]
        assert found.get(q, []) == [(c, max(-s, -(1 << 63)) if s > 0 else min(-s, (1 << 63) - 1)) for s, c in scored]


def test_bounds_stop_most_queries_before_all_is_read(monkeypatch):
    import pandas as pd

    rows = pd.read_parquet("/root/testdata/sf0.1/embeddings.parquet").dropna()
    vectors, ids = np.floor(256 * np.stack(rows["embedding"].to_numpy()).astype(float)).astype(np.int64), rows["vec_id"].to_numpy()
    asked = ids % 50 == 0
    whole = sorted(topk.block_top(ids[asked], vectors[asked], ids, vectors))
    monkeypatch.setattr(topk, "DEPTHS", topk.DEPTHS[:-1])
    found = sorted(topk.block_top(ids[asked], vectors[asked], ids, vectors))
    assert set(found) <= set(whole) and len(found) >= 0.9 * len(whole) > 0


def test_vectors_that_take_no_part(lab):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (1, [1.0, None]), (2, [nan, 1.0]), (3, [inf, 1.0]), (4, None), (None, [9.0, 9.0]), (5, [3.0, 1.0]),
            (6, [3.0, 1.0]), (7, [1.0, 1.0, 1.0]), (50, [1.0]), (100, [])]
    df = lab.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("clash"))
    found = [tuple(r) for r in topk.nearest(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect()]
    score = 256 * 256 * 5
    assert found == [(0, 1, 5, score), (0, 2, 6, score)]
    assert topk.nearest(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_queries_are_dealt_alike_in_any_order(lab, monkeypatch):
    monkeypatch.setattr(topk, "CANDIDATES", 60)
    monkeypatch.setattr(topk, "QUERIES", 3)
    orders = []
    rows = read(lab, SMALL, "embeddings")
    for parts in (5, 3):
        found = topk.dealt(rows.repartition(parts), F.col("vec_id") % 5 == 0)
        orders.append(sorted(tuple(r) for r in found.filter("asks").select("vec_id", "part", "query_part").collect()))
        seen = found.filter("NOT asks").groupBy("vec_id").agg(F.countDistinct("part").alias("parts"), F.count("*").alias("times"))
        blocks = found.agg(F.countDistinct("query_part")).first()[0]
        assert blocks > 1 and seen.filter((F.col("parts") > 1) | (F.col("times") != blocks)).count() == 0
    assert orders[0] == orders[1]


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body class="home">
<header><h1>Site</h1></header><nav><ul><li><a href="/a">A</a></li></ul></nav><div class="cookie-notice">We use cookies, all of them.</div>
<main><article><h1>The &eacute;vent</h1><p>One   long sentence, with<br>a break and <a href="x">a link</a>; and more of it.
<p>Second paragraph, not closed <b>bold.<p>Third one. It is here, too, and goes on.</p><p>End.</p>
<div class="ad">Buy now, cheap, today!</div><aside>Related</aside><form>Name: <input name="n"></form></article>
<section id="comments"><p>First! A reader wrote this, at some length, with commas.</p></section></main>
<footer>&copy; us, all rights reserved.</footer><!-- <p>gone</p> --></body></html>"""


def test_an_article_among_everything_else():
    assert pages.main_text(PAGE) == (
        "The évent\n\nOne long sentence, with a break and a link; and more of it.\n\nSecond paragraph, not closed bold.\n\n"
        "Third one. It is here, too, and goes on.\n\nEnd."
    )


def test_link_lists_without_names_are_dropped():
    links = "".join(f"<div><a href='/{i}'>Story {i}</a></div>" for i in range(30))
    text = "".join(f"<div><p>Paragraph {i} has words, and commas, and an end.</p></div>" for i in range(4))
    assert pages.main_text(f"<body>{links}{text}</body>") == "\n\n".join(f"Paragraph {i} has words, and commas, and an end." for i in range(4))


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class='post'>{}</div>", "<main><div>{}</div></main>", "{}"])
def test_short_blocks_of_an_article_stay(wrap):
    long = " ".join(["words of a sentence that goes on for a while,"] * 10) + " end."
    items = [f"item {i} of the list without any sign at all" for i in range(8)]
    inner = (
        f"<h1>A headline of about forty characters here</h1><p class=byline>By A. Writer, today</p><p>{long}</p>"
        f"<ul>{''.join(f'<li>{x}</li>' for x in items)}</ul><blockquote>Short quote</blockquote><pre>x = 1</pre>"
        "<table><tr><th>Year</th><td>1999</td></tr></table>"
    )
    links = "".join(f"<div><a href='/{i}'>Story {i}</a></div>" for i in range(9))
    want = ["A headline of about forty characters here", "By A. Writer, today", long, *items, "Short quote", "x = 1", "Year", "1999"]
    assert pages.main_text(f"<body>{links}{wrap.format(inner)}{links}<footer>us</footer></body>") == "\n\n".join(want)


@pytest.mark.parametrize(
    "wrap",
    [
        "<div class='content has-sidebar'><article>{}</article></div>", "<div class='layout no-sidebar'><div>{}</div></div>",
        "<section id='social-history'>{}</section>", "<div class='page with-comments'><main>{}</main></div>", "<div class=widget>{}</div>",
        "<article><div class='no-sidebar'>{}</div></article>",
    ],
)
def test_a_mark_does_not_take_the_article(wrap):
    texts = ["The headline", *[f"Paragraph {i} has words, and commas, and an end." for i in range(12)]]
    inner = "<h1>The headline</h1>" + "".join(f"<p>{t}</p>" for t in texts[1:]) + "<div class='social-links'>Tell them, all of them</div>"
    ad = "<div class='ad-box'><p>Buy now, cheap, today!</p></div>"
    assert pages.main_text(f"<body>{ad}{wrap.format(inner)}{ad}</body>") == "\n\n".join(texts)


PARAGRAPHS = [f"Paragraph {i} has words, and commas, and goes on for quite a while until it comes to an end." for i in range(3)]


@pytest.mark.parametrize("wrap", ["<article>{}</article>", "<div class=post>{}</div>", "<main>{}</main>"])
def test_a_menu_beside_a_long_paragraph_is_no_article(wrap):
    inner = wrap.format("".join(f"<p>{p}</p>" for p in PARAGRAPHS))
    menu = "<div class=m><a href='/x'>Menu item</a></div>"
    assert pages.main_text(f"<body>{inner}{menu}</body>") == pages.main_text(f"<body>{menu}{inner}{menu}</body>") == "\n\n".join(PARAGRAPHS)


def test_what_lies_outside_a_named_article_is_left_out():
    inner = "".join(f"<p>{p}</p>" for p in PARAGRAPHS * 5)
    other = f"<div class=teaser><p>{PARAGRAPHS[0]}</p></div>"
    assert pages.main_text(f"<body><article>{inner}</article>{other}</body>") == "\n\n".join(PARAGRAPHS * 5)


@pytest.mark.parametrize("part", ["<p class='warning'>{}</p>", "<p><label>{}</label></p>", "<p><span class='tag social'>{}</span></p>", "<p><b class='ad'>{}</b></p>"])
def test_marks_on_parts_of_an_article_do_not_drop_them(part):
    text = "Mind the gap, all of you, and the step."
    inner = "".join(f"<p>{p}</p>" for p in PARAGRAPHS)
    assert pages.main_text(f"<article>{inner}{part.format(text)}</article>") == "\n\n".join([*PARAGRAPHS, text])
    ad = "<div class=ad><p>Buy now, cheap, today!</p></div><form><label>Your name, please.</label></form>"
    assert pages.main_text(f"<article>{inner}{ad}</article>") == "\n\n".join(PARAGRAPHS)


def test_comments_longer_than_the_article_are_left_out():
    comments = "<article class='comment'><p>A reader wrote this, at some length, with commas.</p></article>" * 9
    for wrap in ("<div class='with-comments'><article>{}</article></div>", "<article>{}</article>"):
        page = f"<body>{wrap.format('<p>The article, short as it is.</p>')}<section class='comments'>{comments}</section></body>"
        assert pages.main_text(page) == "The article, short as it is."


def test_op9_equals_the_articles(lab):
    import html
    import re

    for r in QUERIES["op9_pages"](lab, SMALL).join(read(lab, SMALL, "pages").select("page_id", "html"), "page_id").collect():
        article = re.search(r"<article>(.*?)(</article>|$)", r.html or "", re.S)
        blocks = [" ".join(html.unescape(re.sub("<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1|article)>", article[1])]
        assert r.text == "\n\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


def test_odd_pages(lab):
    long = "<p>" + "words, and more words. " * 40_000 + "</p>"
    sources = [None, "", "no tags at all", "<p>cut off <di", "a < b", "<p>a & b &lt; c", long, "<p>x</p>" * 3, "<div class='a b'", "</p></p>text"]
    df = lab.createDataFrame(list(enumerate(sources)), "page_id long, html string").withColumn("TEXT", F.lit("clash"))
    found = {r.page_id: r for r in pages.extract(df).collect()}
    assert [found[i].text for i in range(6)] == ["", "", "no tags at all", "cut off", "a < b", "a & b < c"]
    assert found[6].n_chars == len(long) - 8 and found[7].text == "x\n\nx\n\nx" and found[9].text == "text"
    assert pages.extract(df.limit(0)).count() == 0
