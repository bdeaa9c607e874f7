import html
import itertools
import random
import re
import time

import duckdb

from trailweave.llm import boilerplate, mainhtml
from trailweave.llm.mainhtml import main_text, minimum_cut

SCHEMA = "page_id bigint, url string, html string, text int"


def cost(odds, ties, side):
    return sum(abs(round(1000 * o)) for o, s in zip(odds, side) if s != (o > 0) and o) + sum(round(1000 * w) for a, b, w in ties if side[a] != side[b])


def test_minimum_cut_is_least():
    r = random.Random(8)
    for _ in range(300):
        n = r.randrange(1, 9)
        odds = [r.uniform(-3, 3) for _ in range(n)]
        ties = [(a, b, r.uniform(0, 2)) for a in range(n) for b in range(a) if r.random() < 0.5]
        assert cost(odds, ties, minimum_cut(odds, ties)) == min(cost(odds, ties, s) for s in itertools.product((False, True), repeat=n))


def test_large_page_with_weak_odds():
    r = random.Random(9)
    n = 5000
    odds = [r.uniform(-1, 1) for _ in range(n)]
    side = minimum_cut(odds, [(i, i + 1, 1.2) for i in range(n - 1)])
    # On a chain the least cost is found by going along it.
    low = {False: 0, True: 0}
    for i, o in enumerate(odds):
        low = {s: min(low[s], low[not s] + (1200 if i else 0)) + (abs(round(1000 * o)) if s != (o > 0) else 0) for s in low}
    assert cost(odds, [(i, i + 1, 1.2) for i in range(n - 1)], side) == min(low.values())


def test_page_parts():
    p1, p2 = "First paragraph of the article, it goes on for a while. And more.", "Second one with a link & an odd <sign, that ends here."
    page = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var t="</p>"; if (a<b) x();</script></head>
    <body class="has-sidebar"><header><a href=/>Site name</a><p>The slogan of the site is here for all to read.</p></header>
    <NAV><ul><li><a href="/a>b">Home</a><li><a href='/b'>News</a></ul></NAV><!-- <p>no</p> -->
    <div class="cookie-notice"><p>We use cookies. By going on you agree that we store them on your device.</p><button>OK</button></div>
    <div id=wrap><article class="post"><header><h1>A  title&nbsp;here</h1></header><p>{p1}<div class="ad">Buy this great thing now. It is cheap.</div>
    <p>Second one with a <b>link</b> &amp; an odd &lt;sign, <a href="x">that</a>
    ends<br>here.<ul><li>Point one<li>Point two</ul><pre>x = 1</pre><form><label>Name</label><input value=q></form>
    <section class="comments"><h2>Comments</h2><p>Great article, I really liked to read it. Thanks a lot!</p></section></article>
    <aside><h3>Related</h3><p>Another story that you might like to read. It is long.</p></aside></div>
    <footer>&copy; 2020 Site. All rights reserved. Contact us.</footer></body></html>"""
    assert main_text(page).split("\n") == ["A title here", p1, p2, "Point one", "Point two", "x = 1"]


def test_page_without_landmarks():
    long = "This is a paragraph of some length, as articles have them, and it ends with a stop."
    page = f"<body><div><a href=a>Home</a> <a href=b>About</a> <a href=c>More</a></div><div><h2>Heading</h2><div>{long}</div><p>Short.</p><div>{long}</div></div><div>&copy; Me</div>"
    assert main_text(page).split("\n") == ["Heading", long, "Short.", long]


def test_given_pages(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    for r, got in zip(pages.orderBy("page_id").collect(), mainhtml.extract(pages).orderBy("page_id").collect()):
        inner = re.search(r"<article>(.*?)(?:</article>|$)", r.html, re.S)[1]
        want = [" ".join(html.unescape(re.sub(r"<(?:/?b|br)>", "", x)).split()) for x in re.split(r"</?(?:h1|p)>", inner)]
        assert got.text.split("\n") == [x for x in want if x] and got.n_chars == len(got.text) and got.url == r.url


def test_edge_cases(spark):
    rows = [(1, None, None, 1), (1, None, None, 1), (None, "u", "", 1), (2, "u", "just some text without any markup. Really.", 1), (3, "u", "<p" * 1000, 1), (4, "u", "<div>" * 5000 + "deep text that is long enough to be kept. Yes." + "</div>" * 5000, 1), (5, "u", "<article>" + "<p>a b c. d e f.</p>" * 30_000, 1), (6, "u", "<a href=\"x" * 500, 1), (7, "u", "&#0;&#x110000;&bogus; <article>x</article>", 1)]
    got = [tuple(r) for r in mainhtml.extract(spark.createDataFrame(rows, SCHEMA)).collect()]
    by = {r[0]: r for r in got}
    assert len(got) == len(rows) and by[1] == (1, None, "", 0) and by[None] == (None, "u", "", 0)
    assert by[2][2] == "just some text without any markup. Really." and by[4][2].startswith("deep") and by[5][2].count("\n") == 29_999
    assert mainhtml.extract(spark.createDataFrame([], SCHEMA)).collect() == []


def test_names_of_classes_are_no_verdict():
    page = """<body><article><h1>Title</h1><p>The first paragraph of it all, as long as one is.</p>
    <section class="related-work"><h2>Related work</h2><p>Others have done the same before us, in other ways and at other times.</p></section>
    <div class="side-effects"><p>It may have side effects that nobody thought of, and some that they did.</p></div>
    <p>So <math><mi>x</mi> <mo>=</mo> <mn>1</mn></math> holds, as was to be shown in this paper.</p>
    <div class="related-posts"><ul><li><a href=x>Another post</a></li><li><a href=y>One more post of it</a></li></ul></div></article></body>"""
    assert main_text(page).split("\n") == ["Title", "The first paragraph of it all, as long as one is.", "Related work", "Others have done the same before us, in other ways and at other times.", "It may have side effects that nobody thought of, and some that they did.", "So x = 1 holds, as was to be shown in this paper."]
    assert main_text("<body><p>Short.</p></body>") == "Short."


def test_pages_without_an_article_element():
    text = ["A heading for it", "The text begins here and goes on, as texts do, for a line or two.", "It says this.", "And it ends with some more words, so that it is long enough."]
    for tag, name in (("div", "post-content"), ("div", "x7"), ("main", ""), ("td", "")):
        inner = f"<h1>{text[0]}</h1>" + "".join(f"<p>{t}</p>" for t in text[1:])
        page = f"""<body><div class="top-nav"><a href=a>Home</a> <a href=b>News of the day</a></div><{tag} class="{name}">{inner}
        <div id="comments"><p>I liked it very much, thank you for writing it. More please!</p></div></{tag}>
        <div class="sidebar"><p>Our newsletter comes once a week. Do subscribe to it now.</p></div><div class="footer"><p>All rights reserved by us.</p></div></body>"""
        assert main_text(page if tag != "td" else page.replace("<td", "<table><tr><td").replace("</td>", "</td></tr></table>")).split("\n") == text, (tag, name)


def test_labels_of_whole_pages_are_least():
    r = random.Random(3)
    for _ in range(40):
        parts = [r.choice(("<p>Some text of it, here.</p>", "<li><a href=x>Link here</a>", "<div class=side-note>Short</div>", "<h2>Head</h2>", "<aside><p>One more thing. And so on.</p></aside>", "<div>word</div>")) for _ in range(r.randrange(1, 10))]
        found = mainhtml.blocks("<body>" + "".join(parts))
        odds, ties = [b.odds() for b in found], mainhtml.page_ties(found)
        got = mainhtml.labelled(found)
        assert cost(odds, ties, got) == min(cost(odds, ties, s) for s in itertools.product((False, True), repeat=len(found)))


def test_time_grows_with_the_page():
    for piece in ("<div></x>", "</div>", "<i><hr>x", "<b><td></i>", "<li><i>x", "<a href=\"", "<p><b>x</q>"):
        began = time.time()
        main_text("<body><p>x</p>" + "<i>" * 20_000 + piece * 50_000)
        assert time.time() - began < 30, piece


def test_weights_are_those_that_are_fitted():
    pages = [r[0] for r in duckdb.sql("select html from '/root/testdata/sf0.1/pages.parquet'").fetchall()]
    x, y = boilerplate.examples(pages)
    w = boilerplate.fitted(x, y)
    assert max(abs(a - b) for a, b in zip(w, mainhtml.WEIGHTS)) < 0.01
    other, truth = boilerplate.examples(pages, seed=6)
    assert (((other @ mainhtml.WEIGHTS) > 0) == (truth > 0)).mean() > 0.99
