"""HTML extraction: the cut against brute force, markup, whole pages."""
import itertools
import random
import time

from tierflow.llm import html_extract as he


def cost(labels, odds, edges):
    return (sum(max(0, o) for o, kept in zip(odds, labels) if not kept) + sum(max(0, -o) for o, kept in zip(odds, labels) if kept)
            + sum(c for (i, j), c in edges.items() if labels[i] != labels[j]))


def test_cut_is_minimal():
    rnd = random.Random(1)
    for _ in range(300):
        n = rnd.randint(1, 9)
        odds = [rnd.choice([0.0, rnd.uniform(-3, 3)]) for _ in range(n)]
        edges = {(i, j): rnd.uniform(0, 2) for i in range(n) for j in range(i + 1, n) if rnd.random() < 0.5}
        best = min(cost(x, odds, edges) for x in itertools.product([False, True], repeat=n))
        assert abs(cost(he.minimum_cut(odds, edges), odds, edges) - best) < 1e-9


def test_smoothness_corrects_a_single_block():
    assert he.minimum_cut([2.0, -0.2, 2.0], {(0, 1): 0.3, (1, 2): 0.3}) == [True] * 3
    assert he.minimum_cut([-2.0, 0.2, -2.0], {(0, 1): 0.3, (1, 2): 0.3}) == [False] * 3


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><header id="masthead"><h1>My site</h1></header>
<nav><ul><li><a href=/>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice"><p>We use cookies to improve things here</p></div>
<div id=main><div class="post"><h2>Head &amp; shoulders</h2><p>Para one it's <b>bold</b>,   and&nbsp;more text to read here.
<div class="ad">Buy now, a long advert that reads like prose and goes on for a while.</div>
<p title="a > b">Second para with <a href=q>a link</a> inside it,<br>long enough to be content.</p><form><input> <label>Email</label></form>
<ul><li>point one of the list is here</li><li>point two</li></ul><!-- <p>gone</p> --><p>5 < 6 and 7 > 3 &copy; &#x41;</div>
<aside class=sidebar><p>Related things to read now</p></aside><section id="comments"><h3>3 comments</h3>
<div class="comment"><p>I totally agree with the author, great words here said at length to look like content</p></div></section></div>
<footer><p>Copyright 2020 Someone, all rights reserved by us</p></footer><script>var a="</p>";</script></body>"""


def test_page():
    assert he.main_text(PAGE) == ("Head & shoulders\nPara one it's bold, and more text to read here.\nSecond para with a link inside it, long enough to be content.\n"
                                  "point one of the list is here\npoint two\n5 < 6 and 7 > 3 © A")


def test_article_with_everything_around_it():
    page = """<html><body class="has-sidebar home"><div id="cookiebar">We use cookies, please accept them all to go on reading here.</div>
    <div class="topnav-wrapper"><p>Welcome to the site where you read lots of things every single day of the week.</p></div>
    <article class="post no-comments"><header><h1>The title</h1><p>By somebody</p></header><p>First paragraph of the text, long enough.</p>
    <div class="user-comments"><p>Nice article, I have read it twice and will surely read it again tomorrow.</p></div>
    <div class="ad-slot ad">Cheap things for sale, buy them today and never look back at all.</div><p><a href="/x">A linked line of the text</a></p>
    <figure><img src=x><figcaption>What one sees here</figcaption></figure><p>Last one.</p></article>
    <div id="commentlist"><ol><li>First! And a long remark about the text that nobody needs to read at all.</li></ol></div>
    <div role="complementary"><p>More stories that you may like to read after this one, chosen for you.</p></div></body></html>"""
    assert he.main_text(page) == "The title\nBy somebody\nFirst paragraph of the text, long enough.\nA linked line of the text\nWhat one sees here\nLast one."


def test_page_without_an_article():
    page = '<body><div class="sidebar"><p>Links and more links to read</p></div><div><p>Some plain text of a simple page.</p><p>And some more of it.</p></div><div class="footer">bye</div>'
    assert he.main_text(page) == "Some plain text of a simple page.\nAnd some more of it."
    assert he.main_text("just a line of text") == "just a line of text"


def test_article_of_generated_pages(spark):
    import html
    import re
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    got = {r.page_id: r for r in he.extract(pages).collect()}
    for page in pages.collect():
        inner = re.search(r"<article>(.*?)</article>", page.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]+>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner)]
        want = "\n".join(p for p in parts if p)
        assert (got[page.page_id].text, got[page.page_id].n_chars, got[page.page_id].url) == (want, len(want), page.url)


def test_odd_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", "<p>one two three four five six</p>"), (3, "u", "<div>" * 2000 + "x " * 9), (3, "u", "<a b='"), (4, "u", "<"), (5, "u", "<p>" + "long text " * 50_000)]
    df = spark.createDataFrame(rows * 2, "page_id long, url string, html string").selectExpr("*", "'clash' AS text", "1 AS n_chars")
    got = he.extract(df).collect()
    assert len(got) == 14
    by = {(r.page_id, r.url): r for r in got}
    assert by[1, "u"].text == "" and by[2, None].n_chars == 0 and by[None, "u"].text == "one two three four five six" and by[5, "u"].n_chars == 499_999
    assert he.extract(df.limit(0)).count() == 0


def test_long_pages_take_time_in_proportion():
    began = time.time()
    he.main_text("<a " + 'b="c" ' * 50_000)
    he.main_text("".join(f"<p>words {i} to read</p><div class=ad>an advert {i}</div>" for i in range(8_000)))
    assert time.time() - began < 20
