import random
import re

import duckdb

from quire.llm import html_text, licenses


def pages(spark, rows):
    return spark.createDataFrame([(i, u, h, 7, "x") for i, (u, h) in enumerate(rows)], "page_id long, url string, html string, text int, n_chars string")


def test_structure():
    cases = {
        "<body><div class='nav'>x</div><div>Hello <b>w</b>orld<p>A &amp;amp; B<br>c</div><div id=comments>no</div><p>end<footer>z": "Hello world A &amp; B c end",
        "<head><title>t</title><body><header>h</header><main><h1>T</h1><nav>n</nav><p>x < y &lt; z<p>two<table><tr><td>a<td>b</table></main>rest": "T x < y < z two a b",
        'plain &eacute; <!-- c --> <script>var a="</p>";</script> ok': "plain é ok",
        "<article>a<aside>b</aside><form>c</form><div class='user-comments'>d</div><style>e</style>f</article>g": "a f",
        "<article><p>a b\n\t c</p><!-- <p>x</p> --><ul><li>1<li>2</ul></article>": "a b c 1 2",
        "<div class='content has-sidebar'>a<div id='site-footer'>b</div><div class='post no_comments'>c</div></div>": "a c",
        "<article class='post'>a<article class='comment'>b</article></article><article class=comment>c</article>": "a",
        "": "", "<article></article>": "", "<p>un<i>cl</b>osed <img alt='x>y'> tail": "unclosed tail",
    }
    for page, want in cases.items():
        assert html_text.parse(page).text() == want, page


def test_templates(spark):
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(8))
    box = "<div><p>Follow our <b>site</b></p><p>Since 1999</p></div>"
    rows = [("http://a.example/1", f"<body>{box}<div><p>{word(i)}</p></div></body>") for i in range(12)]
    rows += [("http://b.example/1", f"<body>{box}<p>{word(99)}</p></body>")]
    # copies of one page are no template; neither is what articles share
    rows += [("http://c.example/1", f"<body><p>{word(7)}</p></body>")] * 30
    rows += [("http://d.example/1", f"<article><p>Common words</p><p>{word(i)}</p></article>") for i in range(12)]
    rows += [(None, None), ("", "")]
    df = pages(spark, rows)
    plain = {r.page_id: r for r in html_text.main_text(df).collect()}
    joined = {r.page_id: r for r in html_text.main_text(df, max_broadcast=-1).collect()}
    assert plain == joined
    for i, (url, _) in enumerate(rows):
        want = (
            word(i) if i < 12 else f"Follow our site Since 1999 {word(99)}" if i == 12 else word(7) if i < 43
            else f"Common words {word(i - 43)}" if i < 55 else ""
        )
        assert (plain[i].text, plain[i].n_chars, plain[i].url) == (want, len(want), url)
    assert html_text.main_text(df.where("false")).count() == 0


def test_templates_on_pages_with_articles(spark):
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    box = "<div><p>Follow our <b>site</b></p></div>"
    # a box inside the article; an article as a teaser beside the story, in a div
    rows = [("http://a.example/1", f"<article><p>{word(i)}</p>{box}</article>") for i in range(12)]
    rows += [("http://b.example/1", f"<div><article><p>Next</p></article></div><div><p>{word(i)}</p></div>{box}") for i in range(12)]
    # copies of one article on pages that differ outside it are one article
    rows += [("http://c.example/1", f"<p>{i} of 12</p><article><div>{word(7)}</div></article>") for i in range(12)]
    df = pages(spark, rows)
    plain = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    assert plain == {r.page_id: r.text for r in html_text.main_text(df, max_broadcast=-1).collect()}
    assert plain == {i: word(i) if i < 12 else f"Next {word(i - 12)}" if i < 24 else word(7) for i in range(36)}


def test_shares_of_the_pages_that_can_hold_a_template(spark):
    word = lambda k: " ".join(f"w{k}x{i}" for i in range(20))
    rows = [("http://a.example/1", f"<div>Menu</div><div><p>{word(i)}</p></div>") for i in range(6)]
    rows += [("http://a.example/1", f"<article><p>{word(i)}</p></article>") for i in range(6, 60)]
    got = {r.page_id: r.text for r in html_text.main_text(pages(spark, rows)).collect()}
    assert got == {i: word(i) for i in range(60)}
    # a section's box: 8 of 60 pages are under the share
    rows = [("http://b.example/1", f"{'<div>Section</div>' if i < 8 else ''}<div><p>{word(i)}</p></div>") for i in range(60)]
    assert html_text.site_templates(pages(spark, rows)).count() == 0
    assert html_text.site_templates(pages(spark, rows), many=8).count() == 1


def test_real_pages_against_a_plain_strip(spark):
    import html

    df = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in html_text.main_text(df).collect()}
    for r in df.collect():
        body = r.html[r.html.index("<article>") : r.html.index("</article>")]
        assert got[r.page_id] == " ".join(html.unescape(re.sub(r"<[^>]*>", " ", body)).split())


def test_quotes_names_and_open_ends():
    cases = {
        "<article><p data-x=it's>Hello</p><p>Don't stop</p></article>": "Hello Don't stop",
        "<div class='social-history'>a</div><div class='comment-policy'>b</div><div class='share-price'>c</div>": "a b c",
        "<p title=\"a>b\">x</p><p a=b'c>y</p><p a = '>'>z": "x y z",
        "x <!-- <p>q": "x", "<div>a<script>var x; </div>": "a", "a < b <c": "a < b <c", "<p>a <span class=ad>ad</span> b</p>": "a b",
        "<div class='user-comments'>d</div><div class='comments-list'>z</div><div class=ad-slot>r</div>e": "e",
    }
    for page, want in cases.items():
        assert html_text.parse(page).text() == want, page


def test_long_pages_take_time_in_proportion():
    import time

    shapes = [
        lambda n: "<b>" * n + "</i>" * n, lambda n: "<a " * n, lambda n: "<div>" * n + "<article></article>" * n,
        lambda n: "<i>" + "<b>" * n + "<div>" + "</i>" * n, lambda n: "<b>" * n + "<td>" * n, lambda n: "<a x='>" * n,
    ]
    for shape in shapes:
        began = time.perf_counter()
        html_text.parse(shape(20_000))
        assert time.perf_counter() - began < 8


def test_menus_are_counted_as_templates(spark):
    """What tags and classes name as no main text is found by the counts as well."""
    rows = [("http://a.example/1", f"<nav><ul><li>Home</ul></nav><article><p>story {i}</p></article><div class=ad>Buy</div>") for i in range(6)]
    found = {r.subtree for r in html_text.site_templates(pages(spark, rows)).collect()}
    own = [h for h, _, _, own in html_text.parse(rows[0][1]).subtrees if own]
    # nav, ul, li and the advert; the article and its paragraph can be none
    assert len(found) == 4 and found == set(own)
    # without names templates alone decide, and leave the story
    assert {r.text for r in html_text.main_text(pages(spark, rows), named=False).collect()} == {f"story {i}" for i in range(6)}


def test_templates_change_real_pages(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    with_step = {r.page_id: r.n_chars for r in html_text.main_text(df, named=False).collect()}
    without = {r.page_id: r.n_chars for r in html_text.main_text(df, named=False, min_pages=10**9).collect()}
    assert all(with_step[i] <= n for i, n in without.items()) and sum(with_step[i] < n for i, n in without.items()) > 0


def test_odd_pages(spark):
    rows = [(1, None, None), (1, None, None), (None, "http://a.example/", "<p>x"), (2, "::", ""), (3, "http://a.example/", "<p>" + "word " * 200_000)]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "page_id long, url string, html string, host string, subtree int")
    got = sorted(((r.page_id or 0), r.n_chars) for r in html_text.main_text(df).collect())
    assert got == [(0, 1), (1, 0), (1, 0), (2, 0), (3, 999_999)]


def test_licenses_against_sql(spark):
    rng = random.Random(7)
    texts = [None, "", "x", "Released under the MIT license", "RELEASED   under the MIT License!\nLicensed under CC BY-NC 4.0.", "é" * 50]
    for notice in licenses.TEMPLATES.values():
        words = notice.split()
        texts += [notice, "intro words\n" + notice + "\nafter", "Some text.\n\n" + "\n".join(" ".join(words[i : i + 6]) for i in range(0, len(words), 6)) + "\n\nmore"]
        for _ in range(6):
            w = list(words)
            for _ in range(rng.randrange(1, 5)):
                w[rng.randrange(len(w))] = rng.choice(["zz", "the", ""])
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in enumerate(texts)], "doc_id long, text string, license int, dice int")
    got = {r.doc_id: (r.license, r.dice and round(r.dice, 12), r.licenses, r.n_matches) for r in licenses.license_scan(docs).collect()}
    documents = docs.toPandas()  # noqa: F841
    want = duckdb.sql(licenses.oracle()).fetchall()
    cols = ["doc_id", "license", "dice", "licenses", "n_matches"]
    assert len(got) == len(texts) == len(want)
    for row in (dict(zip(cols, r)) for r in want):
        assert got[row["doc_id"]] == (row["license"], row["dice"] and round(row["dice"], 12), row["licenses"], row["n_matches"]), texts[row["doc_id"]]
    assert got[0] == (None, None, "", 0) and got[3][0] == "MIT"
    assert licenses.license_scan(docs.where("false")).count() == 0
