from __future__ import annotations

import html as H
import re
import time

import pytest

from tickbars.llm import style_tree as T
from tickbars.llm.queries import op1_style_tree

SF = "/root/testdata/sf0.01"


def article_of(page):
    """The blocks of the given table's pages, which all have one article of headings and paragraphs."""
    inner = re.search(r"<article>(.*)</article>", page, re.S)[1]
    parts = re.split(r"</?(?:h1|p)>", inner)
    plain = [" ".join(H.unescape(re.sub(r"<[^>]*>", " " if "br" in p else "", p)).split()) for p in parts]
    return "\n".join(p for p in plain if p)


def test_query_over_all_pages(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = op1_style_tree(spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    assert sorted(r.page_id for r in rows) == sorted(pages)
    for r in rows:
        assert r.text == article_of(pages[r.page_id].html)
        assert r.url == pages[r.page_id].url and r.n_chars == len(r.text)


def texts(page):
    """-1 for what a name rules out, 1 for what is inside `article` or `main`, else 0."""
    return [(-1 if b.weight < 1 else int(b.main), b.text) for b in T.parse(page)[0]]


@pytest.mark.parametrize(
    "page, want",
    [
        ("", []),
        ("plain &amp; simple", [(0, "plain & simple")]),
        ("<p>a <b>b</b>c<br>d&nbsp;e", [(0, "a bc d e")]),
        ("<p><b>one<br><p>two</p>", [(0, "one"), (0, "two")]),
        ("<ul><li>a<li>b</ul>c", [(0, "a"), (0, "b"), (0, "c")]),
        ("<nav>x</nav><div class='ad big'>y</div>z", [(-1, "x"), (-1, "y"), (0, "z")]),
        ("<header>h</header><article><header>t</header>u<div id=comments>v</div></article>", [(-1, "h"), (1, "t"), (1, "u"), (-1, "v")]),
        ("<script>if (a<b) '</p>'</script >x<style>p{}</style>y", [(0, "xy")]),
        ("<script>never closed <p>x", []),
        ("<!-- a <p> -->b<!-- open", [(0, "b")]),
        ("1 < 2 &lt;b&gt; <a title='>'>c</a>", [(0, "1 < 2 <b> c")]),
        ("<table><tr><td>a<td>b<tr><td>c</table>", [(0, "a"), (0, "b"), (0, "c")]),
        ("a<span class=ad>x<span>y</span>z</span>b", [(0, "ab")]),
        ("<body class='has-sidebar'><main>a</main></body>", [(1, "a")]),
        ("<article><p>a <button>like <i>it</i></button>b</p></article>", [(1, "a b")]),
        ("<p>a<button><div>x</div>y</button>b</p>", [(0, "ab")]),
        ("<p>a<button>x<div>y</div></button>b</p>", [(0, "ab")]),
        ("<head><title>t</title></head><body>b", [(0, "b")]),
        ("<p hidden>a</p><p style='display: none'>b</p><p>c", [(0, "c")]),
        ("<div class='site-footer'>f</div><div id=cookie-notice>c</div><div class='main no-sidebar'>body text</div>", [(-1, "f"), (-1, "c"), (0, "body text")]),
        # Whole classes only, and nothing that holds the article.
        ("<div class='content no-sidebar'><p>a</p></div>", [(0, "a")]),
        ("<div class='page-with-sidebar'><article>a</article></div>", [(1, "a")]),
        ("<div class='sidebar'><article>a</article><nav>n</nav></div>", [(1, "a"), (-1, "n")]),
        ("<article><p class='related-work'>a</p><p class='copyright-law'>b</p><p class='social-science'>c</p></article>", [(1, "a"), (1, "b"), (1, "c")]),
        ("<form><nav>x</nav><div><p>the whole page in a form</p></div></form>", [(-1, "x"), (0, "the whole page in a form")]),
        ("<form><label>search</label></form><p>the page has a form in it</p>", [(-1, "search"), (0, "the page has a form in it")]),
        ("<aside><article>teaser</article></aside><main>text</main>", [(-1, "teaser"), (1, "text")]),
        ("<article>a<div class='comments'><article>c</article></div></article>", [(1, "a"), (-1, "c")]),
        ("<div>a<p>b</div>c</p>d", [(0, "a"), (0, "b"), (0, "cd")]),
        ("<p>broken <a href=\"x>y</p>", [(0, "broken y")]),
    ],
)
def test_parsing(page, want):
    assert texts(page) == want


def test_very_long_pages_take_linear_time():
    for page in ("<p>x " * 60_000, "<" * 400_000, "a" * 2_000_000, "<!--" * 100_000, "&amp;" * 200_000, "<a b='" * 20_000):
        T.parse(page)
    for unit, end in (("<h1>x", ""), ("<div>", "</table>"), ("<nav>x", ""), ("<li>x<ul>", "</p>"), ("<span hidden>x", "</i>"), ("<td>a<p>", "</div>")):
        n = 1_000_000 // len(unit + end)
        began = time.perf_counter()
        T.parse(unit * n + end * n)
        assert time.perf_counter() - began < 8


def site(n, host="h.example"):
    shared = "<div class='top'>Welcome to our site</div><div class='legal'>All rights belong to us</div>"
    return [(f"http://{host}/{i}", f"<body>{shared}<div class='body'><p>story number {i} of {host}</p></div></body>") for i in range(n)]


SCHEMA = "low string, page_id bigint, url string, html string, text int, host string"


def rows_of(pairs):
    return [("l", i, u, h, 0, "x") for i, (u, h) in enumerate(pairs)]


def test_what_all_pages_of_a_host_share_goes(spark):
    rows = rows_of(site(12) + site(2, "small.example") + [("nowhere", site(1)[0][1])])
    got = {r.page_id: r.text for r in T.page_report(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert all(got[i] == f"story number {i} of h.example" for i in range(12))
    assert got[12].startswith("Welcome") and got[14].startswith("Welcome")


def test_copies_of_a_page_do_not_lose_their_text(spark):
    page = "<body><div>the one text</div></body>"
    rows = rows_of([("http://h/1", page)] * 20 + site(6, "h"))
    got = T.page_report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {r.text for r in got if r.page_id < 20} == {"the one text"}


def test_importance_follows_the_formula(spark):
    rows = spark.createDataFrame(site(8), "url string, html string").withColumn("host", T.host_of("url"))
    nodes = T.importance(rows).collect()
    assert {round(r.by_content, 9) for r in nodes} == {round(T.entropy_importance([8], 8), 9), round(T.entropy_importance([1] * 8, 8), 9)}
    assert {round(r.importance, 9) for r in nodes} == {round(2 / 10, 9), 1.0}


def test_shared_paragraphs_stay_with_what_differs(spark):
    shop = "<body><div class='top'>The shop of shops</div><div class='item'><h1>Model {}</h1><p>Free delivery.</p><p>Two years.</p></div></body>"
    pages = [(f"http://shop/{i}", shop.format(i)) for i in range(20)]
    bare = [(f"http://bare/{i}", f"<body class='main no-sidebar'><p>text {i}</p><p>and more</p></body>") for i in range(6)]
    form = [(f"http://form/{i}", f"<body><form><div class='menu'>menu</div><div class='b'><p>text {i} of a page</p></div></form></body>") for i in range(12)]
    got = {r.page_id: r.text for r in T.page_report(spark.createDataFrame(rows_of(pages + bare + form), SCHEMA)).collect()}
    assert [got[i] for i in range(20)] == [f"Model {i}\nFree delivery.\nTwo years." for i in range(20)]
    assert [got[20 + i] for i in range(6)] == [f"text {i}\nand more" for i in range(6)]
    assert [got[26 + i] for i in range(12)] == [f"text {i} of a page" for i in range(12)]


def test_few_pages_say_less_than_many(spark):
    for n, goes in ((2, False), (3, False), (4, True), (40, True)):
        got = T.page_report(spark.createDataFrame(rows_of(site(n)), SCHEMA)).collect()
        assert all(r.text.startswith("Welcome") != goes for r in got)


def test_odd_rows(spark):
    rows = [("l", 1, None, None, 0, "x"), ("l", 2, "http://a/", "", 0, "x"), ("l", None, "http://A:80/", "<p>q", 0, None)]
    rows += [("l", 3, "http://u@a/", "<p>" + "w " * 100_000, 0, "x")] * 2
    df = spark.createDataFrame(rows, SCHEMA)
    got = sorted((r.page_id or 0, r.n_chars) for r in T.page_report(df).collect())
    assert got == [(0, 1), (1, 0), (2, 0), (3, 199_999), (3, 199_999)]
    assert T.page_report(df.where("false")).count() == 0


@pytest.mark.parametrize("tag", ["main", "article"])
def test_what_all_pages_share_inside_the_main_element_goes(spark, tag):
    shared = "<div class='top'>Welcome to our site</div><ul><li>One link</li><li>Another link</li></ul><div class='legal'>All rights</div>"
    story = "<p>story number {}</p><p>A sentence of many articles</p><p>part two of {}</p>"
    pages = [(f"http://h/{i}", f"<body><{tag}>{shared}{story.format(i, i)}</{tag}></body>") for i in range(12)]
    same = [(f"http://same/{i}", f"<body><nav>{i}</nav><{tag}><p>the one text</p></{tag}></body>") for i in range(6)]
    few = [(f"http://few/{i}", pages[i][1]) for i in range(2)]
    got = {r.page_id: r.text for r in T.page_report(spark.createDataFrame(rows_of(pages + same + few), SCHEMA)).collect()}
    assert all(got[i] == f"story number {i}\nA sentence of many articles\npart two of {i}" for i in range(12))
    assert {got[i] for i in range(12, 18)} == {"the one text"}
    assert got[18].startswith("Welcome")
