import html
import random
import re

import pytest
from lifeline.llm import html_extraction as extraction
from lifeline.llm import queries

SF = "/root/testdata/sf0.001"
FIRST = "The river ran past the old mill, and the children watched it turn."
SECOND = "In autumn the water was high & the wheel never stopped, day or night."
LAST = "Then it stopped."
WANT = f"The mill\n\n{FIRST}\n\n{SECOND}\n\n{LAST}"
BODY = f"<h1>The mill</h1><p>{FIRST}</p><p>{html.escape(SECOND)}</p><p>{LAST}</p>"
MENU = '<ul><li><a href="/">Home</a></li><li><a href="/a">About us</a></li><li><a href="/c">Contact</a></li></ul>'
AD = '<div class="ad-slot"><p>Buy the best shoes of this season now, with free delivery.</p></div>'
COMMENTS = '<div id="comments"><h3>Comments</h3><article class="comment"><p>I liked this story very much, thank you.</p></article></div>'
FORM = '<form action="/s"><label>Your mail</label><input name="q"><button>Send it to me</button></form>'

PAGES = {
    "marked": f"<html><head><title>T</title></head><body><nav>{MENU}</nav><article>{BODY}</article><footer>&copy; us</footer></body></html>",
    "advert inside": f"<body><header><p>The daily paper of the valley</p></header><article>{BODY.replace(f'<p>{LAST}', AD + f'<p>{LAST}')}</article>{COMMENTS}</body>",
    "main": f"<body><nav>{MENU}</nav><main>{BODY}</main><aside><p>More about mills and rivers of the land.</p></aside></body>",
    "plain divisions": f"<body><div>{MENU}</div><div><div>{BODY}</div></div><div class='footer'><p>All about the paper and how to write to us.</p></div></body>",
    "no mark, comments after": f"<body><div id=top-menu>{MENU}</div><div class=story>{BODY}</div>{COMMENTS}<div>&copy; 2024 The paper. All rights reserved.</div></body>",
    "table": f"<table><tr><td>{MENU}</td><td>{BODY}</td></tr></table>",
    "related": f"<body><div>{BODY}</div><h3>Related stories</h3>{MENU}</body>",
    "form inside": f"<article>{BODY.replace('</h1>', '</h1>' + FORM)}</article>",
    "open tags": f"<BODY><NAV>{MENU}</NAV><ARTICLE><H1>The mill</H1><P>{FIRST}<P>{html.escape(SECOND)}<P>{LAST}</ARTICLE>",
    "notices": f'<body><div class="cookieNotice" role="dialog"><p>We use cookies to make this page better for you.</p></div><article>{BODY}</article></body>',
    "hidden": f'<article>{BODY}<p hidden>Nothing to see here.</p><p style="display: none">Nor here.</p></article>',
    "inline": f"<article>{BODY.replace('river', '<b>ri</b>ver').replace('old mill', 'old<br>mill').replace('children', '  <i>children</i>' + chr(10))}</article>",
    "raw": f"<script>if (a < b) document.write('<p>not this</p>');</script><style>p > b {{}}</style><!-- <p>nor this</p> --><article>{BODY}</article>",
    "telling names": f'<body><div class="layout has-sidebar"><div class="ad-free page">{BODY}</div><div class="sidebar"><p>Other tales of this land.</p></div></div></body>',
    "misleading name": f'<body><div id="widget"><article>{BODY}</article></div></body>',
    "odd attributes": f"<div title='a > b' data-x=\"it's\"><article data-n=1>{BODY}</article></div>",
}


@pytest.fixture(scope="module")
def scores(spark):
    return extraction.weights(spark.read.parquet(f"{SF}/pages.parquet"))


@pytest.mark.parametrize("name", PAGES)
def test_pages(scores, name):
    assert extraction.content(PAGES[name], scores) == WANT


def test_unlabelled_scores(spark):
    """Without any labelled page the stated counts alone find the content."""
    none = spark.createDataFrame([(None,), ("<p>x</p>",), ("<article",)], "html string")
    plain = extraction.weights(none)
    assert {n: extraction.content(p, plain) for n, p in PAGES.items()} == dict.fromkeys(PAGES, WANT)


def article(page):
    """The generated pages' article, by their own simple structure."""
    parts = re.split(r"</?(?:p|h1)>", re.search("<article>(.*?)</article>", page, re.S)[1])
    parts = [" ".join(html.unescape(re.sub("</?b>", "", x.replace("<br>", " "))).split()) for x in parts]
    return "\n\n".join(x for x in parts if x)


def test_query_on_the_smallest_table(spark):
    want = sorted((r.page_id, r.url, article(r.html), len(article(r.html))) for r in spark.read.parquet(f"{SF}/pages.parquet").collect())
    got = queries.op11_html_extraction(spark, SF)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    assert sorted(tuple(r) for r in got.collect()) == want


def test_same_pages_without_the_mark(spark, scores):
    for r in spark.read.parquet(f"{SF}/pages.parquet").collect():
        hidden = re.sub("(</?)article>", r"\1div>", r.html)
        assert extraction.content(hidden, scores) == article(r.html)


def test_region_is_the_best(spark):
    chance = random.Random(1)
    for _ in range(300):
        x = [chance.randint(-4, 4) for _ in range(chance.randint(0, 12))]
        a, b = extraction.best_region(x)
        sums = [(sum(x[i:j]), -i) for i in range(len(x)) for j in range(i + 1, len(x) + 1)]
        assert sum(x[a:b]) == max([0, *(s for s, _ in sums)])


def test_edge_rows(spark, scores):
    rows = [(1, None, "a"), (2, "", "b"), (3, "<nav>x</nav>", "c"), (4, "just words", "d"), (4, "just words", "d"),
            (None, "<p>é &amp; &#x1F600; &nbsp; &am &lt;b&gt;</p>", "e"), (6, "<p>" + "word " * 300_000, "f"), (7, "< 5 > 3 <", "g")]
    pages = spark.createDataFrame(rows, "id long, html string, TEXT string")
    got = {(r.id, r.n_chars): r.text for r in extraction.extract(pages, scores).collect()}
    assert extraction.extract(pages, scores).columns == ["id", "text", "n_chars"]
    assert got == {(1, 0): "", (2, 0): "", (3, 0): "", (4, 10): "just words", (None, 13): "é & 😀 &am <b>",
                   (6, 1_499_999): ("word " * 300_000).strip(), (7, 9): "< 5 > 3 <"}
    assert extraction.extract(pages.limit(0)).count() == 0
    assert extraction.extract(pages.select("html"), scores).columns == ["text", "n_chars"]
