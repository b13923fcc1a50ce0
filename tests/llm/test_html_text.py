"""Main text of pages against a plain reading of the tables' markup, and pages of other shapes."""

import html
import re
import time

import pytest
from pyspark.sql import types as T

from chronopanel.llm import html_text, queries

DATA = "/root/testdata/sf0.001"


def plain(page: str) -> str:
    """The article of the tables' pages, which know only h1, p, br and b in it."""
    inside = re.split(r"</?(?:p|br|h1)>", page.split("<article>")[1].split("</article>")[0])
    blocks = [" ".join(html.unescape(re.sub("</?b>", "", x)).split()) for x in inside]
    return " ".join(b for b in blocks if b)


def test_registered_query(spark):
    pages = {r.page_id: r for r in spark.read.parquet(f"{DATA}/pages.parquet").collect()}
    got = queries.op11_html_extraction(spark, DATA).collect()
    assert sorted(r.page_id for r in got) == sorted(pages)
    for r in got:
        want = plain(pages[r.page_id].html)
        assert (r.url, r.text, r.n_chars) == (pages[r.page_id].url, want, len(want))


ARTICLE = "<h2>A &amp; B</h2><p>One <a href='x'>two</a>\n three.<p>Four &lt;b&gt; five<br>six</p>"
TEXT = "A & B One two three. Four <b> five six"
COMMENTS = "<p>reader says %s</p>" % ("so much " * 40)


@pytest.mark.parametrize(
    "page",
    [
        f"<nav>menu</nav><article>{ARTICLE}</article><div class='comments'>{COMMENTS}</div>",
        f"<body class='has-sidebar'><header><h1>Site</h1></header><main>{ARTICLE}<aside>side</aside></main><footer>end</footer>",
        f"<div id=cookie-notice>We use cookies, accept them?</div><div class='entry-content'>{ARTICLE}<div class=ad>Buy</div></div><div class=sidebar>{COMMENTS}</div>",
        f"<article>{ARTICLE}<form><label>Name</label><input><button>Go</button></form><section id=comments><article>{COMMENTS}</article></section></article>",
        f"<article class=post>{ARTICLE}</article><article class='comment'>{COMMENTS}</article>",
        f"<div class=banner>unclosed <article>{ARTICLE}</article>",
        f"<form id=aspnet><main>{ARTICLE}</main></form>",
        f"<head><title>T</title><body><div role=main>{ARTICLE}</div><div hidden>no</div>",
        f"<script>x='<article>no</article>'</script><style>p</style><!-- <article>no</article> --><article>{ARTICLE}</article>",
        f"<article><header>{ARTICLE}</header><footer>tags</footer></article>",
        f"<header>Site</header><main><header>{ARTICLE}</header><ins class=adsbygoogle>Buy</ins></main>",
    ],
)
def test_shapes(page):
    assert html_text.main_text(page) == TEXT


def test_surge_and_dive():
    """A page that marks nothing: the menu before and the notice far after it go, the short line between stays."""
    long = "word " * 60
    page = f"<div><a>Home</a> <a>About</a></div><p>{long}<p>short<p>{long}" + "<ul>" + "<li><a>link</a>" * 6 + "</ul><div>All rights reserved</div>"
    assert html_text.main_text(page).split() == long.split() + ["short"] + long.split()
    assert html_text.between([0, 5, 90, 0, 40, 0, 0, 0, 3], 3, 86) == [(1, 5)]


@pytest.mark.parametrize(
    ("page", "text"),
    [(None, ""), ("", ""), ("  ", ""), ("only text", "only text"), ("<p", ""), ("a < b &unknown; &#0; &amp", "a < b &unknown; � &"), ("<nav>menu</nav>", ""), ("<p>a<!-- no", "a"), ("<p>a&nbsp; b</p>", "a b")],
)
def test_odd_pages(page, text):
    assert html_text.main_text(page) == text


@pytest.mark.parametrize("page", ["<div" * 100_000, '<p """' * 100_000, "<b><div>" + "<i>" * 100_000 + "</b>" * 100_000, "<li>x" * 200_000, '<p a="' * 100_001, "<!--" * 100_000, "<p>word " * 300_000])
def test_linear_in_length(page):
    began = time.time()
    html_text.main_text(page)
    assert time.time() - began < 15


def test_odd_rows(spark):
    schema = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()), T.StructField("text", T.StringType())])
    rows = [(1, "u", "<p>a</p>", "own"), (1, "u", "<p>a</p>", "own"), (None, None, None, None), (3, "v", "", "x")]
    got = html_text.extract(spark.createDataFrame(rows, schema)).collect()
    assert sorted(map(tuple, got), key=str) == sorted([(1, "u", "a", 1), (1, "u", "a", 1), (None, None, "", 0), (3, "v", "", 0)], key=str)
    assert html_text.extract(spark.createDataFrame([], schema)).count() == 0
