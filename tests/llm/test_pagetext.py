"""Main text of pages: the given pages against a plain reading of their one template, and pages of other makes."""

import html as H
import re

import pytest
from pyspark.sql import functions as F

from weftline.llm import pagetext as P
from weftline.llm import queries as Q

D = "/root/testdata/sf0.01"
STORY = ["The storm", "It came at night, and nobody in the village had seen its like before.", "By morning, the bridge was gone; the mill, too.", "Nobody was hurt. That, said the mayor, was luck."]
ADS = "Buy two, get three! Only today, only here, only for you, dear reader: our best offer of the year, the month and the day."


def plain(page):
    inner = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    parts = (" ".join(H.unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", inner))
    return "\n".join(x for x in parts if x)


def test_whole_table(spark):
    got = Q.op13_html_extraction(spark, D)
    assert got.columns == ["page_id", "url", "text", "n_chars"]
    rows = got.collect()
    pages = spark.read.parquet(f"{D}/pages.parquet").collect()
    assert sorted((r.page_id, r.url, r.text, r.n_chars) for r in rows) == sorted((r.page_id, r.url, plain(r.html), len(plain(r.html))) for r in pages)


def body(kind):
    h, *ps = STORY
    inner = f"<h1>{h}</h1>" + "".join(f"<p>{p}</p>" for p in ps)
    return {
        "article": f"<article>{inner}</article>",
        "main": f"<main>{inner}</main>",
        "role": f'<div role="main">{inner}</div>',
        "div": f'<div class="content">{inner}</div>',
        "id": f'<div id="post-body"><h1>{h}</h1><div class="txt">' + "".join(f"<p>{p}" for p in ps) + "</div></div>",
        "section": f"<main><article><section><h1>{h}</h1><p>{ps[0]}</p></section><section>" + "".join(f"<p>{p}</p>" for p in ps[1:]) + "</section></article></main>",
        "header": f"<article><header><h1>{h}</h1><div>By A. Writer, 3 May</div></header>" + "".join(f"<p>{p}</p>" for p in ps) + "</article>",
        "table": f"<table><tr><td><div class='content'>{inner}</div></td></tr></table>",
    }[kind]


@pytest.mark.parametrize("kind", ["article", "main", "role", "div", "id", "section", "header", "table"])
def test_other_makes_of_pages(kind):
    page = f"""<!doctype html><html><head><title>A, b. c</title><style>p > a {{ x }}</style><script>if (a<b) document.write("<p>No, no.</p>")</script></head>
<body class="sidebar-left"><header><h2>The Daily, since 1901.</h2><p>News, weather, sports.</p></header>
<nav><ul><li><a href=/a>Home</a><li><a href=/b>News</a></ul></nav><div class="cookie-notice"><p>{ADS}</p></div>
<div id=wrap class="has-sidebar">{body(kind)}
<aside><p>{ADS}</p></aside><div class="sidebar"><h3>Most read</h3><ul><li><a href=1>One, two. Three</a><li><a href=2>Four</a></ul></div></div>
<div class="ad-slot"><p>{ADS}</p></div><form><p>Name, please.</p><input name=a><textarea>x</textarea><button>Go</button></form>
<section id="comments"><h2>Comments</h2><article class="comment"><p>First! I was there, and it was worse, far worse, than they say.</p></article></section>
<footer><p>(c) The Daily, 2024. All rights reserved, everywhere.</p></footer><noscript>Turn it on, please.</noscript></body></html>"""
    assert P.main_text(page) == "\n".join(STORY)


def test_all_kinds_of_blocks_in_an_article_stay():
    page = """<article><h1>T</h1><p>One <b>bold</b><i>er</i> <a href=x>link</a>,&nbsp;two.<br>three</p><ul><li>item</li><li>other <ul><li>inner</ul></ul>
<blockquote>Said.</blockquote><table><tr><td>a</td><td>b<tr><td>c</table><figure><img src=x alt="no"><figcaption>Seen</figcaption></figure><pre>x  =
 1</pre><div class="related"><p>More, and more.</p></div><p>End</article>"""
    assert P.main_text(page) == "T\nOne bolder link, two. three\nitem\nother\ninner\nSaid.\na\nb\nc\nSeen\nx = 1\nEnd"


@pytest.mark.parametrize(
    "page, want",
    [
        (None, ""), ("", ""), ("  \n ", ""), ("just text &amp; more &lt;b&gt; &#x41;&#66; &eacute; &amp;amp;", "just text & more <b> AB é &amp;"), ("<p>a<p>b", "a\nb"), ("<p>x < y and z", "x < y and z"),
        ("<nav><a href=1>x</a></nav>", ""), ("<article></article>", ""), ("<article><p>Be.</p></article><div class=ad>" + ADS + "</div>", "Be."), ("<article>a<!-- <p>no</p> -->b</article>", "ab"),
        ("<article><p>a</p><script>var x='</p><p>no'", "a"), ("<ARTICLE><P CLASS=\"x>y\">a</P></ARTICLE>", "a"), ("<article><p><b>one<p>two</b> three</article>", "one\ntwo three"),
        ("<div class=comments><p>All that there is, here.</p></div>", "All that there is, here."), ("<article><p>" + "word " * 200000 + "</p></article>", ("word " * 200000).strip()),
    ],
)
def test_edges(page, want):
    assert P.main_text(page) == want


def test_columns_stay(spark):
    df = spark.createDataFrame([(1, "<p>a</p>", "t", 7), (1, "<p>a</p>", "t", 7), (None, None, None, None)], "page_id long, html string, text string, k0 int").select("*", F.lit(2).alias("a.b"))
    got = P.extract(df)
    assert got.columns == ["page_id", "_text", "k0", "a.b", "text", "n_chars"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(1, "t", 7, 2, "a", 1), (1, "t", 7, 2, "a", 1), (None, None, None, 2, "", 0)], key=repr)
    assert P.extract(df.where("false")).count() == 0
