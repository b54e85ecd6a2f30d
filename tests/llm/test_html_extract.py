import html as H
import re
import time

import pytest

from tidemark.llm import queries as Q
from tidemark.llm.html_extract import content, extract

HEAD = "<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var a='</p><p>no</p>';</script></head><body>"
LONG = ["A first paragraph that has words, marks, and more than one clause; it goes on for a while.", "A second one, which is long enough too: it has several marks, and it says &quot;so&quot;.", "Short."]
PROSE = "".join(f"<p>{x}</p>" for x in LONG)
WANT = " ".join(map(H.unescape, LONG))


def brute(html):
    """The driver's pages: all of the article, cut at its block tags."""
    inner = re.search("<article>(.*)</article>", html, re.S)[1]
    parts = (" ".join(H.unescape(x.replace("<b>", "").replace("</b>", "")).split()) for x in re.split("</?(?:p|h1|br)>", inner))
    return " ".join(x for x in parts if x)


def test_equals_brute_force(spark, sf):
    pages = {r.page_id: r for r in spark.read.parquet(f"{sf}/pages.parquet").collect()}
    got = Q.op13_html_extract(spark, sf).collect()
    assert len(got) == len(pages)
    for r in got:
        assert (r.text, r.n_chars, r.url) == (brute(pages[r.page_id].html), len(r.text), pages[r.page_id].url)


@pytest.mark.parametrize(
    "noise",
    [
        '<nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>',
        "<header><h1>Site name</h1><p>The site's motto, which is long, and has marks.</p></header>",
        "<footer>&copy; Somebody, all rights reserved. Some more words, and an address.</footer>",
        '<aside><p>Read this too, it is a long teaser, with marks. And more of it.</p></aside>',
        '<div class="sidebar"><p>Another long teaser, with marks, in a box. It goes on.</p></div>',
        '<div id="cookie-notice">We use cookies, as all do. Do you agree, or not? Please say so.</div>',
        '<div class="ad">Buy this, now, it is cheap. Really cheap, and good.</div>',
        '<form action="/s"><p>Please give us your address, your name, and your age.</p><input name=q></form>',
        '<section id="comments"><h2>Comments</h2><article class="comment"><p>I like this, a lot, and I say so at length. Really.</p></article></section>',
        '<ol class="commentlist"><li><p>I like this, a lot, and I say so at length. Really.</p></ol>',
        '<div class="x1"><a href="/1">One link</a> <a href="/2">Another link</a> <a href="/3">A third link</a></div>',
        "<div>Share</div>",
        '<div hidden><p>Hidden text, which is long, and has marks. It goes on.</p></div><p style="display: none">Unseen, but long, and with marks.</p>',
        "<noscript><p>Please turn scripts on, as nothing works without them. Thanks.</p></noscript><template><p>No, no, no.</p></template>",
        '<!-- a comment, with <p>marks</p>. --><script>if (a<b) document.write("<p>x</p>")</script>',
    ],
)
def test_noise_goes_wherever_it_stands(noise):
    for shape in ("{n}<article>{p}</article>", "<div id=wrap><div class=content>{p}</div>{n}</div>", "{n}{p}", "<main>{p}</main>{n}", "<article>{p}{n}</article>", "<div class='page-with-sidebar'>{n}<article>{p}</article></div>"):
        html = HEAD + shape.format(n=noise, p=PROSE) + "</body></html>"
        if noise.startswith("<div>Share") and not shape.startswith(("{n}<art", "<main", "<div class=")):
            continue  # only place tells it from a paragraph
        if "<header>" in noise and "{p}{n}" in shape and "article" in shape or "x1" in noise and "{p}{n}</art" in shape:
            continue
        assert content(html)[0] == WANT, shape


def test_headings_lists_and_tables_of_the_article_stay():
    html = f"{HEAD}<div class=post><h1>Title</h1>{PROSE}<h2>Part</h2><ul><li>One thing, then.<li>Two things, so.</ul><blockquote>Said so, he did.</blockquote><table><tr><td>a, b<td>c; d</table></div></body>"
    assert content(html)[0] == f"Title {WANT} Part One thing, then. Two things, so. Said so, he did. a, b c; d"


def test_text_of_a_block():
    assert content("<p>a<b>b</b>c\n  d<br>e&nbsp;&eacute;&#x41;&lt;b&gt; 1 < 2 &amp</p>")[0] == "abc d e éA<b> 1 < 2 &"
    assert content("no tags at all")[0] == "no tags at all"
    assert content(f"{HEAD}<article><p>Left <b>open, and cut, by an <a href='x")[0] == "Left open, and cut, by an"
    assert content('<p>A title="quote">b</p><p title="a>b">c, d.</p>')[0] == 'A title="quote">b c, d.'


def test_nothing_to_find():
    for html in (None, "", "   ", "<nav>Home</nav>", "<script>let a = 1", "<!-- open", "</", "<p", "<p></p>", HEAD):
        assert content(html)[0] == ""


@pytest.mark.parametrize("piece", ["<div>", "<p>x", "<b>", "<a ", "<a b=\"", "<a b='>", "<", "</p>", "<!--", "<i></u>", "<ul><li>", "<script>", "<td>", "x</div>", "&amp", "<div class=ad>", "<![", "word, "])
def test_long_odd_pages_take_linear_time(piece):
    start = time.time()
    content(piece * (1_000_000 // len(piece)))
    assert time.time() - start < 15


def test_odd_rows(spark):
    schema = "page_id long, url string, html string, text string, n_chars int, row int"
    rows = [(1, "u", None, "clash", 1, 1), (1, None, f"<article>{PROSE}</article>", None, 2, 2), (None, "v", "", "x", 3, 3), (1, None, f"<article>{PROSE}</article>", None, 2, 2)]
    got = sorted((r.page_id is None, r.text, r.url, r.n_chars) for r in extract(spark.createDataFrame(rows, schema)).collect())
    assert got == sorted([(False, "", "u", 0), (False, WANT, None, len(WANT)), (False, WANT, None, len(WANT)), (True, "", "v", 0)], key=lambda x: x[:2])
    assert extract(spark.createDataFrame([], schema)).count() == 0
