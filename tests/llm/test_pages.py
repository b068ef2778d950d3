"""Frames that aren't, unclosed elements, long and deep pages, and what differencing decides."""

import re
import time

import pytest

from quarry.llm import pages
from quarry.llm.queries import op10_html_extraction

PAGE = "page_id bigint, url string, html string"


def kept(page):
    return " ".join(pages.text_lines(page)[0])


@pytest.mark.parametrize(
    "page, want",
    [
        ('<div class="layout with-sidebar"><article><p>Story</article></div>', "Story"),
        ('<form id="aspnetForm"><nav>m</nav><article><p>Story</article></form>', "Story"),
        ('<form id="aspnetForm"><nav>m</nav><p>Story of some length</form><p>x', "Story of some length x"),
        ('<p>Story of some length<form>Your name<input></form>', "Story of some length"),
        ('<div class="no-comments page"><main>Story</main></div>', "Story"),
        ('<article><p class="ad">Buy now<p>Story goes on.', "Story goes on."),
        ('<article><ul><li class=ad>Buy<li>One<li>Two</ul>', "One Two"),
        ("<article><table><tr class='promo'><td>x<td>y<tr><td>One<td>Two</table>", "One Two"),
        ("<article><dl><dt class=ads>x<dd>One<dt>Two</dl>", "One Two"),
        ('<div class="search-page"><main><p>m</main></div>', "m"),
        ('<div class="banner top"><article>Story</article></div>', "Story"),
        ('<div class="sidebar"><article>Card</article></div><article>Story</article>', "Story"),
        ('<div id="comments"><article class="comment-body">First!</article></div><article>Story</article>', "Story"),
        ("<aside><article>Card</article></aside><article>Story</article>", "Story"),
        ('<article>a<p class="notice">b<p class="search-results">c<p class="banner-image">d</article>', "a b c d"),
        ('<article>a<p class="cookie-notice">b<div class="share social">c</div></article>', "a c"),
        ("<article><p>a<b>c</p><p>d</b>e</p></article>", "ac de"), ("<p>a<div class=ad>b<p>c</div>d", "a d"),
    ],
)
def test_frames_and_unclosed_elements(page, want):
    assert kept(page) == want


@pytest.mark.parametrize(
    "page, count",
    [
        ("<article>" + "<div>" * 100_000 + "deep" + "</div>" * 100_000, 1),
        ("<article><b>" + "<div>x</b></i></section>" * 50_000, 50_000),
        ("<article>" + "<p>One more paragraph &amp; so on." * 150_000, 150_000),
        ("<article>" + "<b><i>" * 50_000 + "x" + "</b></i>" * 50_000, 1),
        ("<article>" + "<p>" + "word " * 1_000_000, 1),
        ("<article>" + "<li>x" * 50_000 + "<td>y" * 50_000, 100_000),
        ("<article><" * 100_000 + "x", None),
    ],
)
def test_long_and_deep_pages(page, count):
    began = time.time()
    lines, _ = pages.page_lines(page)
    assert time.time() - began < 30
    assert count is None or len(lines) == count


def test_doubtful_lines_are_decided_by_the_nearest_page(spark):
    body = (
        '<body><nav>menu</nav><article><h1>Head {0}</h1><p class="notice">{1}</p><p>Story {0}, quoted.</p>'
        "<p>All quote this.</p></article><footer>f</footer>"
    )
    said = ["Read our terms.", "Read our terms.", "Storm warning for the coast."]
    data = [(i, f"http://h.example/{i}", body.format(i, s)) for i, s in enumerate(said)]
    got = {r.page_id: r.text for r in pages.main_text(spark.createDataFrame(data, PAGE)).collect()}
    tail = "Story {0}, quoted. All quote this."
    assert got[0] == "Head 0 " + tail.format(0) and got[1] == "Head 1 " + tail.format(1)
    assert got[2] == "Head 2 Storm warning for the coast. " + tail.format(2)


def plain_markup(page):
    """The given pages without their markup: elements by name become plain ones, class words go."""
    page = re.sub(r"<(/?)(?:article|nav|footer)\b[^>]*>", r"<\1div>", page)
    return re.sub(r' class="ad"', "", page)


def test_lines_of_the_given_pages_decided_by_difference(spark):
    """Without their markup, the given pages lose what they share with their nearest page."""
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    data = [(r.page_id, r.url, plain_markup(r.html or "")) for r in rows]
    found = pages.shared_lines(spark.createDataFrame(data, PAGE), "page_id", "url", "html").collect()
    assert len(found) == len(rows)
    shared = sum(len(r.shared) for r in found if not r.alone)
    stay = {r.page_id: r for r in pages.main_text(spark.createDataFrame(data, PAGE)).collect()}
    for r in found:
        want = [x for i, x in enumerate(r.texts) if r.alone or i not in set(r.shared)]
        assert stay[r.page_id].text == " ".join(want)
    assert shared > 0


def test_query_reads_every_page(spark):
    out = op10_html_extraction(spark, "/root/testdata/sf0.001").collect()
    given = {r.page_id: r.html for r in spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()}
    assert len(out) == len(given)
    for r in out:
        body = re.search(r"<article>(.*)</article>", given[r.page_id] or "", re.S)
        text = re.sub(r"<br>|</?(?:p|h1)>", " ", body[1]) if body else ""
        import html

        assert r.text == " ".join(html.unescape(re.sub(r"<[^>]+>", "", text)).split()), r.page_id
        assert r.n_chars == len(r.text)
