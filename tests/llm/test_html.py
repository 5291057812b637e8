"""Main text: what differencing alone removes, and names of elements that must not take an article away."""

import random

import pytest

from panelweave.llm import html_extract

PAGE = "page_id long, url string, html string"


def extract(spark, rows, **options):
    return {r["page_id"]: (r["text"], r["n_deleted"]) for r in html_extract.main_text(spark.createDataFrame(rows, PAGE), **options).collect()}


def test_differencing_alone_removes_the_template(spark):
    """Pages without any telling tag or name: menu, slogan and imprint are found by their neighbours."""
    rng = random.Random(4)
    text = lambda k: " ".join(f"w{k}x{rng.randrange(99)}" for _ in range(25))
    rows, want = [], {}
    for k in range(40):
        paragraphs = [text(k) for _ in range(3)]
        html = "<div>Home</div><div>Archive</div><p>" + "</p><p>".join(paragraphs[:2]) + "</p><div>Our slogan</div><p>" + paragraphs[2] + "</p><div>Imprint 2020</div>"
        rows.append((k, f"http://h{k % 3}.org/en/{k}", html))
        want[k] = (" ".join(paragraphs), 4)
    # copies of one page under neighbouring paths keep their text, since the nearest page of other content decides
    rows += [(100 + k, f"http://h0.org/en/0/{k}", rows[0][2]) for k in range(10)]
    want |= {100 + k: want[0] for k in range(10)}
    assert extract(spark, rows) == want
    assert extract(spark, rows, block=3) == want
    alone = extract(spark, rows[:1] + rows[40:])
    assert {v for v in alone.values()} == {(f"Home Archive {' Our slogan '.join([' '.join(want[0][0].split()[:50]), ' '.join(want[0][0].split()[50:])])} Imprint 2020", 0)}


@pytest.mark.parametrize(
    "html, want",
    [
        ('<div class="layout with-sidebar"><article><p>Text</p></article></div>', "Text"),
        ('<div class="widget"><article><p>Text</p></article></div>', "Text"),
        ('<article><h1 class="article-header">Head</h1><p>Text</p></article>', "Head Text"),
        ('<article><div class="side-by-side">One</div><section id="search-algorithms">Two</section></article>', "One Two"),
        ('<article><p class="ad-hoc">One</p><h2 id="search-and-rescue">Two</h2><p class="share">Three</p><span class="ad">Four</span></article>', "One Two Three Four"),
        ('<article><p>E = <math><mi>m</mi></math> and <svg><text>s</text></svg></p></article>', "E = m and s"),
        ('<article><p>Text</p><div class="comments">C</div><ul class="share-buttons"><li>S</li></ul><div id="ad">A</div></article>', "Text"),
        ('<article><p>Text</p></article><section id="comments"><article class="comment"><p>C</p></article></section>', "Text"),
        ('<div class="cookie-notice">N</div><div class="site-header">H</div><main>Text</main><div class="sidebar-right">S</div>', "Text"),
        ("<aside><article>Teaser</article></aside><main>Text</main>", "Text"),
        ('<main>Text <article class="comment">C</article></main>', "Text"),
        ("<article>a<p>b</p>c", "a b c"),
        ("<html><head><title>T</title><meta charset=utf-8><body><nav>N</nav><article>Text</article>", "Text"),
        ("<html><head><title>T</title><script>s()</script><p>Text</p>", "Text"),
        ("<head><title>T</title></head><p>Text</p>", "Text"),
        ("<head><title>T</title>Text", "Text"),
        ('<body><form id="aspnetForm"><input name="v"><nav>N</nav><article><p>Text</p></article><footer>F</footer></form></body>', "Text"),
        ("<form>Search <article>A</article></form><article>Text</article>", "Text"),
        ("<body><nav><ul><li>N</li></ul><article><p>Text</p></article></body>", "Text"),
        ("<body><nav>N<article>Teaser</article></nav><div>Text</div></body>", "Text"),
        ("<body><nav>N<article>Teaser</article></nav><nav>M<article>Text</article></body>", "Text"),
        ('<article><figure class="banner"><figcaption>Seen</figcaption></figure><figure class="ad">A</figure>Text</article>', "Seen Text"),
        ('<article>Text</article><div class="comment-thread"><p>C</p></div>', "Text"),
    ],
)
def test_names(spark, html, want):
    assert extract(spark, [(1, "http://a.org/x", html)])[1][0] == want


def test_repeated_rows(spark):
    html = "<div>Menu</div><p>Long text of the one page</p>"
    rows = [(1, "http://a.org/x", html)] * 300 + [(2, "http://a.org/y", html.replace("Long text", "Other words"))]
    got = html_extract.main_text(spark.createDataFrame(rows, PAGE), block=8).collect()
    assert sorted((r["page_id"], r["text"]) for r in got) == [(1, "Long text of the one page")] * 300 + [(2, "Other words of the one page")]
