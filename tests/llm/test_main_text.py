import html as H
import re
import time

import pyarrow.parquet as pq
import pytest

pytest.importorskip("pagewright.llm")
from pagewright.llm import main_text  # noqa: E402

SF = "/root/testdata/sf0.001"
PROSE = "It was the best of the times and it was the worst of them, and all that was to be said of it had been said by the men who were there."
LONG = " ".join([PROSE] * 3)


def test_given_pages_keep_their_articles():
    """The given pages hold all main text in one article; here it is cut out by patterns."""
    rows = pq.read_table(f"{SF}/pages.parquet").to_pylist()
    for r in rows:
        body = re.search(r"(?s)<article>(.*?)</article>", r["html"])[1]
        want = [" ".join(H.unescape(re.sub(r"</?b>|<br>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", body)]
        assert main_text.extract(r["html"]) == "\n".join(x for x in want if x)


def test_page_with_everything():
    page = f"""<!DOCTYPE html><HTML><head><title>T</title><style>p{{}}</style><body class="has-sidebar">
    <header><h1>Site</h1></header><div class="cookie-notice">{LONG}</div><NAV><ul><li><a href=x>Home</a><li>Menu</ul></NAV>
    <script>if (a < b) document.write("<p>{LONG}</p>")</script><noscript><p>{LONG}</p></noscript>
    <main><article class='post'><header><h1>A &lt;Title&gt;</h1><p class=meta>By someone</p></header>
    <p>{LONG}<p>Short &amp; sweet.<!-- <p>hidden</p> --><p>x < y &copy; 3<4 <a href="/a>b">a link</a> in it, {PROSE}
    <div class="ad">Buy it</div><ul><li>First<li>Second &eacute;&nbsp; a
b</ul><blockquote>Said<br>he<br><br>then</blockquote>
    <div class="share-buttons"><a href=1>One</a> <a href=2>Two</a></div><p><a href=3>Only a link</a></p>
    <table><tr><td>one<td>two</table><form><p>{LONG}</p><button>Send</button></form><p hidden>{PROSE}</p><p>The end.</p></article>
    <section id="comments"><article class="comment"><p>{LONG}</p></article></section></main>
    <aside><p>{LONG}</p></aside><div id=sidebar><div>{LONG}</div>more</div><p>stray</p><footer>&copy; 2020 {LONG}</footer>"""
    assert main_text.extract(page).split("\n") == [
        "A <Title>", LONG, "Short & sweet.", f"x < y © 3<4 a link in it, {PROSE}", "First", "Second é a b", "Said he", "then", "one", "two", "The end."
    ]


def test_two_passes_without_an_article():
    """Short blocks go with their nearest decided neighbours; copyright lines and lists of links are bad."""
    page = f"<div><a href=1>One</a> | <a href=2>Two</a></div><p>Home</p><h2>Heading</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p><p>© us</p><p>tail</p>"
    assert main_text.extract(page).split("\n") == ["Heading", LONG, "Short.", LONG]
    assert main_text.extract("<p>Hello</p>") == "Hello"
    assert main_text.extract(f"<p>{'qwx zkv ' * 40}</p><p>{LONG}</p>") == LONG


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (None, ""), ("", ""), ("plain words", "plain words"), ("<article><p>a<b>b</b>c <i>d</i></p>e</article>", "abc d\ne"), ("<article>a<script>x</article>", "a"), ("<article>a<p title='>'>b", "a\nb"),
        ("<article>1 &lt; 2 &amp;lt; &#233;&#x41; &bogus;</article>", "1 < 2 &lt; éA &bogus;"), ("<article><p>a</div></span>b</p></article>c", "a\nb"), ("<article><p title=\"un'closed>a</p>b\"", "a\nb\""), ("a <- b <", "a <- b <"),
        ("<article>a<span class=ad>x</span>b</article>", "a\nb"), ("<article><a href=x>all</a></article>", ""), ("<article>a<svg><text>x</text></svg>b</article>", "ab"),
    ],
)
def test_small_pages(page, want):
    assert main_text.extract(page) == want


@pytest.mark.parametrize("part", ["<div>", "<p>a", "<", "<a ", "<!--", "</div>", "<script>", '<p title="', "<li>x", "<td>x", "a &", "<b>x<p>", '<p title=">', "<p title='>'>", "<p '>"])
def test_time_grows_with_length(part):
    began = time.perf_counter()
    main_text.extract(part * 60_001)
    assert time.perf_counter() - began < 9


def test_tables(spark):
    kind = "page_id long, url string, html string, text int, n_chars string"
    rows = [(None, None, None, 1, "x"), (1, "u", "<p>Hello</p>", None, None), (1, "u", "<p>Hello</p>", None, None), (2, "v", "", None, None), (3, "w", "<p>é" + LONG * 2_000, None, None)]
    pages = spark.createDataFrame(rows, kind)
    got = sorted((tuple(r) for r in main_text.main_text(pages).collect()), key=str)
    assert got == sorted([(None, None, "", 0), (1, "u", "Hello", 5), (1, "u", "Hello", 5), (2, "v", "", 0), (3, "w", "é" + LONG * 2_000, len(LONG) * 2_000 + 1)], key=str)
    assert main_text.main_text(pages.where("false")).count() == 0
