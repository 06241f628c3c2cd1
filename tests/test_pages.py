"""Pages as people write them: markup, titles, brands, main text and the report, on hand-written pages."""

import time

import pytest
from pyspark.sql import functions as F

from pagewright.operators import brand, fetches, flags, links, main_text, parse, regions, report, scores, titles

PAGE = "page_id long, url string, html string"


def parsed_row(spark, html, url="http://a.b/c"):
    return parse.parse_pages(spark.createDataFrame([(1, url, html)], PAGE)).first()


def test_markup_in_any_form(spark):
    """Upper case, single quotes and none, character references, data-src, sizes, and the first canonical link."""
    html = """<TITLE>Upper &amp; lower</TITLE><META NAME=Robots CONTENT='noindex, follow'><meta name = "viewport" content = "w"><LINK REL=stylesheet HREF=/s.css><link href='/canon?a=1&amp;b=2' rel='canonical'>
    <script type='application/ld+json'>{"a": 1}</script><SCRIPT>if (a < b) { x = "<p>not a paragraph, at all</p>" }</SCRIPT><H1 class=x>One</H1><h2>Two</h2>
    <a href='/one'>One</a> <a href=/two>Two</a> <A HREF="/three?x=1&amp;y=2"><b>Three</b></A> <a data-href="/no" href='#top'>Top</a> <a name=x>None</a> <a href="/open">Open <a href="/next">Next</a>
    <IMG SRC=/a.png ALT='A "b"' WIDTH=300 height="20px"><img data-src='/lazy.GIF?v=1'><P>A paragraph of more than twenty characters</P><FOOTER><a href=https://www.facebook.com/x>f</a></FOOTER>"""
    r = parsed_row(spark, html)
    assert (r["title"], r["h1"], r["robots"], r["has_viewport"], r["canonical"], r["jsonld"]) == ("Upper & lower", "One", "noindex, follow", True, "http://a.b/canon?a=1&b=2", ['{"a": 1}'])
    assert [(x["href"].removeprefix("http://a.b"), x["label"]) for x in r["links"]] == [("/one", "One"), ("/two", "Two"), ("/three?x=1&y=2", "Three"), ("/next", "Next"), ("https://www.facebook.com/x", "f")]
    assert [(i["src"], i["alt"], i["width"], i["height"]) for i in r["images"]] == [("/a.png", 'A "b"', 300, 20), ("/lazy.GIF?v=1", "", None, None)]
    assert (r["words"], r["footer_social"]) == (7, True)
    images = parse.page_images(parse.parse_pages(spark.createDataFrame([(1, "http://a.b/c", html)], PAGE))).orderBy("pos").collect()
    assert [(i["img_url"], i["width"], i["gif"]) for i in images] == [("http://a.b/a.png", 300, False), ("http://a.b/lazy.GIF?v=1", None, True)]
    nav = "<NAV><UL><LI><A HREF='/x'>Shop<ul><li><a href=/y>Red shoes</a></ul></A></UL></NAV>"
    nodes = regions.nav_nodes(spark.createDataFrame([(1, "http://a.b/c", nav)], PAGE)).collect()
    assert [(n["href"], n["level"]) for n in nodes] == [("http://a.b/y", 2)]


def test_a_footer_with_social_links_is_a_way_to_reach_you(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<footer><a href='https://instagram.com/x'>i</a></footer>"), (2, "http://c.d/", "<footer>(c) nobody</footer>")], PAGE)
    log = fetches.fetch_log(pages)
    rows = flags.page_flags(parse.parse_pages(pages), log)
    counts = scores.site_counts(rows, links.broken_by_page(parse.page_links(parse.parse_pages(pages)), log))
    assert {r["site"]: r["footer"] for r in counts.collect()} == {"a.b": True, "c.d": False}


def test_the_last_fetch_of_a_url_counts(spark):
    pages = spark.createDataFrame([(1, "http://a.b/", "<p>x</p>")], PAGE)
    log = spark.createDataFrame([(3, "http://a.b/", 404, 30, "js"), (9, "http://a.b/", 200, 90, "raw"), (5, "http://a.b/", 500, 50, "raw")], "page_id long, url string, status int, load_time_ms int, render_mode string")
    assert flags.page_flags(parse.parse_pages(pages), log.repartition(3)).first()["load_time_ms"] == 90


@pytest.mark.parametrize(
    ("title", "good", "company"),
    [
        ("A fine page", True, True), ("Page", False, False), ("12345 678", False, False), ("Call (555) 123-4567", False, True), ("Click here now", False, True), ("Éàü öß éé", False, True), ("Bright Roofing", True, True),
        ("Weather", True, False), ("North Shore", True, True), ("Freedom rings", False, False), ("abcd efgh", True, False), ("a" * 31, True, True), (None, False, False), ("", False, False),
    ],
)
def test_titles(spark, title, good, company):
    row = spark.createDataFrame([(title,)], "t string").select(titles.is_good_title(F.col("t")).alias("g"), titles.looks_like_company(F.col("t")).alias("c")).first()
    assert (row["g"], row["c"]) == (good, company)


def test_page_titles_fall_back(spark):
    rows = [
        ("http://a.b/x", '<meta property="og:title" content="The open graph"><title>The title</title>', "The open graph", "og:title"),
        ("http://a.b/x", '<meta property="og:title" content="Sale"><title>The title</title>', "The title", "title"),
        ("http://a.b/x", "<title>Hi</title><h1>Free</h1><h1>Second headline</h1><h2>Menu</h2><h2>Opening hours</h2>", "Opening hours", "h2"),
        ("http://a.b/x", "<h3>Third level</h3>", "Third level", "h3"),
        ("http://a.b/", "<h1>Bright Roofing Company</h1>", "Home", "home"),
        ("http://a.b/index.html", "<h1>Weather</h1>", "Weather", "h1"),
        ("http://a.b/home/", "", "Home", "home"),
        ("http://a.b/x", None, "", "none"),
    ]
    pages = spark.createDataFrame([(i, u, h) for i, (u, h, _, _) in enumerate(rows)], PAGE)
    got = titles.page_titles(parse.parse_pages(pages)).orderBy("page_id").collect()
    assert [(r["page_title"], r["origin"]) for r in got] == [(t, o) for _, _, t, o in rows]


def test_srcset(spark):
    cases = {"/a.png 300w, /b.png 1200w,/c.png 5000w": ("/b.png", 1200), "/x,y.png 10w": ("/x,y.png", 10), "/a.png 2x, /b.png": None, "": None, "/a 100w, /b 100w": ("/a", 100), None: None}
    for text, want in cases.items():
        got = spark.createDataFrame([(text,)], "s string").select(brand.widest(F.col("s")).alias("w")).first()["w"]
        assert (tuple(got) if got else None) == want


def test_brand_by_evidence(spark):
    """The home page's logo comes before those of other pages, and alternative text before classes before places."""
    rows = [
        (1, "http://a.b/", "<title>Acme</title><img src=/u/logo.png><div class='site logo'><span><img src='/in.png'></span></div><img src=/c.png class=my-logo srcset='/c2.png 900w, /c1.png 100w'>"),
        (2, "http://a.b/about", "<title>About</title><img src=/alt.png alt='The Logo'><img src=/c.png class=my-logo><img src=/plain.png>"),
        (3, "http://c.d/long/page", "<title>Long</title><img id='logo' src=/x.png><img src=/x.png alt=logo>"), (4, "http://c.d/short", "<title>Short</title>"), (5, "http://e.f/", None),
    ]
    parsed = parse.parse_pages(spark.createDataFrame(rows, PAGE))
    found = {r["img_url"]: r for r in brand.logo_candidates(parsed).collect()}
    assert {u.rsplit("/", 1)[1]: r["evidence"] for u, r in found.items()} == {"logo.png": "url", "in.png": "inside", "c.png": "class", "alt.png": "alt", "x.png": "alt"}
    assert (found["http://a.b/c.png"]["pages"], found["http://a.b/c.png"]["best_url"], found["http://a.b/c.png"]["best_width"]) == (2, "http://a.b/c2.png", 900)
    assert {r["site"]: (r["name"], r["logo"]) for r in brand.brands(parsed).collect()} == {"a.b": ("Acme", "http://a.b/c.png"), "c.d": ("Short", "http://c.d/x.png"), "e.f": (None, None)}


PROSE = "This is a sentence of nine words in all"


@pytest.mark.parametrize(
    ("html", "want"),
    [
        (f"<nav><div><div>{PROSE}</div>{PROSE}</div></nav><article><div><p>{PROSE}</p><div class='ad'><div>x</div>{PROSE}</div>tail</div></article><footer><p>{PROSE}</footer>", f"{PROSE}\ntail"),
        (f"<HEADER>{PROSE}</HEADER><MAIN><h1>Head</h1><P>{PROSE}<BR>more<p><b>bold</b>ly <a href=x>link</a> in a longer text</MAIN>", f"Head\n{PROSE} more\nboldly link in a longer text"),
        (f"<div><p>{PROSE}</p><p>few words</p><ul><li><a href=1>{PROSE}</a></li></ul><div id=sidebar>{PROSE}</div></div>", PROSE),
        (f"<article>a<!-- {PROSE} --><script>{PROSE}</script><article class=comment>{PROSE}</article>b</div></span></article>", "a\nb"),
        (f"<form><article>{PROSE}</article></form>", ""), ("<article><a href=1>only</a> x</article>", ""), ("<article>1 &lt; 2 &amp; 3 < 4</article>", "1 < 2 & 3 < 4"), (None, ""), ("", ""), ("<div><div>", ""),
    ],
)
def test_main_text(spark, html, want):
    r = main_text.extract_main_text(spark.createDataFrame([(1, "http://a.b/c", html)], PAGE)).first()
    assert r["main_text"] == want and r["words"] == len(want.split()) and r["blocks"] == len(want.split("\n")) * bool(want)


def test_main_text_of_a_long_page(spark):
    began = time.time()
    html = "<article>" + f"<div><p>{PROSE} <b>x</b></p></div>" * 3_000 + "</article>"
    r = main_text.extract_main_text(spark.createDataFrame([(1, "http://a.b/c", html)], PAGE)).first()
    assert (r["blocks"], r["words"]) == (3_000, 30_000) and time.time() - began < 60


def test_report(spark):
    rows = [(i, f"http://a.b/{i}", f"<title>T</title><h1>x</h1><meta name=description content=d><meta name=viewport content=v><p>{PROSE}</p><a href='http://a.b/7'>gone</a>") for i in range(1, 9)] + [(40, "https://c.d/", "<title>T</title>")]
    pages = spark.createDataFrame(rows, PAGE)
    parsed = parse.parse_pages(pages)
    log = fetches.fetch_log(pages)
    f, broken = flags.page_flags(parsed, log), links.broken_by_page(parse.page_links(parsed), log)
    urls = report.issue_urls(report.page_issues(f, broken))
    found = {(r["site"], r["issue"], r["url"]): r["note"] for r in urls.collect()}
    assert found["a.b", "error_pages", "http://a.b/7"] == "status 404" and found["a.b", "broken_links", "http://a.b/1"] == "1 links"
    assert found["a.b", "very_thin_content", "http://a.b/2"] == "9 words (generic)" and ("c.d", "no_viewport", "https://c.d/") in found
    examples = report.issue_examples(urls)
    e = {(r["site"], r["issue"]): r for r in examples.collect()}["a.b", "broken_links"]
    assert (e["affected"], e["more"], e["examples"]) == (8, 5, "http://a.b/1 (1 links); http://a.b/2 (1 links); http://a.b/3 (1 links)")
    counts = scores.site_counts(f, broken)
    full = {r["site"]: r for r in report.insight_report(scores.site_scores(counts), scores.site_issues(counts), examples, spark.createDataFrame([("a.b", "two", 2), ("a.b", "one", 1)], "site string, phrase string, rank int")).collect()}
    got = full["a.b"]
    assert [i["severity"] for i in got["issues"]] == sorted((i["severity"] for i in got["issues"]), key=["high", "medium", "low"].index)
    assert got["high"] + got["medium"] + got["low"] == len(got["issues"]) == sum(c["issues"] for c in got["categories"]) and got["phrases"] == ["one", "two"]
    first = next(i for i in got["issues"] if i["issue"] == "broken_links")
    assert first["examples"].startswith("http://a.b/1") and first["fix"] == report.FIXES["broken_links"] and full["c.d"]["phrases"] is None
