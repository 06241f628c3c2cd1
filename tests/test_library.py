import os

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from pagewright.functions import text, urls
from pagewright.operators import articles, entities, fetches, flags, keywords, links, parse, regions
from pagewright.plans import registry
from pagewright.streaming import fetches as stream

SF = "/root/testdata/sf0.001"


def canonical(f: pd.DataFrame) -> list:
    show = lambda v: None if v is None or v is pd.NA or v != v else round(float(v), 6) if isinstance(v, float) else str(v)
    return sorted(tuple(show(v) for v in row) for row in f[sorted(f.columns)].itertuples(index=False))


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in os.listdir(SF):
        c.sql(f"CREATE VIEW {t.removesuffix('.parquet')} AS SELECT * FROM '{SF}/{t}'")
    return c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    assert canonical(registry.QUERIES[name](spark, SF).toPandas()) == canonical(duck.sql(registry.ORACLES[name]).df())


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("url", "want"),
    [("http://a.b", "http://a.b/"), ("http://a.b/x?b=2&a=1#f", "http://a.b/x/?a=1&b=2"), ("http://a.b/x.html", "http://a.b/x.html"), ("http://a.b/x/", "http://a.b/x/")],
)
def test_normalize_url(spark, url, want):
    assert one(spark, urls.normalize_url(F.lit(url))) == want


@pytest.mark.parametrize(("href", "want"), [("/p", "http://a.b/p"), ("//c.d/e", "http://c.d/e"), ("q", "http://a.b/x/q"), ("https://z.y", "https://z.y"), ("?s=1", "http://a.b/x/y?s=1")])
def test_resolve_url(spark, href, want):
    assert one(spark, urls.resolve_url(F.lit(href), F.lit("http://a.b/x/y?k=v"))) == want


def test_text_functions(spark):
    assert one(spark, text.count_occurrences(F.lit("a b a b c"), F.lit("a b"))) == 2
    assert one(spark, text.count_occurrences(F.lit("ab a"), F.lit("a"))) == 1
    assert [one(spark, text.simple_stem(F.lit(w))) for w in ("running", "cats", "is", "boxes")] == ["runn", "cat", "is", "boxe"]
    assert one(spark, text.extract_phones(F.lit("call +1 (555) 123-4567")))[0] == "5551234567"


def test_parse_of_a_page_without_html(spark):
    rows = parse.parse_pages(spark.createDataFrame([(1, "http://a.b/c", None)], "page_id long, url string, html string")).collect()
    assert (rows[0]["title"], rows[0]["words"], rows[0]["n_links"]) == ("", 0, 0)


def test_images_files_headings(spark):
    html = '<h1>Is this it, really?</h1><h2>Two</h2><img src="/a.png" alt=""><img src="/a.png" alt="x"><a href="/d.pdf"></a><meta name="robots" content="NoIndex"><p>one two three four five six</p>'
    parsed = parse.parse_pages(spark.createDataFrame([(1, "http://a.b/c", html)], "page_id long, url string, html string"))
    assert [r["img_url"] for r in parse.page_images(parsed).collect()] == ["http://a.b/a.png"]
    assert parse.page_files(parsed).first()["label"] == "Download PDF"
    assert [r["tag"] for r in parse.page_headings(parsed).orderBy("pos").collect()] == ["h1", "h2"]
    assert parsed.first()["robots"] == "NoIndex"


@pytest.mark.parametrize(
    ("url", "words", "paras", "heads", "cards", "want"),
    [("http://a/login", 1, 1, 1, 0, "utility"), ("http://a/shop", 10, 3, 1, 8, "catalog"), ("http://a/blog/x", 301, 4, 2, 0, "article"), ("http://a/blog/x", 300, 4, 1, 0, "generic"), ("http://a/x", 399, 6, 2, 0, "landing"), ("http://a/gallery", 199, 2, 0, 0, "media_gallery")],
)
def test_page_types(spark, url, words, paras, heads, cards, want):
    assert one(spark, flags.infer_page_type(F.lit(url), *map(F.lit, (words, paras, heads, cards)))) == want


def test_thin_levels(spark):
    level = lambda t, w: one(spark, flags.thin_level(F.lit(t), F.lit(w), F.lit(False)))
    assert [level("article", w) for w in (299, 300, 599, 600)] == ["very_thin", "thin", "thin", None]


def test_consistency(spark):
    c = lambda n, s: one(spark, fetches.consistency(F.lit(n), F.lit(100.0), F.lit(s)))
    assert [c(4, 1.0), c(5, 41.0), c(5, 40.0), c(5, 20.0)] == ["unknown", "unstable", "moderate", "stable"]


def test_reachable_within(spark):
    edges = spark.createDataFrame([("s", "a", "b"), ("s", "b", "c"), ("s", "c", "a"), ("s", "c", "d")], "site string, src string, dst string")
    got = links.reachable_within(edges, spark.createDataFrame([("s", "a")], "site string, url string"), 2)
    assert {(r["url"], r["depth"]) for r in got.collect()} == {("a", 0), ("b", 1), ("c", 2)}


def test_broken_links_need_a_known_target(spark):
    rows = spark.createDataFrame([("s", "u", "x", "l", "internal"), ("s", "u", "y", "l", "internal"), ("s", "u", "z", "l", "internal")], "site string, url string, href string, label string, kind string")
    status = spark.createDataFrame([("x", 404), ("y", 200)], "url string, status int")
    assert [r["href"] for r in links.broken_internal_links(rows, status).collect()] == ["x"]


def test_robots_groups(spark):
    rows = links.robots_rules(spark.createDataFrame([("s", "User-agent: a\nDisallow: /x\nUser-agent: *\nAllow: /y # note\nSitemap: http://s/m.xml")], "site string, body string"))
    assert [(r["agent"], r["rule"], r["value"]) for r in rows.orderBy("line").collect()] == [("a", "disallow", "/x"), ("*", "allow", "/y"), ("*", "sitemap", "http://s/m.xml")]


def test_phrases(spark):
    words = F.split(F.lit("best red shoes for the city"), " ")
    assert set(one(spark, keywords.phrases(words))) == {"best red", "red shoes", "best red shoes"}


HTML = """<title>Our services</title><nav><ul><li><a href="/shop">Shop</a><ul><li><a href="/shop/red">Red shoes</a></li><li><a href="/call">Call us at noon</a></li></ul></li>
<li><a href="/blog">Blog</a></li><li><a href="/shop">Shop</a></li></ul></nav><h1>Cleaning of windows</h1><h2>Home</h2><table><tr><th>a<th>b</tr><tr><td>1</td><td><b>2</b> &amp; 3</td></tr></table>
<img src="/logo.png" alt=""><img src="/x.png" alt="Our team"><img src="/y.png" alt=""><footer><a href="/a">A</a><h4>Help</h4><a href="/b">B</a><a href="/c"></a> me@site.org (555) 123-4567</footer>"""


def test_regions_of_a_page(spark):
    pages = spark.createDataFrame([(1, "http://a.b/c", HTML), (2, "http://a.b/d", None)], "page_id long, url string, html string")
    nodes = regions.nav_nodes(pages).orderBy("pos").collect()
    assert [(n["href"], n["level"], n["parent"]) for n in nodes] == [("http://a.b/shop", 1, None), ("http://a.b/shop/red", 2, "http://a.b/shop"), ("http://a.b/blog", 1, None)]
    assert [(r["heading"], r["label"]) for r in regions.footer_links(pages).orderBy("pos").collect()] == [(None, "A"), ("Help", "B")]
    assert {(r["page_id"], r["email"], r["phone"]) for r in regions.footer_contacts(pages).collect()} == {(1, "me@site.org", " 5551234567"), (2, None, None)}
    cells = regions.table_cells(pages).orderBy("row_no", "col_no").collect()
    assert [(c["row_no"], c["col_no"], c["text"]) for c in cells] == [(0, 0, "a"), (0, 1, "b"), (1, 0, "1"), (1, 1, "2 & 3")]


def test_entities_of_a_page(spark):
    html = HTML + "<p>You find us at 12 Long Street, any day of the week</p>"
    parsed = parse.parse_pages(spark.createDataFrame([(1, "http://a.b/contact", html), (2, "http://a.b/privacy", HTML)], "page_id long, url string, html string"))
    assert {(r["url"][-7:], r["kind"]) for r in entities.business_pages(parsed).collect()} == {("contact", "service"), ("contact", "location"), ("privacy", "service"), ("privacy", "policy")}
    items = entities.extract_items(parsed).collect()
    assert [(i["title"], round(i["confidence"], 6), i["url"]) for i in items if "window" in i["title"]] == [("Cleaning of windows", 0.9, "http://a.b/contact")]
    assert [r["address"] for r in entities.extract_locations(parsed).collect()] == ["12 Long Street"]
    assert [r["policy"] for r in entities.extract_policies(parsed).collect()] == ["privacy"]
    assert {(r["role"], r["images"]) for r in entities.media_roles(parse.page_images(parsed)).collect()} == {("logo", 1), ("team", 1), ("content", 1)}
    assert entities.primary_nav_guess(parsed).count() == 2


def test_article_of_a_page(spark):
    text = "word " * 30
    html = f'<meta name="author" content="A. Writer"><h1 class="big entry-title">A title of some length</h1><time datetime="2024-03-05T10:00">x</time><div class="post-content"><p>Advertisement {text}</p></div>'
    pages = spark.createDataFrame([(1, "http://a.b/c", html), (2, "http://a.b/d", None)], "page_id long, url string, html string")
    good, bad = articles.extract_articles(pages).orderBy("page_id").collect()
    assert (good["title"], good["author"], str(good["publish_date"]), good["word_count"], good["success"]) == ("A title of some length", "A. Writer", "2024-03-05", 30, True)
    assert (bad["title"], bad["content"], bad["success"]) == (None, "", False)
    day = lambda s: str(one(spark, articles.parse_article_date(F.lit(s))))
    assert [day(s) for s in ("on 03/25/2024", "25/03/2024", "3/5/2024", "March 5, 2024", "5 Mar 2024", "no date", "99/99/2024")] == ["2024-03-25", "2024-03-25", "2024-03-05", "2024-03-05", "2024-03-05", "None", "None"]


def test_components_of_a_page(spark):
    html = HTML + "<p>The first paragraph of this page</p><p>The second paragraph of this page</p><p>The third paragraph of this page</p>"
    parsed = parse.parse_pages(spark.createDataFrame([(1, "http://a.b/c", html), (2, "http://a.b/d", None)], "page_id long, url string, html string"))
    full, empty = (r["components"] for r in articles.page_components(parsed).orderBy("url").collect())
    assert [(c["type"], len(c["texts"]), len(c["urls"])) for c in full] == [("hero", 2, 1), ("section", 1, 0), ("gallery", 0, 2)]
    assert [c["texts"] for c in empty] == [["Content not available"]]


def test_keyword_metrics_v2(spark):
    page = "<title>Red shoes</title><h1>Fine red shoes</h1><p>We sell red shoes, and red shoes only</p>"
    parsed = parse.parse_pages(spark.createDataFrame([(1, "http://a.b/", page), (2, "http://a.b/x/y", "<p>Nothing at all to be read here</p>")], "page_id long, url string, html string"))
    got = {r["phrase"]: r for r in keywords.keyword_metrics_v2(parsed, spark.createDataFrame([("a.b", "red shoes"), ("a.b", "blue hats")], "site string, phrase string")).collect()}
    red = got["red shoes"]
    assert (red["pages_used"], red["occurrences"], red["importance"], red["density"], red["density_score"]) == (1, 2, 3.0, 2 / 6, 40.0)
    assert (round(red["coverage"], 6), red["on_page"], red["total"]) == (round(300 / 3.5, 6), 65.0, 74.9)
    assert (got["blue hats"]["total"], got["blue hats"]["importance"]) == (0.0, 1.0)


def test_keyword_comparison(spark):
    rows = [(1, "http://a.b/", "<title>Red shoes</title><p>Red shoes for all who walk</p>"), (2, "http://c.d/", "<title>Other</title><p>Where red shoes are not made</p>"), (3, "http://e.f/", None)]
    parsed = parse.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = {(r["site"], r["phrase"]): r["total"] for r in keywords.keyword_comparison(parsed, "a.b").collect()}
    # the one phrase, and its words behind it
    assert set(got) == {(s, p) for s in ("a.b", "c.d", "e.f") for p in ("red shoes", "red", "shoe")}
    assert got["a.b", "red shoes"] > got["c.d", "red shoes"] > got["e.f", "red shoes"] == 0
    assert keywords.keyword_comparison(parsed, "none.such").count() == 0


def test_nav_labels(spark):
    good = lambda s: one(spark, regions.is_nav_label(F.lit(s)))
    assert [good(s) for s in ("FAQ", "555-123-4567", "Read more", "Our small old town house", "a b c d e fg", "12", "12345", "me@x.org", "")] == [True, False, False, True, True, False, True, False, False]


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.write.parquet(str(tmp_path / "in"))
    live = stream.progress_counts(stream.fetch_rows(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))))
    q = live.writeStream.outputMode("complete").format("memory").queryName("progress").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(spark.table("progress").collect()) == sorted(stream.progress_counts(stream.fetch_rows(events)).collect())
