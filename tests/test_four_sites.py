"""Queries that find nothing on the given tables, on four small sites that hold what they look for, against their SQL."""

import duckdb
import pytest

from pagewright.operators import articles, links, parse, rollups
from pagewright.plans import registry


def rows_of(table):
    """Rows of an Arrow table as sorted tuples of texts, columns by name."""
    show = lambda v: round(v, 6) if isinstance(v, float) else v
    return sorted(repr([(k, show(r[k])) for k in sorted(r)]) for r in table.to_pylist())


LONG = "This paragraph is long enough to count as one of the page."


def page(title, *body, nav=True):
    menu = '<nav><a href="/services">Services</a><a href="/about">About</a></nav>' if nav else ""
    return f"<html><head><title>{title}</title></head><body>{menu}{''.join(body)}</body></html>"


#: page_id, url, html; pages 7 and 36 failed by the fetch log, which goes by page_id.
PAGES = [
    (1, "https://shop.example/", page("Shop", "<h1>The best shop</h1>", f"<p>{LONG}</p><p>{LONG} Twice.</p><p>{LONG} Thrice.</p>", '<img src="/logo.png" alt="" width="40" height="20"><img src="/hero.jpg" alt="Hero" width="800" height="400">',
        '<img src="/hero2.jpg" alt="Hero" width="400" height="800"><img src="/anim.gif" alt="x">', '<a href="/gone">Gone</a><a href="/price-list.pdf"></a><a href="https://facebook.com/shop">Us</a><a href="/news">Latest news</a>')),
    (7, "https://shop.example/gone", page("Gone", "<p>Nothing</p>")),
    (2, "https://shop.example/services", page("Our services", "<h2>Machine repair</h2><h2>Machine Repair</h2><h3>Is it any good, then?</h3>", f"<p>{LONG}</p>", '<video src="/a.mp4"></video><iframe src="https://player.example/1"></iframe><video><source src="/b.mp4"></video><video></video><video src="/a.mp4"></video>')),
    (3, "https://shop.example/about", page("About", '<script type="application/ld+json">{"@type": "Store", "name": "Shop"}</script><script type="application/ld+json">{bad</script><script type="application/ld+json">[1, 2]</script>', '<a href="/team">Team</a><img src="https://cdn.example/team.png" alt="brand">')),
    (4, "https://shop.example/team", page("Team", "<h1>People we trust</h1>", '<a href="/deep">Cookie rules</a><a href="/deep#x">More</a><img src="https://cdn.example/team.png" alt="brand">')),
    (5, "https://shop.example/deep", page("Deep", '<a href="/deeper">Sports</a>')),
    (6, "https://shop.example/deeper", page("Deeper", '<a href="/">Home</a>')),
    (8, "https://shop.example/list.csv", page("List")),
    (9, "https://menu.example/menu", page("Menu of the day", "<h2>Soup of the day</h2>", f"<p>{LONG}</p>", '<a href="https://x.com/menu">X</a><a href="/privacy">Privacy</a>')),
    (10, "https://menu.example/privacy", page("Privacy policy", "<p>We keep nothing at all of what you tell us.</p>", nav=False)),
    (11, "https://docs.example/a.pdf", page("A")),
    (12, "https://docs.example/b.pdf", page("B", '<a href="manual.zip">Manual</a>')),
    (13, "https://docs.example/c.json", ""),
    (36, "https://void.example/", page("", nav=False)),
]
NAMES = [
    "broken_internal_links", "pages_with_broken", "business_pages", "extract_items", "extract_policies", "primary_nav_guess", "page_images", "rollup_images", "image_domains", "media_roles", "page_videos", "page_jsonld",
    "hero_content", "page_files", "social_links", "extract_faqs", "rollup_content_types", "reachable_within", "follow_links", "crawl_order", "uncrawled_links", "page_links", "page_headings", "nav_rollup", "link_degree",
]


@pytest.fixture(scope="module")
def sites(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("sites"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").write.parquet(f"{where}/pages.parquet")
    return where


@pytest.mark.parametrize("name", NAMES)
def test_four_sites_equal_their_sql(spark, sites, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{sites}/pages.parquet/*.parquet'")
    got = rows_of(registry.QUERIES[name](spark, sites).toArrow())
    assert got and got == rows_of(duck.sql(registry.ORACLES[name]).to_arrow_table())


def parsed(spark, html):
    return parse.parse_pages(spark.createDataFrame([(1, "https://a.example/x/y", html)], "page_id long, url string, html string"))


def test_videos_in_any_form(spark):
    html = "<VIDEO controls><track src='t.vtt'>text<SOURCE type=x src='v.webm'><source src=w.mp4></VIDEO><iframe title=\"a>b\" src=//p.example/1></iframe><video poster='p.png'>none</video><video src=''><source src=../z.mp4>"
    got = [(r["video_url"], r["kind"], r["pos"]) for r in parse.page_videos(parsed(spark, html)).orderBy("pos").collect()]
    assert got[0] == ("https://a.example/x/v.webm", "mp4", 0) and got[-1] == ("https://a.example/x/../z.mp4", "mp4", len(got) - 1)
    assert parse.page_videos(parsed(spark, None)).count() == 0
    assert parse.page_videos(parsed(spark, "<video " + "<p>" * 50_000)).count() == 0


def test_hero_of_odd_pages(spark):
    row = articles.hero_content(parsed(spark, None)).first()
    assert (row["heading"], row["text"], row["image"]) == ("", "", None)
    row = articles.hero_content(parsed(spark, "<h3>Third</h3><img src=a.png><img src=b.png width=2 height=3><img src=c.png width=3 height=2><img src=d.png width=9>")).first()
    assert (row["heading"], row["image"]) == ("Third", "https://a.example/x/b.png")


def test_follow_rules(spark):
    rows = [("s", "u", i, f"h{i}", label) for i, label in enumerate(["Log in", "LOGIN", "World report", "World cookies", None, ""])]
    found = spark.createDataFrame(rows, "site string, url string, pos int, href string, label string")
    at = lambda depth: [r["priority"] for r in links.follow_links(found, spark.createDataFrame([("s", "u", depth)], "site string, url string, depth int")).orderBy("pos").collect()]
    assert at(3) == [1, 0, 2, 0, 1, 1] and at(4) == [0] * 6


def test_contacts_hold_addresses(spark):
    docs = [("s", "At 12 Long Oak Street, Springfield, IL 62701, or 7 elm ave."), ("s", "12 Long Oak Street"), ("s", None), (None, "nothing 5 here")]
    rows = rollups.rollup_contacts(spark.createDataFrame(docs, "source string, text string")).where("kind = 'address'").collect()
    assert [(r["source"], r["distinct_values"], r["mentions"]) for r in rows] == [("s", 3, 4)]


def test_content_types_and_ties(spark):
    types = spark.createDataFrame([("s", "pdf"), ("s", "csv"), ("s", "csv"), ("s", "pdf"), (None, "html")], "site string, content_type string")
    got = {(r["site"], r["content_type"]): (r["pages"], r["percent"], r["most_common"]) for r in rollups.rollup_content_types(types).collect()}
    assert got == {("s", "csv"): (2, 50.0, True), ("s", "pdf"): (2, 50.0, False), (None, "html"): (1, 100.0, True)}
