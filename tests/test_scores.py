from pyspark.sql import functions as F

from pagewright.operators import flags, images, parse, scores

COUNTS = {
    "site": "a", "pages": 10, "no_title": 0, "no_description": 0, "no_h1": 0, "alt_pages": 0, "noindex_pages": 0, "no_viewport_pages": 0, "mixed_pages": 0, "deep_pages": 0, "bad_pages": 0,
    "broken_pages": 0, "broken_links": 0, "very_thin": 0, "thin_pages": 0, "low_text": 0, "important": 5, "avg_words_important": 400.0, "avg_words": 400.0, "avg_load": 100.0, "p90_load": 200.0,
    "slow": 0, "very_slow": 0, "max_kb": 10.0, "nav_links": 3, "footer": True, "https": True, "http": False, "very_large_image_pages": 0, "modern_image_pages": 1,
}


def issues(spark, robots=True, sitemap=True, **changes):
    row = {**COUNTS, **changes}
    table = spark.createDataFrame([tuple(row.values())], list(row))
    return {r["issue"]: r["severity"] for r in scores.site_issues(table, robots, sitemap).collect()}


def test_a_sound_site_has_no_issue(spark):
    assert issues(spark) == {}


def test_severities_at_their_bounds(spark):
    assert issues(spark, no_title=2, no_h1=1, deep_pages=2, broken_pages=1, broken_links=10) == {"missing_title": "medium", "missing_h1": "low", "broken_links": "medium"}
    assert issues(spark, no_title=3, no_h1=2, deep_pages=3, broken_pages=1, broken_links=11) == {"missing_title": "high", "missing_h1": "medium", "deep_urls": "low", "broken_links": "high"}
    assert issues(spark, very_thin=1, thin_pages=1, low_text=1, avg_words_important=199.0) == {"very_thin_content": "high", "thin_content": "medium", "low_text_catalog": "low", "low_average_words": "low"}
    assert issues(spark, avg_load=2001.0, p90_load=3001.0, max_kb=1501.0, slow=1, very_slow=1) == {"slow_average": "high", "slow_p90": "high", "heavy_page": "medium", "slow_pages": "medium", "very_slow_pages": "high"}
    assert issues(spark, nav_links=0, footer=False, https=False, http=True, mixed_pages=4, bad_pages=1) == {"no_navigation": "high", "no_footer_contact": "medium", "http_only": "high", "error_pages": "high"}
    assert issues(spark, robots=False, sitemap=False, mixed_pages=1) == {"no_robots": "low", "no_sitemap": "low", "mixed_content": "medium"}


def test_opportunities_against_all_others(spark):
    names = ["site", "words", "avg_load", "p90_load", "avg_words", "media", "max_kb", "error_pages", "pages"]
    stats = spark.createDataFrame([("me", 100, 130.0, 140.0, 79.0, 6, 40.0, 2, 6), ("x", 121, 100.0, 110.0, 100.0, 9, 20.0, 1, 9), ("y", 151, 200.0, 300.0, 50.0, 1, 30.0, 1, 1)], names)
    grades = spark.createDataFrame([("me", 50, 60, 60, 60), ("x", 61, 70, 60, 71), ("y", 10, 10, 10, 10)], ["site", "overall", "seo", "performance", "structure"])
    got = {r["opportunity"] for r in scores.opportunities(stats, grades, "me").collect()}
    assert got == {"words_by_half", "words_by_a_fifth", "load", "overall", "structure", "avg_words", "pages", "media", "errors", "page_size"}
    assert scores.opportunities(stats.where("site = 'me'"), grades, "me").count() == 0
    empty = stats.withColumn("words", F.when(F.col("site") == "me", 0).otherwise(F.col("words")))
    assert {r["opportunity"] for r in scores.opportunities(empty, grades, "me").collect()} == got - {"words_by_a_fifth"}


def test_image_rules(spark):
    assert issues(spark, modern_image_pages=0, very_large_image_pages=2) == {"no_modern_images": "low", "very_large_images": "medium"}
    html = "<img src=/a.jpg><img src=/b.webp?x=1><img src=/c.png><img src=/c.png>"
    parsed = parse.parse_pages(spark.createDataFrame([(1, "http://a.b/c", html), (2, "http://a.b/d", None)], "page_id long, url string, html string"))
    sizes = spark.createDataFrame([("http://a.b/a.jpg", 500 * 1024 + 1), ("http://a.b/c.png", 10), ("http://a.b/c.png", 1024 * 1024 + 1), ("http://a.b/b.webp?x=1", 500 * 1024)], "img_url string, bytes long")
    found = images.check_images(parsed, sizes)
    assert [tuple(r) for r in found.collect()] == [("http://a.b/c", 1, 2)]
    log = spark.createDataFrame([(1, "http://a.b/c", 200, 1, "raw")], "page_id long, url string, status int, load_time_ms int, render_mode string")
    assert [(r["modern_images"], r["very_large_images"]) for r in flags.page_flags(parsed, log, found).orderBy("page_id").collect()] == [(1, 2), (0, 0)]


def test_comparison_rows(spark):
    names = ["site", "overall", "seo", "performance", "content", "structure", "content_depth", "crawlability", "nav_type", "avg_load", "no_h1"]
    rows = [("me", 50, 60, 60, 60, 60, 50.0, 50.0, "none", 1_500.0, 1), ("x", 56, 57, 40, 60, 60, 45.0, 61.0, "simple_nav", 400.0, 0), ("y", 50, 60, 60, 60, 60, 50.0, 50.0, "none", 1_700.0, 3)]
    got = {(r["site"], r["metric"]): (r["direction"], r["verdict"]) for r in scores.comparison_rows(spark.createDataFrame(rows, names), "me").collect()}
    assert got["x", "overall"] == ("worse", "worse") and got["x", "seo"] == ("neutral", "similar") and got["x", "performance"] == ("better", "much better")
    assert got["x", "avg_load"] == ("worse", "much worse") and got["y", "avg_load"] == ("neutral", "similar") and got["x", "crawlability"] == ("worse", "much worse")
    assert got["x", "nav_type"] == ("different", "different") and got["y", "nav_type"] == ("neutral", "similar") and got["x", "missing_h1"] == ("worse", "worse") and ("y", "missing_h1") not in got
