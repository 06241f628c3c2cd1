"""Pages that share a URL, each with a fetch of its own, against the SQL."""

import duckdb
import pytest
from pyspark.sql import functions as F
from test_four_sites import LONG, page, rows_of

from pagewright.operators import fetches
from pagewright.plans import registry

BODY = page("A title", "<h1>A heading</h1>", f"<p>{LONG}</p>", '<a href="/b">B</a>')
#: Page 7 failed and was slow, 8 with its URL did neither; of 4 and 5, with one URL, one came raw and one by js.
PAGES = [(2, "https://one.example/", BODY), (4, "https://two.example/b", BODY), (5, "https://two.example/b", BODY), (7, "https://two.example/a", BODY), (8, "https://two.example/a", BODY)]
FETCHED = ["page_flags", "site_stats", "overview_stats", "crawl_quality", "issue_page_counts", "issue_urls", "issue_examples", "site_issues", "comparison_rows", "comparison_tables", "page_index"]
SAMPLED = ["sample_aggregate", "performance_summary"]


@pytest.fixture(scope="module")
def sites(spark, tmp_path_factory):
    where = str(tmp_path_factory.mktemp("repeated"))
    spark.createDataFrame(PAGES, "page_id long, url string, html string").coalesce(1).write.parquet(f"{where}/pages.parquet")
    return where


@pytest.mark.parametrize("name", FETCHED + SAMPLED)
def test_pages_of_one_url_equal_their_sql(spark, sites, name):
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW pages AS SELECT * FROM '{sites}/pages.parquet/*.parquet'")
    number = lambda v: float(v) if not isinstance(v, bool) and isinstance(v, int) or type(v).__name__ == "Decimal" else v
    plain = lambda t: type("T", (), {"to_pylist": lambda _: [{k: number(v) for k, v in r.items()} for r in t.to_pylist()]})()
    got = rows_of(plain(registry.QUERIES[name](spark, sites).toArrow()))
    assert got and got == rows_of(plain(duck.sql(registry.ORACLES[name]).to_arrow_table()))


@pytest.mark.parametrize("parts", [1, 3])
def test_samples_of_one_url_have_the_mode_of_the_smallest_page(spark, parts):
    rows = [(p, "s", "u", n, 10 * p + n, p, "js" if p % 5 == 0 else "raw") for p in (4, 9, 5) for n in (0, 1)]
    df = spark.createDataFrame(rows, "page_id long, site string, url string, sample_no int, load_ms int, ttfb_ms int, render_mode string")
    assert [r["render_mode"] for r in fetches.sample_aggregate(df.repartition(parts, F.col("page_id"))).collect()] == ["raw"]
