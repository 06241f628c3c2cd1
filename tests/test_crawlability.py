import pytest
from pagewright.operators import scores


def test_crawlability_has_density_linked_share_and_reach(spark):
    rows = [(10, 4, 4), (10, 10, 5), (10, 30, 10), (10, 60, 10), (10, 200, 10)]
    got = [r["c"] for r in spark.createDataFrame(rows, "pages int, internal int, linked_pages int").select(scores.crawlability().alias("c")).collect()]
    assert got == pytest.approx([13.2, 58.0, 65.67, 88.0, 100.0])
