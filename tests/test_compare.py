"""Sites side by side and service rollups on small tables."""

from pagewright.operators import compare, parse, rollups


def test_services_are_named_by_the_first_heading(spark):
    page = lambda heads, text: "".join(f"<h2>{h}</h2>" for h in heads) + f"<p>{text}, and more words so that it counts</p>"
    rows = [
        (1, "http://a.b/1", page(["About us", "Roof Repair", "Repair again"], "We do repair")),
        (2, "http://a.b/2", page(["Roof Repair"], "REPAIR and design, all day")),
        (3, "http://a.b/3", page(["Support services"], "Our services and support")),  # service, services and support
        (4, "http://a.b/4", page(["Design"], "nothing of the kind")),
        (5, "http://e.f/1", None),
    ]
    parsed = parse.parse_pages(spark.createDataFrame(rows, "page_id long, url string, html string"))
    got = [tuple(r) for r in rollups.rollup_services(parsed).select("site", "service", "pages", "confidence", "rank").orderBy("rank").collect()]
    assert got == [("a.b", "Support services", 3, 0.3, 1), ("a.b", "Roof Repair", 2, 0.2, 2)]
    assert [r["service"] for r in rollups.rollup_services(parsed, 1).collect()] == ["Support services"]
    assert rollups.rollup_services(parsed.where("false")).count() == 0


def test_issue_page_counts(spark):
    kind = "site string, noindex boolean, no_viewport boolean, status int, words int"
    rows = [("a", True, False, 200, 900), ("a", False, True, 404, 700), ("a", None, True, None, None), ("b", False, False, 503, 0), *[("c", False, False, 200, 300)] * 6]
    got = {r["site"]: r for r in compare.issue_page_counts(spark.createDataFrame(rows, kind), sitemap=False).collect()}
    a = got["a"]
    assert (a["pages"], a["noindex_pages"], a["no_viewport_pages"], a["error_pages"], a["long_form_pages"], a["long_form_estimate"]) == (3, 1, 2, 1, 2, 2)
    assert got["b"]["long_form_estimate"] == 0 and got["b"]["error_pages"] == 1
    assert got["c"]["long_form_estimate"] == 2 and got["c"]["long_form_pages"] == 0
    assert a["no_sitemap"] and not a["no_robots"]


def test_tables_hold_every_measure_of_every_site(spark):
    stats = [(s, *[float(i) for i in range(9)]) for s in ("a", "b", "unscored")]
    names = [*compare.SECTIONS["performance"], *compare.SECTIONS["content"]]
    stats = spark.createDataFrame(stats, "site string, " + ", ".join(f"{n} double" for n in names))
    scores = spark.createDataFrame([("a", 1, 2, 3, 4, 5), ("b", 1, 2, 3, 4, None)], "site string, " + ", ".join(f"{n} int" for n in compare.SECTIONS["score"]))
    got = {(r["section"], r["metric"], r["site"]): r["value"] for r in compare.comparison_tables(stats, scores).collect()}
    assert len(got) == 2 * 14 and got["score", "overall", "a"] == 1.0 and got["score", "structure", "b"] is None
    assert got["content", "pages", "b"] == 8.0 and got["performance", "avg_load", "a"] == 0.0
