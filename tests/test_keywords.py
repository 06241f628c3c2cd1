"""Keyword metrics of version 1 against a plain loop over pages."""

import re
from collections import defaultdict

from pyspark.sql import functions as F

from pagewright.operators import keywords, parse

SF = "/root/testdata/sf0.001"
HAND = [
    (1, "http://a.b/red-shoes.html", "<title>Red shoes</title><h1>Fine red shoes</h1><h2>Shoes in red</h2><p>We sell red shoes, and red shoes only, as you see</p><a href='/x'>Red shoes here</a>"),
    (2, "http://a.b/x", "<h2>Red shoes</h2><h2>Red shoes again</h2><p>Nothing at all to be read on this page here</p><a href='http://c.d/'>red shoes</a>"),
    (3, "http://a.b/y", "<p>One pair of shoes is red, the others are not red shoes</p>"),
    (4, "http://a.b/z", None),
    (5, "http://e.f/", "<title>Other</title>"),
]


def norm(text):
    return " ".join(re.sub(r"[^\w]+", " ", (text or "").lower()).split())


def hits(text, phrase):
    return len(re.findall(rf"(?<!\w){re.escape(phrase)}(?!\w)", norm(text)))


def density_score(p):
    if p <= 0:
        return 0.0
    if p < 0.5:
        return p / 0.5 * 50
    if p <= 1.5:
        return 50 + (p - 0.5) * 50
    if p <= 2.5:
        return 100 - (p - 1.5) * 20
    return max(0.0, 80 - (p - 2.5) / 2.5 * 80)


def plain(pages, wanted):
    sites, out = defaultdict(list), {}
    for r in pages:
        sites[r["site"]].append(r)
    for site, phrase in wanted:
        own, found, occurrences, densities, places = sites[site], 0, 0, [], defaultdict(int)
        for r in own:
            words = max(1, sum(len(w) > 2 and w not in keywords.STOPWORDS for w in norm(r["text"]).split()))
            n = hits(r["text"], phrase)
            if n:
                found, occurrences = found + 1, occurrences + n
                densities.append(n * 100 / words)
            slug = re.sub(r"\.[A-Za-z0-9]+$", "", ([s for s in r["url"].split("://")[1].split("?")[0].split("/")[1:] if s] or [""])[-1])
            inner = [x["label"] for x in r["links"] if x["href"].split("://")[1].split("/")[0] == r["site"]]
            head = lambda tag: [h["text"] for h in r["headings"] if h["tag"] == tag]  # noqa: B023, E731
            for place, texts in (("title", [r["title"]]), ("h1", head("h1")), ("h2", head("h2")), ("slug", [slug]), ("anchor", inner)):
                places[place] += any(hits(t, phrase) for t in texts)
        total = len(own)
        share = {"title": 0.3, "h1": 0.2, "h2": 0.2, "slug": 0.15, "anchor": 0.15}
        coverage = 100 * found / total if found else 0.0
        on_page = 100 * sum(w * places[p] / total for p, w in share.items()) if found else 0.0
        mean = sum(densities) / len(densities) if densities else 0.0
        score = density_score(mean) if found else 0.0
        out[site, phrase] = (found, occurrences, *(places[p] for p in share), round(coverage, 6), round(on_page, 6), round(score, 6), round(0.3 * coverage + 0.4 * on_page + 0.3 * score, 6))
    return out


def ours(parsed, wanted, spark):
    rows = keywords.keyword_metrics(parsed, spark.createDataFrame(wanted, "site string, phrase string")).collect()
    cols = ["pages_used", "occurrences", "title_pages", "h1_pages", "h2_pages", "slug_pages", "anchor_pages"]
    return {(r["site"], r["phrase"]): (*(r[c] for c in cols), round(r["coverage"], 6), round(r["on_page"], 6), round(r["density_score"], 6), r["total"]) for r in rows}


def same(got, want):
    assert set(got) == set(want)
    for k, w in want.items():
        assert got[k][:-1] == w[:-1] and abs(got[k][-1] - w[-1]) <= 0.05 + 1e-6, (k, got[k], w)


def test_hand_written_pages(spark):
    parsed = parse.parse_pages(spark.createDataFrame(HAND, "page_id long, url string, html string"))
    wanted = [("a.b", p) for p in ("red shoes", "shoes", "red", "we sell red", "blue", "fine red shoes")] + [("e.f", "other")]
    want = plain(parsed.collect(), wanted)
    same(ours(parsed, wanted, spark), want)
    assert want["a.b", "red shoes"][:7] == (2, 3, 1, 1, 1, 1, 1) and want["a.b", "blue"][-1] == 0 == want["e.f", "other"][-1]


def test_given_pages(spark):
    parsed = parse.parse_pages(spark.read.parquet(f"{SF}/pages.parquet"))
    words = keywords.focus_keywords(parsed, 3).select("site", "phrase").collect()
    wanted = [tuple(r) for r in words] + [(r["site"], w) for r in parsed.select("site", F.split("title", " ").alias("t")).collect()[:10] for w in [norm(r["t"][0])] if w and " " not in w]
    same(ours(parsed, list(set(wanted)), spark), plain(parsed.collect(), set(wanted)))


def test_single_words_stand_behind_few_phrases(spark):
    pages = [
        (1, "http://a.b/", "<title>Walnut tables 2024</title><h1>Walnut</h1><h2>Team</h2>"),
        (2, "http://a.b/x", "<title>Oak</title>"),
        (3, "http://c.d/", "<title>42</title><h2>of the</h2>"),
    ]
    parsed = parse.parse_pages(spark.createDataFrame(pages, "page_id long, url string, html string"))
    rows = keywords.focus_keywords(parsed, 6).orderBy("site", "rank").collect()
    # three phrases, then the words by score; a number and a generic word are none
    assert [r["phrase"] for r in rows] == ["walnut tables 2024", "tables 2024", "walnut tables", "walnut", "oak", "table"]
    assert [r["pages"] for r in rows] == [1, 1, 1, 0, 0, 0] and {r["site"] for r in rows} == {"a.b"}
    assert [r["phrase"] for r in keywords.focus_keywords(parsed, 2).orderBy("rank").collect()] == ["walnut tables 2024", "tables 2024"]
    assert keywords.focus_keywords(parsed.where("false")).count() == 0


def test_a_phrase_counts_on_every_page_of_one_url(spark):
    """Pages of one URL with one text: each counts its own places, for a phrase that ends as it begins as for any other."""
    text = "<p>de de de vin de de de, that is all there is</p>"
    parsed = parse.parse_pages(spark.createDataFrame([(1, "http://a.b/x", text), (2, "http://a.b/x", text)], "page_id long, url string, html string"))
    wanted = [("a.b", p) for p in ("de de", "de de de", "de vin", "vin de de de", "", " de", "de  de")]
    rows = keywords.keyword_metrics(parsed, spark.createDataFrame(wanted, "site string, phrase string")).collect()
    assert {r["phrase"]: r["occurrences"] for r in rows} == {"de de": 4, "de de de": 4, "de vin": 2, "vin de de de": 2, "": 0, " de": 0, "de  de": 0}


def test_phrases_come_in_short_lists(spark):
    wanted = spark.createDataFrame([("a.b", f"p{i}") for i in range(1000)] + [("c.d", "one two")], "site string, phrase string")
    lists = [(r["site"], [p["phrase"] for p in r["phrases"]]) for r in keywords.phrase_lists(wanted).collect()]
    assert sorted(p for s, x in lists if s == "a.b" for p in x) == sorted(f"p{i}" for i in range(1000))
    assert max(len(x) for _, x in lists) < 200 and ("c.d", ["one two"]) in lists
