"""Site scores, issues and the report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import clamp_0_100, extract_emails, extract_phones


def minus(*rules: tuple[Column, int]) -> Column:
    """100 less the points of every rule that holds."""
    out = F.lit(100)
    for rule, points in rules:
        out = out - F.when(rule, points).otherwise(0)
    return clamp_0_100(out)


def site_counts(flags: DataFrame, broken: DataFrame) -> DataFrame:
    """Everything that scores and issues need, in one shuffle by site; ``broken(site, url, broken)``."""
    rows = flags.join(broken.select("url", "broken"), "url", "left").withColumn("broken", F.coalesce("broken", F.lit(0)))
    important = F.col("page_type").isin("article", "landing", "generic")
    c = F.count_if
    load = F.col("load_time_ms")
    return rows.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), c("missing_title").alias("no_title"), c("missing_description").alias("no_description"), c("missing_h1").alias("no_h1"), c(F.col("broken") > 0).alias("broken_pages"),
        c(F.col("missing_alt") > 0).alias("alt_pages"), c("noindex").alias("noindex_pages"), c("no_viewport").alias("no_viewport_pages"), c("mixed_content").alias("mixed_pages"), c("deep_url").alias("deep_pages"), c("bad").alias("bad_pages"),
        c(important & (F.col("thin") == "very_thin")).alias("very_thin"), c(important & (F.col("thin") == "thin")).alias("thin_pages"), c(~important & F.col("thin").isNotNull()).alias("low_text"), c(important).alias("important"), F.avg(F.when(important, F.col("words"))).alias("avg_words_important"), F.avg("words").alias("avg_words"),
        F.avg("load_time_ms").alias("avg_load"), F.percentile("load_time_ms", F.lit(0.9)).alias("p90_load"), c(load > 1500).alias("slow"), c(load > 3000).alias("very_slow"), (F.max("content_length_bytes") / 1024).alias("max_kb"),
        F.max("nav_links").alias("nav_links"), F.sum("n_internal").alias("internal"), c(F.col("n_internal") > 0).alias("linked_pages"), (c(F.col("url").startswith("https://")) > 0).alias("https"),
        F.bool_or((F.size(extract_emails(F.col("footer_text"))) + F.size(extract_phones(F.col("footer_text"))) > 0) | F.col("footer_social")).alias("footer"), F.sum("broken").alias("broken_links"), (c(F.col("url").startswith("http://")) > 0).alias("http"), c(F.col("very_large_images") > 0).alias("very_large_image_pages"), c(F.col("modern_images") > 0).alias("modern_image_pages"), F.sum("n_headings").alias("headings"), c((F.col("n_headings") > 0) | (F.col("title") != "")).alias("headed_pages"), F.sum(F.col("words")).alias("words"),
    )


def nav_type() -> Column:
    n, nav = F.col("pages"), F.col("nav_links")
    return F.when((n <= 5) & (nav == 0), "single_page").when(nav >= 5, "multi_section").when(nav > 0, "simple_nav").when(F.col("internal") > n * 3, "implicit_content_links").when((n > 20) & (nav < 3), "app_style").otherwise("none_detected")


def words_curve(avg: Column) -> Column:
    return F.when(avg <= 0, 0.0).when(avg < 100, avg / 100 * 30).when(avg < 300, 30 + (avg - 100) / 200 * 40).when(avg <= 2000, 70 + (avg - 300) / 1700 * 30).otherwise(100.0)


def crawlability(fixed: bool = False) -> Column:
    """Link density, share of pages with links, and reach. From half a link a page to 2 the density keeps the reference
    behaviour, up to 200, and is 0 below, unless ``fixed``: then linear up to 50. The sum is clamped."""
    per = F.col("internal") / F.col("pages")
    low = per / 2 * 50 if fixed else F.when(per >= 0.5, per / 0.5 * 50).otherwise(0.0)
    density = F.when(per < 2, low).when(per < 5, 50 + (per - 2) / 3 * 50).otherwise(100.0)
    linked = F.col("linked_pages") / F.col("pages") * 100
    reach = F.least(per / 10 * 100, F.lit(100.0))
    return F.round(clamp_0_100(0.4 * density + 0.3 * linked + 0.3 * reach), 2)


def site_scores(counts: DataFrame, robots: bool = True, sitemap: bool = True) -> DataFrame:
    """``site_counts`` -> the four category scores, their mean, content depth, crawlability and nav type.

    Uniqueness enters content depth at 100 unless the column ``unique_ratio`` is there.
    """
    n = F.col("pages")
    r = lambda c: F.col(c) / n
    i = lambda c: F.col(c) / F.when(F.col("important") > 0, F.col("important")).otherwise(n)
    seo = minus(
        (r("no_title") >= 0.1, 10), (r("no_title") > 0.3, 10), (r("no_description") >= 0.1, 10), (r("no_description") > 0.3, 10), (r("no_h1") >= 0.1, 5), (r("no_h1") > 0.3, 10),
        (F.col("broken_pages") > 0, 5), (F.col("broken_pages") > 10, 10), (r("alt_pages") >= 0.3, 10), ((r("alt_pages") >= 0.1) & (r("alt_pages") < 0.3), 5), ((F.col("alt_pages") > 0) & (r("alt_pages") < 0.1), 2),
        (r("noindex_pages") > 0.3, 5), (F.lit(not robots), 2), (F.lit(not sitemap), 2),
    )
    load, p90, slow, kb = F.col("avg_load"), F.col("p90_load"), F.col("slow"), F.col("max_kb")
    performance = minus((load > 1000, 5), (load > 2000, 10), (p90 > 2000, 5), (p90 > 3000, 10), (slow > 0, 5), (slow > 3, 5), (F.col("very_slow") > 0, 10), (kb > 1024, 5), (kb > 2048, 10), (r("very_large_image_pages") > 0.2, 5))
    words = F.coalesce("avg_words_important", "avg_words")
    content = minus((i("very_thin") > 0.1, 10), (i("very_thin") > 0.3, 10), (i("thin_pages") > 0.2, 5), (i("thin_pages") > 0.4, 10), (words < 200, 5), (words < 100, 10))
    structure = minus((F.col("nav_links") == 0, 15), (~F.col("footer"), 10), (F.col("bad_pages") > 0, 5), (F.col("bad_pages") > 5, 10), (F.col("deep_pages") > 0, 5), (~F.col("https"), 10), (F.col("mixed_pages") > 0, 5), (r("no_viewport_pages") > 0.3, 5))
    unique = F.col("unique_ratio") if "unique_ratio" in counts.columns else F.lit(100.0)
    cover = clamp_0_100(r("headed_pages") * 60 + F.least(F.col("headings") / n / 5, F.lit(1.0)) * 40)
    depth = clamp_0_100(0.5 * words_curve(F.col("avg_words")) + 0.3 * unique + 0.2 * cover)
    rows = counts.select("site", "pages", seo.alias("seo"), performance.alias("performance"), content.alias("c"), structure.alias("s"), depth.alias("content_depth"), crawlability().alias("crawlability"), nav_type().alias("nav_type"), "avg_load", "no_h1")
    rows = rows.withColumn("content", clamp_0_100(F.bround(0.7 * F.col("c") + 0.3 * F.col("content_depth")).cast("int"))).withColumn("structure", clamp_0_100(F.bround(0.8 * F.col("s") + 0.2 * F.col("crawlability")).cast("int")))
    four = F.col("seo") + F.col("performance") + F.col("content") + F.col("structure")
    return rows.withColumn("overall", F.bround(four / 4).cast("int")).drop("c", "s")


def issue_rules(robots: bool = True, sitemap: bool = True) -> list[tuple[str, str, Column, Column]]:
    """Issue, category, pages affected (0: the issue isn't there) and severity. Issues of the site as a whole affect no
    single page and count all of them."""
    n, col = F.col("pages"), F.col
    always = F.lit
    graded = lambda name, share, above, below: F.when(col(name) / n > share, above).otherwise(below)
    whole = lambda found: F.when(found, n).otherwise(0)
    words = F.coalesce("avg_words_important", "avg_words")
    return [
        ("missing_title", "seo", col("no_title"), graded("no_title", 0.2, "high", "medium")),
        ("missing_description", "seo", col("no_description"), graded("no_description", 0.2, "high", "medium")),
        ("missing_h1", "seo", col("no_h1"), graded("no_h1", 0.1, "medium", "low")),
        ("missing_alt", "seo", col("alt_pages"), always("medium")),
        ("noindex", "seo", col("noindex_pages"), always("medium")),
        ("no_robots", "seo", whole(F.lit(not robots)), always("low")),
        ("no_sitemap", "seo", whole(F.lit(not sitemap)), always("low")),
        ("very_thin_content", "content", col("very_thin"), always("high")),
        ("thin_content", "content", col("thin_pages"), always("medium")),
        ("low_text_catalog", "content", col("low_text"), always("low")),
        ("low_average_words", "content", whole((words < 200) & (col("important") > 0)), always("low")),
        ("slow_average", "performance", whole(col("avg_load") > 2000), always("high")),
        ("slow_p90", "performance", whole(col("p90_load") > 3000), always("high")),
        ("very_slow_pages", "performance", col("very_slow"), always("high")),
        ("slow_pages", "performance", col("slow"), always("medium")),
        ("heavy_page", "performance", whole(col("max_kb") > 1500), always("medium")),
        ("very_large_images", "performance", col("very_large_image_pages"), always("medium")),
        ("no_modern_images", "performance", whole(col("modern_image_pages") == 0), always("low")),
        ("no_navigation", "structure", whole(col("nav_links") == 0), always("high")),
        ("no_footer_contact", "structure", whole(~col("footer")), always("medium")),
        ("deep_urls", "structure", F.when(col("deep_pages") > n * 0.2, col("deep_pages")).otherwise(0), always("low")),
        ("http_only", "structure", whole(col("http") & ~col("https")), always("high")),
        ("mixed_content", "structure", F.when(col("https"), col("mixed_pages")).otherwise(0), always("medium")),
        ("no_viewport", "structure", col("no_viewport_pages"), always("medium")),
        ("broken_links", "structure", col("broken_pages"), F.when(col("broken_links") > 10, "high").otherwise("medium")),
        ("error_pages", "structure", col("bad_pages"), always("high")),
    ]


def site_issues(counts: DataFrame, robots: bool = True, sitemap: bool = True) -> DataFrame:
    """One row per site and issue that it shows."""
    rules = issue_rules(robots, sitemap)
    each = F.array(*[F.struct(F.lit(i).alias("issue"), F.lit(c).alias("category"), hit.cast("bigint").alias("affected"), grade.alias("severity")) for i, c, hit, grade in rules])
    return counts.select("site", "pages", F.explode(each).alias("i")).select("site", "pages", "i.*").where("affected > 0")


def top_issues(issues: DataFrame, k: int = 5) -> DataFrame:
    """The ``k`` gravest issues of each site: by severity, then pages affected, then name."""
    grade = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    order = Window.partitionBy("site").orderBy(grade, F.desc("affected"), "issue")
    return issues.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def comparison_rows(scores: DataFrame, primary: str) -> DataFrame:
    """The primary site against every other, metric by metric: both values, the difference, direction and verdict.

    Of load times the lower is better, of missing h1 too, which only stands where the sites differ (0 or 1: no page or
    some); navigation types are equal or different and have no difference. Fixed values: from which gap on a metric is no
    longer neutral.
    """
    gaps = {"overall": 5.0, "seo": 3.0, "performance": 3.0, "content": 3.0, "structure": 3.0, "avg_load": 200.0, "content_depth": 5.0, "crawlability": 10.0, "missing_h1": 0.5}
    value = lambda m: F.when(F.col("no_h1") > 0, 1.0).otherwise(0.0) if m == "missing_h1" else F.col(m).cast("double")
    each = [F.struct(F.lit(m).alias("metric"), value(m).alias("value"), F.lit(None).cast("string").alias("name")) for m in gaps]
    each.append(F.struct(F.lit("nav_type").alias("metric"), F.lit(None).cast("double").alias("value"), F.col("nav_type").alias("name")))
    long = scores.select("site", F.explode(F.array(*each)).alias("m")).select("site", "m.*")
    mine = long.where(F.col("site") == primary).select("metric", F.col("value").alias("primary_value"), F.col("name").alias("primary_name"))
    rows = long.where(F.col("site") != primary).join(F.broadcast(mine), "metric")  # one row per metric
    gap = F.col("primary_value") - F.col("value")
    good = F.when(F.col("metric").isin("avg_load", "missing_h1"), -gap).otherwise(gap)
    close = F.create_map(*[F.lit(x) for pair in gaps.items() for x in pair])[F.col("metric")]
    same_name = F.when(F.col("primary_name") == F.col("name"), "neutral").otherwise("different")
    direction = F.when(F.col("metric") == "nav_type", same_name).when(F.abs(good) <= close, "neutral").when(good > 0, "better").otherwise("worse")
    far = F.abs(good) >= F.when(F.col("metric") == "avg_load", 1000.0).otherwise(10.0)
    verdict = F.when(F.col("direction") == "neutral", "similar").when(far & F.col("direction").isin("better", "worse"), F.concat(F.lit("much "), F.col("direction"))).otherwise(F.col("direction"))
    rows = rows.withColumn("difference", gap).withColumn("direction", direction).where("metric <> 'missing_h1' or difference <> 0")
    return rows.select("site", "metric", "primary_value", F.col("value").alias("competitor_value"), "difference", F.coalesce("primary_name", F.lit("")).alias("primary_name"), F.coalesce("name", F.lit("")).alias("competitor_name"), "direction", verdict.alias("verdict"))


def opportunities(stats: DataFrame, scores: DataFrame, primary: str) -> DataFrame:
    """Gaps of the primary site against all others (``site_stats``, ``site_scores``); no row without another site."""
    measures = ["words", "avg_load", "p90_load", "avg_words", "media", "max_kb", "error_pages", "pages"]
    grades = ["overall", "seo", "performance", "structure"]
    rows = stats.select("site", *measures).join(scores.select("site", *grades), "site")
    one = rows.where(F.col("site") == primary).select(F.col("site").alias("mine"), *[F.col(c).alias(f"p_{c}") for c in (*measures, *grades)])
    both = rows.where(F.col("site") != primary).crossJoin(F.broadcast(one))  # one row
    p, col = lambda c: F.col(f"p_{c}"), F.col
    rules = [
        ("words_by_half", F.bool_or(col("words") > 1.5 * p("words"))), ("words_by_a_fifth", F.bool_or((col("words") > 1.2 * p("words")) & (col("words") <= 1.5 * p("words")))),
        ("load", F.first(p("avg_load")) > 1.2 * F.min("avg_load")), ("p90", F.first(p("p90_load")) > 1.3 * F.min("p90_load")),
        *[(c, F.first(p(c)) < F.max(c) - 10) for c in grades],
        ("avg_words", F.first(p("avg_words")) < 0.8 * F.max("avg_words")), ("pages", F.first(p("pages")) < 0.7 * F.max("pages")),
        ("media", F.first(p("media")) < 0.7 * F.max("media")), ("errors", F.first(p("error_pages")) > F.max("error_pages")),
        ("page_size", F.first(p("max_kb")) > 1.5 * F.avg("max_kb")),
    ]
    found = both.groupBy(F.col("mine").alias("site")).agg(*[rule.alias(name) for name, rule in rules])
    names = F.array_compact(F.array(*[F.when(F.col(name), F.lit(name)) for name, _ in rules]))
    return found.select("site", F.explode(names).alias("opportunity"))
