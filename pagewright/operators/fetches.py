"""The fetch log, load-time statistics and crawl quality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import extract_emails, extract_phones
from pagewright.functions.urls import url_path

from .flags import is_bad


def fetch_log(pages: DataFrame) -> DataFrame:
    """A fetch log for a page table without one, by arithmetic on page_id."""
    return pages.select(
        "page_id",
        F.lower(F.regexp_extract("url", r"^https?://([^/?#]+)", 1)).alias("site"),
        "url",
        F.expr("case when page_id % 29 = 7 then 404 when page_id % 31 = 11 then 503 when page_id % 97 = 13 then 410 else 200 end").alias("status"),
        F.expr("120 + (page_id * 7919) % 3700").alias("load_time_ms"),
        F.expr("20 + (page_id * 104729) % 180").alias("ttfb_ms"),
        F.expr("if(page_id % 5 = 0, 'js', 'raw')").alias("render_mode"),
        F.octet_length("html").cast("bigint").alias("content_length_bytes"),
    )


def page_statuses(fetch: DataFrame) -> DataFrame:
    """What every second page itself recorded as its status, by arithmetic on page_id: some moved, some gone since."""
    status = F.expr("case when page_id % 6 = 0 then 301 when page_id % 10 = 4 then 410 else status end")
    return fetch.where("page_id % 2 = 0").select("site", "url", status.alias("status"), "page_id")


def samples(fetch: DataFrame, n: int = 3) -> DataFrame:
    """``n`` load samples per page, 37 ms apart."""
    rows = fetch.withColumn("sample_no", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    return rows.withColumn("load_ms", F.col("load_time_ms") + 37 * F.col("sample_no"))


def load_stats(col: str) -> list[Column]:
    q = lambda p: F.percentile(col, F.lit(p))
    return [
        F.avg(col).alias("mean"), F.median(col).alias("median"), q(0.75).alias("p75"), q(0.9).alias("p90"), F.min(col).cast("double").alias("min"), F.max(col).cast("double").alias("max"),
        F.coalesce(F.stddev_samp(col), F.lit(0.0)).alias("stdev"), F.count(col).alias("n"),
    ]


def consistency(n: Column, mean: Column, stdev: Column) -> Column:
    return F.when((n < 5) | (mean <= 0), "unknown").when(stdev / mean > 0.4, "unstable").when(stdev / mean > 0.2, "moderate").otherwise("stable")


def load_time_stats(fetch: DataFrame) -> DataFrame:
    """Per site, over pages fetched with status 200."""
    rows = fetch.where("status = 200").groupBy("site").agg(*load_stats("load_time_ms"))
    return rows.withColumn("consistency", consistency(F.col("n"), F.col("mean"), F.col("stdev")))


def sample_aggregate(sampled: DataFrame) -> DataFrame:
    """Per URL over all its samples; the render mode is that of the first one, on pages of one URL that of the smallest page_id."""
    return sampled.groupBy("site", "url").agg(
        F.count("load_ms").alias("n"), F.avg("load_ms").alias("mean_load"), F.median("load_ms").alias("median_load"), F.min("load_ms").alias("min_load"), F.max("load_ms").alias("max_load"),
        F.coalesce(F.stddev_samp("load_ms"), F.lit(0.0)).alias("stdev_load"), F.avg("ttfb_ms").alias("avg_ttfb"), F.min_by("render_mode", F.struct("sample_no", "page_id")).alias("render_mode"),
    )


def performance_summary(sampled: DataFrame) -> DataFrame:
    """Per site over the means of pages with status 200: overall, raw and js; fastest and slowest page."""
    ok = sampled.where("status = 200")
    pages = sample_aggregate(ok)
    mode = lambda m: F.when(F.col("render_mode") == m, F.col("mean_load"))
    stats = pages.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.avg("mean_load").alias("mean"), F.percentile("mean_load", F.lit(0.9)).alias("p90"), F.coalesce(F.stddev_samp("mean_load"), F.lit(0.0)).alias("stdev"),
        F.avg(mode("raw")).alias("raw_mean"), F.avg(mode("js")).alias("js_mean"),
        F.min_by("url", F.struct("mean_load", "url")).alias("fastest"), F.max_by("url", F.struct("mean_load", "url")).alias("slowest"),
    )
    return stats.withColumn("consistency", consistency(F.col("pages"), F.col("mean"), F.col("stdev")))


def status_histogram(fetch: DataFrame) -> DataFrame:
    return fetch.groupBy("site", F.col("status").cast("string").alias("status")).agg(F.count(F.lit(1)).alias("pages"))


def site_stats(flags: DataFrame) -> DataFrame:
    """One shuffle by site over the page flags."""
    n = F.count(F.lit(1))
    load, q = F.col("load_time_ms"), lambda p: F.percentile("load_time_ms", F.lit(p))
    share = lambda c: F.count_if(c) / n
    return flags.groupBy("site").agg(
        n.alias("pages"), F.sum("words").alias("words"), F.avg("words").alias("avg_words"), F.sum("n_images").alias("media"), F.sum("n_links").alias("links"), F.sum("n_internal").alias("internal_links"),
        F.avg("load_time_ms").alias("avg_load"), F.median("load_time_ms").alias("median_load"), q(0.9).alias("p90_load"), q(0.95).alias("p95_load"),
        F.count_if(load > 1500).alias("slow"), F.count_if(load > 3000).alias("very_slow"),
        (F.avg("content_length_bytes") / 1024).alias("avg_kb"), (F.max("content_length_bytes") / 1024).alias("max_kb"), F.count_if("bad").alias("bad_pages"), F.count_if(F.col("status") >= 400).alias("error_pages"),
        share(F.col("missing_title")).alias("missing_title"), share(F.col("missing_h1")).alias("missing_h1"),
    )


def page_type_breakdown(flags: DataFrame) -> DataFrame:
    return flags.groupBy("site", "page_type").agg(F.count(F.lit(1)).alias("pages"))


def crawl_quality(flags: DataFrame, broken: DataFrame) -> DataFrame:
    """15 measures and the overall health of each site; ``broken(site, url, broken)`` from ``links``. A footer counts as found
    if it holds a labelled link, a link to a social platform, an e-mail address or a phone number."""
    b = broken.groupBy("site").agg(F.sum("broken").alias("broken_links"))
    kind = lambda t: F.count_if(F.col("page_type") == t)
    important = F.col("page_type").isin("article", "landing", "generic")
    footer = (F.col("footer_links") > 0) | F.col("footer_social") | (F.size(extract_emails(F.col("footer_text"))) + F.size(extract_phones(F.col("footer_text"))) > 0)
    agg = flags.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages_crawled"), F.countDistinct(url_path(F.col("url"))).alias("unique_paths"), F.bround(F.avg("load_time_ms")).cast("int").alias("avg_load"), F.bround(F.percentile("load_time_ms", F.lit(0.9))).cast("int").alias("p90_load"),
        kind("catalog").alias("catalog_pages"), kind("article").alias("article_pages"), kind("landing").alias("landing_pages"), kind("utility").alias("utility_pages"), F.count_if(F.col("status") == 404).alias("pages_404"),
        F.count_if(F.col("thin").isNotNull() & important).alias("thin_important"), F.count_if(F.col("thin").isNotNull() & ~important).alias("thin_catalog"),
        (F.max("nav_links") > 0).alias("nav_found"), F.bool_or(footer).alias("footer_found"),
    )
    n = F.col("pages_crawled")
    rows = agg.join(b, "site", "left").withColumn("broken_links", F.coalesce("broken_links", F.lit(0))).withColumn("duplicates", n - F.col("unique_paths"))
    health = (
        F.when((n < 10) | ~F.col("nav_found") | (F.col("pages_404") / n * 100 > 25), "BAD")
        .when((F.col("thin_important") / n * 100 > 20) | (F.col("duplicates") > n * 0.1) | ((F.col("article_pages") + F.col("landing_pages") == 0) & (n > 5)), "WARNING")
        .otherwise("GOOD")
    )
    return rows.withColumn("overall_health", health)


def overview_stats(flags: DataFrame) -> DataFrame:
    return flags.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"), F.count_if(F.col("status") == 200).alias("ok"), F.count_if(F.col("status") >= 400).alias("failed"), F.avg("load_time_ms").alias("avg_load"),
        F.min("load_time_ms").alias("fastest"), F.max("load_time_ms").alias("slowest"), F.count_if("missing_title").alias("no_title"), F.count_if(F.col("words") < 50).alias("few_words"), F.count_if(F.col("n_images") == 0).alias("no_media"),
    )


def error_rollup(fetch: DataFrame) -> DataFrame:
    """Per site and status of failed pages: how many, and their share of all pages."""
    total = fetch.groupBy("site").agg(F.count(F.lit(1)).alias("pages"))
    bad = fetch.where(is_bad(F.col("status"))).groupBy("site", "status").agg(F.count(F.lit(1)).alias("errors"))
    return bad.join(total, "site").select("site", "status", "errors", (F.col("errors") * 100 / F.col("pages")).alias("rate"))
