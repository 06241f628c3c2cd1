"""Every query of the library by name; ``oracles`` has the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pagewright.functions import text as X
from pagewright.functions import urls as U
from pagewright.operators import articles, brand, claims, compare, crawl, entities, fetches, flags, keywords, links, main_text, overrides, parse, regions, report, rollups, scores, titles
from pagewright.operators import near_duplicates as near
from pagewright.plans.oracles import ORACLES  # noqa: F401
from pagewright.sources import files
from pagewright.sources.shared import written
from pagewright.streaming import blocks, index
from pagewright.streaming import fetches as stream


class Tables:
    """The driver's tables and what is derived from them, built lazily."""

    def __init__(self, spark: SparkSession, sf_dir: str, parse_once: bool = False) -> None:
        self.spark, self.dir, self.parse_once, self._parsed = spark, sf_dir, parse_once, None

    def read(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.dir}/{name}.parquet")

    pages = property(lambda s: files.read_pages(s.spark, f"{s.dir}/pages.parquet"))
    docs = property(lambda s: s.read("documents"))

    @property
    def parsed(self) -> DataFrame:
        """The parsed pages; for queries that read them several times a table of the shared folder."""
        if self._parsed is None:
            rows = parse.parse_pages(self.pages)
            self._parsed = written(rows, "parsed") if self.parse_once else rows
        return self._parsed

    fetch = property(lambda s: fetches.fetch_log(s.pages))
    samples = property(lambda s: fetches.samples(s.fetch))
    flags = property(lambda s: flags.page_flags(s.parsed, s.fetch))
    links = property(lambda s: parse.page_links(s.parsed))
    broken = property(lambda s: links.broken_by_page(s.links, s.fetch))
    unique = property(lambda s: near.unique_content_ratio(written(near.fingerprints(near.page_content(s.parsed)), "prints")))
    prints = property(lambda s: written(near.fingerprints(s.docs.select(F.col("source").alias("site"), F.col("doc_id").alias("id"), "text")), "prints"))

    @property
    def counts(self) -> DataFrame:
        rows = scores.site_counts(self.flags, self.broken).join(self.unique.select("site", "unique_ratio"), "site", "left")
        return rows.withColumn("unique_ratio", F.coalesce("unique_ratio", F.lit(100.0)))

    stats = property(lambda s: fetches.site_stats(s.flags))
    edges = property(lambda s: links.link_edges(s.links))


def _first_site(t: Tables) -> str:
    """The site with the most pages, the first by name of those."""
    return t.fetch.groupBy("site").count().orderBy(F.desc("count"), "site").first()["site"]


def _url_functions(t: Tables) -> DataFrame:
    u = F.col("url")
    return t.pages.select("page_id", U.url_host(u).alias("host"), U.url_path(u).alias("path"), F.size(U.path_segments(u)).alias("segments"), U.drop_fragment(u).alias("light"), rollups.page_id(u).alias("pid"))


def _keyword_metrics(t: Tables) -> DataFrame:
    parsed = t.parsed
    return keywords.keyword_metrics(parsed, keywords.focus_keywords(parsed).select("site", "phrase"))


def _keyword_metrics_v2(t: Tables) -> DataFrame:
    parsed = t.parsed
    return keywords.keyword_metrics_v2(parsed, keywords.focus_keywords(parsed).select("site", "phrase"))


def _reachable(t: Tables) -> DataFrame:
    starts = t.pages.groupBy(U.url_host(F.col("url")).alias("site")).agg(F.min(U.drop_fragment(F.col("url"))).alias("url"))
    return links.reachable_within(t.edges, starts)


def _content_types(t: Tables) -> DataFrame:
    """By the URL alone, as the page table has no headers."""
    return t.pages.select(U.url_host(F.col("url")).alias("site"), parse.classify_content_type(F.lit(None).cast("string"), F.col("url")).alias("content_type"))


def _crawl_order(t: Tables) -> DataFrame:
    starts = t.pages.select(U.url_host(F.col("url")).alias("site"), U.drop_fragment(F.col("url")).alias("url"))
    return crawl.crawl_order(written(crawl.ordered_edges(t.links), "edges"), starts)


def _claims(t: Tables) -> DataFrame:
    parsed = t.parsed
    items = [claims.claims(entities.extract_items(parsed, (k,)), "Business", f"{k.title()}s", F.col("title"), F.col("title"), F.col("confidence"), k) for k in ("service", "product", "team")]
    places = claims.claims(entities.extract_locations(parsed), "Business", "Locations", F.col("name"), "address", F.col("confidence"), "location")
    return reduce(DataFrame.unionByName, [claims.profile_claims(t.flags), *items, places, claims.media_claims(parse.page_images(parsed))])


def _overrides(t: Tables) -> DataFrame:
    """Page types as users would have set them, by arithmetic on page_id: two rounds in January 2024, some after the run of
    the 15th, some of no known type."""
    kinds = F.array(*[F.lit(k) for k in [*overrides.PAGE_TYPES, "homepage"]])
    day = lambda n: F.timestamp_seconds(F.lit(1_704_067_200) + 86_400 * n)
    p = F.col("page_id")
    one = t.pages.where("page_id % 4 = 1").select("page_id", F.element_at(kinds, (p % 9 + 1).cast("int")).alias("page_type"), day(p % 20).alias("set_at"), F.lit(0).alias("seq"))
    two = t.pages.where("page_id % 6 = 1").select("page_id", F.element_at(kinds, ((p + 3) % 9 + 1).cast("int")).alias("page_type"), day(4 + p % 15).alias("set_at"), F.lit(1).alias("seq"))
    return one.unionByName(two)


def _override_page_type(t: Tables) -> DataFrame:
    run = t.flags.select("page_id", "page_type", F.timestamp_seconds(F.lit(1_704_067_200 + 86_400 * 14)).alias("run_at"))
    return overrides.override_page_type(run, _overrides(t)).withColumn("set_at", F.date_format("set_at", "yyyy-MM-dd"))


def _insight_report(t: Tables) -> DataFrame:
    counts = written(t.counts, "counts")
    examples = report.issue_examples(report.issue_urls(report.page_issues(t.flags, t.broken)))
    rows = report.insight_report(scores.site_scores(counts), scores.site_issues(counts), examples, keywords.focus_keywords(t.parsed))
    return rows.withColumns({c: F.to_json(c) for c in ("categories", "issues", "phrases")})


def _progress(t: Tables) -> DataFrame:
    return stream.progress_counts(stream.fetch_rows(t.read("events")))


_BUILD: dict[str, Callable[[Tables], DataFrame]] = {
    "site_stats": lambda t: t.stats,
    "url_functions": _url_functions,
    "parse_pages": lambda t: t.parsed.select("page_id", "site", "title", "h1", "description", "words", "n_links", "n_internal", "n_images", "nav_links", F.size("paragraphs").alias("n_paragraphs"), F.size("headings").alias("n_headings")),
    "page_links": lambda t: t.links,
    "page_headings": lambda t: parse.page_headings(t.parsed),
    "page_paragraphs": lambda t: parse.page_paragraphs(t.parsed),
    "page_images": lambda t: parse.page_images(t.parsed),
    "page_videos": lambda t: parse.page_videos(t.parsed),
    "page_jsonld": lambda t: parse.page_jsonld(t.parsed),
    "hero_content": lambda t: articles.hero_content(t.parsed),
    "page_files": lambda t: parse.page_files(t.parsed),
    "page_flags": lambda t: t.flags.select("page_id", "page_type", "cards", "bad", "missing_title", "missing_description", "missing_h1", "noindex", "no_viewport", "mixed_content", "deep_url", "thin"),
    "page_type_breakdown": lambda t: fetches.page_type_breakdown(t.flags),
    "load_time_stats": lambda t: fetches.load_time_stats(t.fetch),
    "sample_aggregate": lambda t: fetches.sample_aggregate(t.samples),
    "performance_summary": lambda t: fetches.performance_summary(t.samples),
    "status_histogram": lambda t: fetches.status_histogram(t.fetch),
    "overview_stats": lambda t: fetches.overview_stats(t.flags),
    "error_rollup": lambda t: fetches.error_rollup(t.fetch),
    "crawl_quality": lambda t: fetches.crawl_quality(t.flags, t.broken),
    "block_pages": lambda t: t.pages.join(t.fetch.select("page_id", "status"), "page_id").select("page_id", parse.classify_block_page(F.col("status"), F.col("html")).alias("reason")).where("reason is not null"),
    "status_map": lambda t: links.status_map(t.fetch, fetches.page_statuses(t.fetch)),
    "broken_internal_links": lambda t: links.broken_internal_links(t.links, t.fetch),
    "uncrawled_links": lambda t: links.uncrawled_links(t.links, t.fetch),
    "pages_with_broken": lambda t: links.pages_with_broken(t.fetch.select("site", "url"), t.broken),
    "link_degree": lambda t: links.link_degree(t.edges, t.fetch),
    "reachable_within": _reachable,
    "follow_links": lambda t: links.follow_links(t.links, _reachable(t)),
    "nav_rollup": lambda t: links.nav_rollup(t.links),
    "site_scores": lambda t: scores.site_scores(t.counts),
    "site_issues": lambda t: scores.site_issues(t.counts),
    "top_issues": lambda t: scores.top_issues(scores.site_issues(t.counts)),
    "comparison_rows": lambda t: scores.comparison_rows(scores.site_scores(t.counts), _first_site(t)),
    "comparison_tables": lambda t: compare.comparison_tables(t.stats, scores.site_scores(t.counts)),
    "issue_page_counts": lambda t: compare.issue_page_counts(t.flags),
    "opportunities": lambda t: scores.opportunities(t.stats, scores.site_scores(t.counts), _first_site(t)),
    "phrase_scores": lambda t: keywords.phrase_scores(t.parsed),
    "focus_keywords": lambda t: keywords.focus_keywords(t.parsed),
    "keyword_metrics": _keyword_metrics,
    "keyword_summary": lambda t: keywords.keyword_summary(_keyword_metrics(t)),
    "simhash64": lambda t: rollups.simhash64(t.docs),
    "exact_duplicates": lambda t: rollups.exact_duplicates(t.docs),
    "rollup_contacts": lambda t: rollups.rollup_contacts(t.docs),
    "rollup_emails": lambda t: rollups.rollup_emails(t.docs),
    "rollup_wordcounts": lambda t: rollups.rollup_wordcounts(t.flags),
    "rollup_services": lambda t: rollups.rollup_services(t.parsed),
    "rollup_top_paths": lambda t: rollups.rollup_top_paths(t.fetch),
    "business_profile": lambda t: rollups.business_profile(t.flags),
    "rollup_images": lambda t: rollups.rollup_images(parse.page_images(t.parsed)),
    "image_domains": lambda t: rollups.image_domains(parse.page_images(t.parsed)),
    "rollup_content_types": lambda t: rollups.rollup_content_types(_content_types(t)),
    "social_links": lambda t: rollups.social_links(t.links),
    "extract_faqs": lambda t: rollups.extract_faqs(parse.page_headings(t.parsed)),
    "nav_nodes": lambda t: regions.nav_nodes(t.pages),
    "footer_links": lambda t: regions.footer_links(t.pages),
    "footer_contacts": lambda t: regions.footer_contacts(t.pages),
    "table_cells": lambda t: regions.table_cells(t.pages),
    "business_pages": lambda t: entities.business_pages(t.parsed),
    "extract_items": lambda t: entities.extract_items(t.parsed),
    "extract_locations": lambda t: entities.extract_locations(t.parsed),
    "extract_policies": lambda t: entities.extract_policies(t.parsed),
    "media_roles": lambda t: entities.media_roles(parse.page_images(t.parsed)),
    "primary_nav_guess": lambda t: entities.primary_nav_guess(t.parsed),
    "phrase_scores_v2": lambda t: keywords.phrase_scores_v2(t.parsed),
    "single_word_scores": lambda t: keywords.single_word_scores(t.parsed),
    "keyword_metrics_v2": _keyword_metrics_v2,
    "keyword_summary_v2": lambda t: keywords.keyword_summary_v2(_keyword_metrics_v2(t)),
    "keyword_comparison": lambda t: keywords.keyword_comparison(t.parsed, _first_site(t)),
    "extract_articles": lambda t: articles.extract_articles(t.pages).withColumn("publish_date", F.col("publish_date").cast("string")),
    "article_batch_summary": lambda t: articles.article_batch_summary(articles.extract_articles(t.pages)),
    "page_components": lambda t: articles.page_components(t.parsed).select("site", "url", F.to_json("components").alias("components")),
    "bandwidth_adjusted_load": lambda t: t.fetch.select("page_id", X.bandwidth_adjusted_load(F.col("load_time_ms"), F.col("content_length_bytes"), 5.0).alias("load_ms")),
    "near_duplicate_pairs": lambda t: near.near_duplicate_pairs(t.prints),
    "near_duplicate_members": lambda t: near.near_duplicate_members(t.prints),
    "dedup_greedy": lambda t: near.dedup_greedy(t.prints),
    "unique_content_ratio": lambda t: t.unique,
    "crawl_order": _crawl_order,
    "extract_main_text": lambda t: main_text.extract_main_text(t.pages),
    "page_titles": lambda t: titles.page_titles(t.parsed),
    "logo_candidates": lambda t: brand.logo_candidates(t.parsed),
    "brands": lambda t: brand.brands(t.parsed),
    "issue_urls": lambda t: report.issue_urls(report.page_issues(t.flags, t.broken)),
    "issue_examples": lambda t: report.issue_examples(report.issue_urls(report.page_issues(t.flags, t.broken))),
    "insight_report": _insight_report,
    "truth_table": lambda t: claims.truth_table(_claims(t)),
    "confident_claims": lambda t: claims.filter_by_confidence(claims.truth_table(_claims(t)), "medium"),
    "confidence_summary": lambda t: claims.confidence_summary(claims.truth_table(_claims(t))),
    "override_page_type": _override_page_type,
    "page_index": lambda t: index.index_view(index.page_index_stream(index.page_events(t.flags))),
    "recent_blocks": lambda t: blocks.recent_blocks(blocks.block_events(t.read("events"))),
    "active_blocks": lambda t: blocks.active_blocks(blocks.block_events(t.read("events")), 3 * 86_400),
    "json_profile": lambda t: files.json_profile(t.read("events").select(F.col("event_id").alias("id"), F.col("props").alias("payload"))),
    "progress_counts": _progress,
    "load_time_windows": lambda t: stream.load_time_windows(stream.fetch_rows(t.read("events"))),
}


#: Queries that read the parsed pages more than once.
PARSE_ONCE = {
    "keyword_metrics", "keyword_metrics_v2", "keyword_summary", "keyword_summary_v2", "keyword_comparison", "site_scores", "site_issues", "top_issues", "comparison_rows", "comparison_tables", "opportunities", "crawl_quality",
    "page_components", "follow_links", "phrase_scores", "phrase_scores_v2", "focus_keywords",
    "truth_table", "confident_claims", "confidence_summary", "brands", "issue_urls", "issue_examples", "insight_report",
}


def _query(name: str, build: Callable[[Tables], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: build(Tables(spark, sf_dir, name in PARSE_ONCE))


QUERIES = {name: _query(name, build) for name, build in _BUILD.items()}
FLAGSHIP = QUERIES["site_stats"]
