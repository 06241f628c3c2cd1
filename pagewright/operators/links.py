"""Joins between links and page statuses, and the link graph."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.sources.shared import written

from .flags import is_bad


def status_map(index: DataFrame, docs: DataFrame) -> DataFrame:
    """Statuses of two sources by url, the second winning; each has (site, url, status, page_id). Within a source the last
    page, by page_id, wins."""
    last = lambda df, name: df.groupBy("site", "url").agg(F.max_by("status", "page_id").alias(name))
    return last(index, "i").join(last(docs, "d"), ["site", "url"], "full").select("site", "url", F.coalesce("d", "i").alias("status"))


def broken_internal_links(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Internal links to a known page with status 404, 410 or 5xx; links to unknown pages aren't broken."""
    bad = statuses.where(is_bad(F.col("status"))).select(F.col("url").alias("href"), "status").distinct()
    return links.where("kind = 'internal'").join(bad, "href").select("site", "url", "href", "label", "status")


def broken_by_page(links: DataFrame, statuses: DataFrame) -> DataFrame:
    return broken_internal_links(links, statuses).groupBy("site", "url").agg(F.count(F.lit(1)).alias("broken"), F.count_distinct("href").alias("targets"))


def uncrawled_links(links: DataFrame, statuses: DataFrame) -> DataFrame:
    """Internal targets that no page of the corpus has, with how many links point there."""
    known = statuses.select(F.col("url").alias("href"))
    return links.where("kind = 'internal'").join(known, "href", "left_anti").groupBy("site", "href").agg(F.count(F.lit(1)).alias("links"))


def pages_with_broken(pages: DataFrame, broken: DataFrame) -> DataFrame:
    return pages.join(broken, ["site", "url"], "left_semi")


def link_edges(links: DataFrame) -> DataFrame:
    return links.where("kind = 'internal' and href <> url").select("site", F.col("url").alias("src"), F.col("href").alias("dst")).distinct()


def link_degree(edges: DataFrame, pages: DataFrame) -> DataFrame:
    """Every page with its distinct internal links out and in."""
    out = edges.groupBy(F.col("src").alias("url")).agg(F.count(F.lit(1)).alias("out_degree"))
    into = edges.groupBy(F.col("dst").alias("url")).agg(F.count(F.lit(1)).alias("in_degree"))
    rows = pages.select("site", "url").distinct().join(out, "url", "left").join(into, "url", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select("site", "url", zero("out_degree"), zero("in_degree"))


def reachable_within(edges: DataFrame, starts: DataFrame, max_depth: int = 5) -> DataFrame:
    """``starts(site, url)`` -> every page within ``max_depth`` links of its site's start, with its depth.

    One equi-join and one anti-join a hop; the loop ends when a hop finds nothing new.
    """
    seen = written(starts.select("site", "url").distinct().withColumn("depth", F.lit(0)), "links")
    frontier = seen
    for depth in range(1, max_depth + 1):
        step = frontier.join(edges, (edges.src == frontier.url) & (edges.site == frontier.site)).select(edges.site, F.col("dst").alias("url")).distinct()
        frontier = written(step.join(seen, ["site", "url"], "left_anti").withColumn("depth", F.lit(depth)), "links")
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


#: Words of a label that keep a crawl from following a link, words that make it one to an article, and the depth
#: beyond which no link is followed.
SKIP = "login signup register advertisement popup cookie privacy terms contact about".split()
ARTICLE = "news article story report breaking update politics world business sports entertainment".split()
FOLLOW_DEPTH = 3


def follow_links(links: DataFrame, depths: DataFrame) -> DataFrame:
    """``depths(site, url, depth)`` -> (site, url, pos, href, depth, priority): links of pages whose depth is known, 0 if not to
    be followed, 2 if the label tells of an article, else 1. Labels count without regard to case; a link without a label is a
    1. Links are never drawn by chance."""
    holds = lambda words: F.lower(F.coalesce("label", F.lit(""))).rlike("|".join(words))
    priority = F.when((F.col("depth") > FOLLOW_DEPTH) | holds(SKIP), 0).when(holds(ARTICLE), 2).otherwise(1)
    return links.join(depths, ["site", "url"]).select("site", "url", "pos", "href", "depth", priority.alias("priority"))


def nav_rollup(links: DataFrame, top: int = 20) -> DataFrame:
    """Internal targets linked more than once under a text, the ``top`` most frequent of each site, with their last label by
    page and place."""
    rows = links.where("kind = 'internal' and label <> ''").groupBy("site", "href").agg(F.count(F.lit(1)).alias("frequency"), F.max_by("label", F.struct("url", "pos")).alias("label"))
    order = Window.partitionBy("site").orderBy(F.desc("frequency"), "href")
    return rows.where("frequency > 1").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def robots_rules(robots: DataFrame) -> DataFrame:
    """``robots(site, body)`` -> rows (site, line, agent, rule, value): directives under their agent group."""
    lines = robots.select("site", F.posexplode(F.split("body", "\n")).alias("line", "raw"))
    parts = lines.select("site", "line", F.lower(F.trim(F.substring_index("raw", ":", 1))).alias("rule"), F.trim(F.regexp_extract(F.regexp_replace("raw", "#.*", ""), r":\s*(.*)$", 1)).alias("value"))
    agent = F.last(F.when(F.col("rule") == "user-agent", F.col("value")), ignorenulls=True).over(Window.partitionBy("site").orderBy("line"))
    return parts.withColumn("agent", agent).where("rule in ('allow', 'disallow', 'crawl-delay', 'sitemap')")
