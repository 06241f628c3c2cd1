"""The order in which a crawl from a site's start visits its pages, within depth and page limits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.sources.shared import written

#: How deep, and how many pages of a site, a crawl goes.
MAX_DEPTH, MAX_PAGES = 5, 400


def ordered_edges(links: DataFrame) -> DataFrame:
    """``links(site, url, pos, href, kind)`` -> (site, src, dst, pos): internal links, each target of a page at its first
    place."""
    return links.where("kind = 'internal' and href <> url").groupBy("site", F.col("url").alias("src"), F.col("href").alias("dst")).agg(F.min("pos").alias("pos"))


def crawl_order(edges: DataFrame, starts: DataFrame, max_depth: int = MAX_DEPTH, max_pages: int = MAX_PAGES) -> DataFrame:
    """``edges(site, src, dst, pos)``, ``starts(site, url)`` -> (site, url, depth, position): what a queue would visit.

    A queue holds pages level by level, within a level in the order of the pages that link there, then of the links on
    them; so each level is one join of the last one with the edges, a minimum by target, an anti-join with what was seen
    and a rank, which goes on from the last level's. A site's pages end at position ``max_pages``, in the middle of a
    level if it falls there. No level of a site has more rows than that after the rank, whose limit also holds before
    its shuffle. A site's smallest start counts; a start that no page links to stands alone.
    """
    seen = written(starts.where("url is not null").groupBy("site").agg(F.min("url").alias("url")).select("site", "url", F.lit(0).alias("depth"), F.lit(1).alias("position")), "crawl")
    level = seen
    order = Window.partitionBy("site").orderBy("came", "url")
    for depth in range(1, max_depth + 1):
        ends = seen.groupBy("site").agg(F.max("position").alias("so_far"))
        now = level.select(F.col("site").alias("s"), F.col("url").alias("u"), "position")
        found = edges.join(now, (edges.site == F.col("s")) & (edges.src == F.col("u"))).groupBy("site", F.col("dst").alias("url")).agg(F.min(F.struct("position", "pos")).alias("came"))
        new = found.join(seen.select("site", "url"), ["site", "url"], "left_anti")
        ranked = new.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= max_pages)
        placed = ranked.join(ends, "site").withColumn("position", F.col("so_far") + F.col("rank")).where(F.col("position") <= max_pages)
        level = written(placed.select("site", "url", F.lit(depth).alias("depth"), "position"), "crawl")
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen
