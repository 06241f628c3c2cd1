"""Business entities of sites: kinds of pages, items, locations, policies, roles of images, main navigation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.urls import path_segments
from pagewright.operators.parse import page_headings
from pagewright.operators.rollups import page_id

#: Words in a URL or title that tell a page's kind.
KINDS = {
    "service": "service|solution|expertise|capability",
    "product": "product|catalog|shop|store",
    "menu": "menu|food|drink|restaurant",
    "location": "contact|location|address|find us|visit",
    "team": "team|staff|about|people|leadership",
    "policy": "privacy|terms|policy|legal|disclaimer",
}
#: Fixed value: a street address.
ADDRESS = r"\d+\s+[A-Za-z0-9\s,.-]+(?:Street|St|Avenue|Ave|Road|Rd|Boulevard|Blvd|Drive|Dr|Lane|Ln|Way|Place|Pl)"
#: Words in an image's URL or alternative text that tell its role, the first that matches.
ROLES = {"logo": ("logo", "logo|brand"), "hero": ("hero|banner|header", "hero|banner|header"), "team": ("team|staff|person", "team|staff|person"), "product": ("product|service", "product|service")}


def business_pages(parsed: DataFrame) -> DataFrame:
    """(site, url, kind): a row for each kind that a page's URL or title names; pages of no kind have none."""
    named = F.lower(F.concat_ws("\n", "url", "title"))
    kinds = F.array_compact(F.array(*[F.when(named.rlike(words), F.lit(k)) for k, words in KINDS.items()]))
    return parsed.select("site", "url", F.explode(kinds).alias("kind"))


def extract_items(parsed: DataFrame, kinds: tuple[str, ...] = ("service", "product", "menu")) -> DataFrame:
    """(site, kind, item_id, title, confidence, url): headings of three characters or more on pages of a kind, each
    lower-cased title once per site and kind, from its first page by URL and its first place there."""
    heads = page_headings(parsed).where("length(text) >= 3 and lower(text) not in ('home', 'about', 'contact')")
    rows = heads.join(business_pages(parsed).where(F.col("kind").isin(*kinds)), ["site", "url"])
    first = rows.groupBy("site", "kind", F.lower("text").alias("key")).agg(F.min(F.struct("url", "pos", "text")).alias("f"))
    item_id = F.left(F.md5(F.concat(page_id(F.col("f.url")), F.lit("_"), F.col("f.text")).cast("binary")), F.lit(8))
    return first.select("site", "kind", item_id.alias("item_id"), F.col("f.text").alias("title"), (0.8 + F.when(F.length("f.text") > 10, 0.1).otherwise(0.0)).alias("confidence"), F.col("f.url").alias("url"))


def extract_locations(parsed: DataFrame) -> DataFrame:
    """(site, address, name, confidence, url): the first address of each location page, each once per site
    without regard to case and blanks, from its first page by URL."""
    rows = parsed.join(business_pages(parsed).where("kind = 'location'").select("site", "url"), ["site", "url"])
    rows = rows.withColumn("address", F.regexp_extract("text", ADDRESS, 0)).where("address <> ''")
    key = F.regexp_replace(F.lower(F.trim("address")), r"\s+", " ")
    name = F.when(F.col("title") == "", "Location").otherwise(F.col("title"))
    first = rows.groupBy("site", key.alias("key")).agg(F.min(F.struct("url", "address", name.alias("name"))).alias("f"))
    return first.select("site", "f.address", "f.name", F.lit(0.7).alias("confidence"), "f.url")


def extract_policies(parsed: DataFrame) -> DataFrame:
    named = F.lower(F.concat_ws("\n", "url", "title"))
    kind = F.when(named.contains("privacy"), "privacy").when(named.contains("terms"), "terms").otherwise("policy")
    return parsed.where(named.rlike(KINDS["policy"])).select("site", "url", "title", kind.alias("policy"), F.lit(0.8).alias("confidence"))


def image_role(url: Column, alt: Column) -> Column:
    """By the URL, else by the alternative text, else "content"."""
    by = lambda c, i: F.coalesce(*[F.when(F.lower(c).rlike(w[i]), F.lit(r)) for r, w in ROLES.items()])
    return F.coalesce(by(url, 0), by(alt, 1), F.lit("content"))


def media_roles(images: DataFrame) -> DataFrame:
    """(site, role, images): different images of a site by role; an image has the role of its first page by URL."""
    one = images.groupBy("site", "img_url").agg(F.min_by("alt", F.struct("url", "pos")).alias("alt"))
    return one.groupBy("site", image_role(F.col("img_url"), F.coalesce("alt", F.lit(""))).alias("role")).agg(F.count(F.lit(1)).alias("images"))


def primary_nav_guess(parsed: DataFrame, most: int = 7) -> DataFrame:
    """(site, rank, label, url): pages one path segment deep, by URL, the first ``most`` of each site."""
    seg = path_segments(F.col("url"))
    label = F.when(F.col("title") == "", F.initcap(F.element_at(seg, 1))).otherwise(F.col("title"))
    rank = F.row_number().over(Window.partitionBy("site").orderBy("url"))
    return parsed.where(F.size(seg) == 1).select("site", label.alias("label"), "url").withColumn("rank", rank).where(F.col("rank") <= most)
