"""Page features, page types and page checks: one wide row per page feeds every site-level operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.operators.images import MODERN, image_format

#: URL parts that tell a page's type.
UTILITY = ["login", "signin", "sign-in", "account", "checkout", "privacy", "terms", "legal", "cookie", "auth", "register", "signup", "sign-up", "dashboard"]
CONTACT = ["contact", "find-us", "findus", "location", "about-us", "aboutus"]
CATALOG = ["shop", "category", "catalog", "products", "listings", "collection", "browse", "store"]
PRODUCT = ["/product/", "/item/", "/p/", "/products/", "/shop/"]
ARTICLE = ["blog", "news", "article", "post", "/story/", "/stories/"]
GALLERY = ["gallery", "photos", "images", "media", "portfolio", "video"]


def has_any(url: Column, parts: list[str]) -> Column:
    return F.lower(url).rlike("|".join(p.replace("/", "\\/") for p in parts))


def infer_page_type(url: Column, words: Column, paragraphs: Column, headings: Column, cards: Column) -> Column:
    """The first rule that holds. The home-page test of the rules holds for every URL and is left out."""
    return (
        F.when(has_any(url, UTILITY), "utility")
        .when(has_any(url, CONTACT), "contact")
        .when(has_any(url, CATALOG) & (((cards >= 8) & (paragraphs <= 3)) | ((cards >= 4) & (paragraphs <= 2))), "catalog")
        .when(has_any(url, PRODUCT) & (words >= 50) & (cards <= 4), "product")
        .when(has_any(url, ARTICLE) & (((words > 600) & (paragraphs > 5)) | ((words > 300) & (paragraphs > 3) & (headings >= 2))), "article")
        .when(has_any(url, GALLERY) & (words < 200) & (paragraphs <= 2), "media_gallery")
        .when((words < 400) & (paragraphs <= 6) & (headings >= 2), "landing")
        .otherwise("generic")
    )


def product_cards(images: Column, links: Column) -> Column:
    pair = lambda n: F.least(F.floor(images / n), F.floor(links / n))
    return F.when((images >= 8) & (links >= 8), pair(2)).when((images >= 4) & (links >= 4), pair(3)).otherwise(0)


def thin_level(page_type: Column, words: Column, bad: Column) -> Column:
    """very_thin, thin or null; error pages aren't judged."""
    level = lambda very, thin: F.when(words < very, "very_thin").when(words < thin, "thin")
    judged = F.when(page_type == "article", level(300, 600)).when(page_type == "landing", level(80, 150)).when(page_type == "generic", level(50, 150)).when(page_type.isin("catalog", "product") & (words < 10), "thin")
    return F.when(~bad, judged)


def is_bad(status: Column) -> Column:
    return status.isin(404, 410) | status.between(500, 599)


def page_flags(parsed: DataFrame, fetch: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """``parse_pages`` joined with the fetch log: features, type and every per-page check. A page has its own fetch, by url and
    page_id; where the log has none, the last fetch of its URL. ``images`` from ``check_images``, without which no image
    counts as very large."""
    fetched = F.struct("status", "load_time_ms", "render_mode")
    own = fetch.groupBy("url", "page_id").agg(F.max(fetched).alias("own"))
    last = own.groupBy("url").agg(F.max(F.struct("page_id", "own")).alias("last"))
    base = parsed.join(own, ["url", "page_id"], "left").join(last, "url", "left").withColumn("f", F.coalesce("own", "last.own"))
    base = base.select(*[parsed[c] for c in parsed.columns], "f.*")
    base = base.join(images.select("url", "very_large_images"), "url", "left") if images is not None else base.withColumn("very_large_images", F.lit(0))
    rows = base.withColumn("cards", product_cards(F.col("n_images"), F.col("n_internal"))).withColumn("bad", F.coalesce(is_bad(F.col("status")), F.lit(False)))
    typed = rows.withColumn("page_type", infer_page_type(F.col("url"), F.col("words"), F.size("paragraphs"), F.size("headings"), F.col("cards")))
    insecure = F.exists("links", lambda x: x["href"].startswith("http://")) | F.exists("images", lambda i: i["src"].startswith("http://"))
    return typed.select(
        "page_id", "site", "url", "status", "load_time_ms", "render_mode", "content_length_bytes", "title", "h1", "description", "text", "words", "n_links", "n_internal", "n_images", "nav_links", "footer_text", "footer_social", "footer_links", "cards", "page_type", "bad",
        F.size("paragraphs").alias("n_paragraphs"),
        F.size("headings").alias("n_headings"),
        (F.col("title") == "").alias("missing_title"),
        (F.col("description") == "").alias("missing_description"),
        F.col("h1").isNull().alias("missing_h1"),
        F.size(F.filter("images", lambda i: F.trim(i["alt"]) == "")).alias("missing_alt"),
        F.size(F.filter("images", lambda i: image_format(i["src"]).isin(MODERN))).alias("modern_images"),
        F.coalesce("very_large_images", F.lit(0)).alias("very_large_images"),
        F.lower("robots").contains("noindex").alias("noindex"),
        (~F.col("has_viewport")).alias("no_viewport"),
        (F.col("url").startswith("https://") & insecure).alias("mixed_content"),
        ((F.length("url") - F.length(F.replace("url", F.lit("/"), F.lit("")))) > 4).alias("deep_url"),
        thin_level(F.col("page_type"), F.col("words"), F.col("bad")).alias("thin"),
    )
