"""A site's brand: its name and its logo, by the evidence that images give."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.urls import resolve_url
from pagewright.operators.titles import is_home

#: Where "logo" counts, the strongest place first, and the widest candidate of a srcset that counts.
EVIDENCE = ["alt", "class", "id", "inside", "url"]
WIDEST = 2_000


def srcset_candidates(srcset: Column) -> Column:
    """The candidates of a srcset as array of (url, width): those with a width descriptor, at most ``WIDEST`` wide. A URL
    is a run without blanks; commas inside it are part of it."""
    text, pattern = F.coalesce(srcset, F.lit("")), F.lit(r"([^\s,](?:\S*[^\s,])?)\s+([0-9]{1,9})w\s*(?:,|$)")
    found = F.arrays_zip(F.regexp_extract_all(text, pattern, F.lit(1)).alias("url"), F.regexp_extract_all(text, pattern, F.lit(2)).alias("width"))
    return F.filter(F.transform(found, lambda c: F.struct(c["url"].alias("url"), c["width"].cast("int").alias("width"))), lambda c: c["width"] <= WIDEST)


def widest(srcset: Column) -> Column:
    """(url, width) of the widest candidate, of equal ones the first; null without one."""
    best = F.aggregate(
        srcset_candidates(srcset),
        F.struct(F.lit("").alias("url"), F.lit(0).alias("width")),
        lambda b, c: F.when(c["width"] > b["width"], F.struct(c["url"].alias("url"), c["width"].alias("width"))).otherwise(b),
    )
    return F.when(best["width"] > 0, best)


def logo_evidence(image: Column) -> Column:
    """The strongest place in which an image is called a logo, else null; ``image`` is one of ``parse_pages``."""
    says = lambda c: F.lower(F.coalesce(c, F.lit(""))).contains("logo")
    return F.when(says(image["alt"]), "alt").when(says(image["css"]), "class").when(says(image["id"]), "id").when(image["boxed"], "inside").when(says(image["src"]), "url")


def _score(evidence: Column) -> Column:
    return F.lit(len(EVIDENCE)) - F.array_position(F.lit(EVIDENCE), evidence).cast("int") + 1


def logo_candidates(parsed: DataFrame) -> DataFrame:
    """``parse_pages`` -> (site, img_url, evidence, pages, home, best_url, best_width): every image of a site that something
    calls a logo, with its strongest evidence, on how many pages, whether on a home page, and the widest of its srcset."""
    rows = parsed.select("site", "url", F.explode("images").alias("i")).where("i.src <> ''").withColumn("evidence", logo_evidence(F.col("i"))).where("evidence is not null")
    large = widest(F.col("i.srcset"))
    rows = rows.select("site", "url", resolve_url(F.col("i.src"), F.col("url")).alias("img_url"), "evidence", large.alias("large"))
    one = rows.groupBy("site", "img_url", "url").agg(F.max_by("evidence", _score(F.col("evidence"))).alias("evidence"), F.max_by(F.struct(F.col("large.width").alias("width"), resolve_url(F.col("large.url"), F.col("url")).alias("url")), F.col("large.width")).alias("l"))
    return one.groupBy("site", "img_url").agg(
        F.max_by("evidence", _score(F.col("evidence"))).alias("evidence"), F.count(F.lit(1)).alias("pages"), F.bool_or(is_home(F.col("url"))).alias("home"),
        F.max_by("l.url", F.struct("l.width", "l.url")).alias("best_url"), F.max("l.width").alias("best_width"),
    )


def brands(parsed: DataFrame) -> DataFrame:
    """``parse_pages`` -> (site, name, logo, evidence): the title of the site's home page, or of its page with the shortest
    URL, the greater of equals; and its best logo: on a home page first, then by evidence, then by pages, then by URL.
    Both are one combined maximum a site; every site has a row."""
    page = F.struct(is_home(F.col("url")), -F.length("url"), F.col("title") != "")
    names = parsed.groupBy("site").agg(F.max_by(F.struct("title", "url"), F.struct(page, F.col("title"))).alias("n"))
    logos = logo_candidates(parsed).groupBy("site").agg(F.min_by(F.struct("img_url", "evidence"), F.struct(~F.col("home"), -_score(F.col("evidence")), -F.col("pages"), "img_url")).alias("l"))
    return names.join(logos, "site", "left").select("site", F.nullif(F.col("n.title"), F.lit("")).alias("name"), F.col("l.img_url").alias("logo"), F.col("l.evidence").alias("evidence"))
