"""Checks of a page's images by size and format."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.urls import resolve_url

#: Bytes beyond which an image is large or very large, and formats that count as modern.
LARGE, VERY_LARGE, MODERN = 500 * 1024, 1024 * 1024, ["webp", "avif"]


def image_format(url: Column) -> Column:
    return F.lower(F.regexp_extract(F.substring_index(F.substring_index(url, "#", 1), "?", 1), r"\.([A-Za-z0-9]+)$", 1))


def check_images(parsed: DataFrame, sizes: DataFrame) -> DataFrame:
    """``parse_pages`` and ``sizes(img_url, bytes)`` -> (url, large_images, very_large_images), a row for each page that has
    any: images over 500 KB and over 1 MB, each occurrence counted. An image of unknown size is neither; of an image with
    several sizes the largest counts, so a size table with repeats makes no image count twice."""
    most = sizes.groupBy("img_url").agg(F.max("bytes").alias("bytes")).where(F.col("bytes") > LARGE)
    rows = parsed.select("url", F.explode("images").alias("i")).where("i.src <> ''").select("url", resolve_url(F.col("i.src"), F.col("url")).alias("img_url"))
    very = F.col("bytes") > VERY_LARGE
    return rows.join(most, "img_url").groupBy("url").agg(F.count_if(~very).alias("large_images"), F.count_if(very).alias("very_large_images"))
