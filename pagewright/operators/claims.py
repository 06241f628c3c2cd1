"""Claims about a site, the truth table that settles them, and confidence bands.

A claim is (site, category, subcategory, field, value, confidence, source, type): one extracted fact with the page it was
read on. Equal claims are one row of the truth table with all their sources counted. Where a field can have one value
only, the claims of a site contradict each other and one is chosen.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import extract_emails, extract_phones

CLAIM = ["site", "category", "subcategory", "field", "value", "confidence", "source", "type"]
#: Fields of a site's profile count for 0.8, media for 0.9; above 0.8 is high, above 0.5 medium.
PROFILE_CONFIDENCE, MEDIA_CONFIDENCE, HIGH, MEDIUM = 0.8, 0.9, 0.8, 0.5
#: Types whose fields have one value a site.
SINGLE = ["text"]
#: Sources a row of the truth table names; all are counted.
NAMED_SOURCES = 3


def claims(rows: DataFrame, category: str, subcategory: str, field: str | Column, value: str | Column, confidence: float | Column, kind: str) -> DataFrame:
    """``rows(site, url, ...)`` as claims; rows without a value claim nothing."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    value = F.col(value) if isinstance(value, str) else value
    out = rows.select("site", F.lit(category).alias("category"), F.lit(subcategory).alias("subcategory"), col(field).alias("field"), value.cast("string").alias("value"), col(confidence).cast("double").alias("confidence"), F.col("url").alias("source"), F.lit(kind).alias("type"))
    return out.where("value <> ''")


def profile_claims(flags: DataFrame) -> DataFrame:
    """Name and tagline of a site by its pages, e-mail address and phone number by their footers."""
    one = lambda found: F.coalesce(F.try_element_at(found, F.lit(1)), F.lit(""))
    footers = flags.select("site", "url", one(extract_emails(F.col("footer_text"))).alias("email"), one(extract_phones(F.col("footer_text"))).alias("phone"))
    parts = [
        claims(flags, "Business", "Profile", "Name", "title", PROFILE_CONFIDENCE, "text"),
        claims(flags, "Business", "Profile", "Tagline", "description", PROFILE_CONFIDENCE, "text"),
        claims(footers, "Business", "Profile", "Email", "email", PROFILE_CONFIDENCE, "text"),
        claims(footers, "Business", "Profile", "Phone", "phone", PROFILE_CONFIDENCE, "text"),
    ]
    return reduce(DataFrame.unionByName, parts)


def media_claims(images: DataFrame) -> DataFrame:
    field = F.when(F.trim("alt") == "", "Media Asset").otherwise(F.coalesce("alt", F.lit("Media Asset")))
    return claims(images, "Assets", "Media", field, "img_url", MEDIA_CONFIDENCE, "media")


def truth_table(claimed: DataFrame) -> DataFrame:
    """Claims -> (site, category, subcategory, field, type, value, confidence, mentions, sources, first_sources,
    chosen).

    Equal claims meet in one row: their highest confidence, how often they were made, on how many pages, and the first
    of these by URL. Of a single-valued field the row with the highest confidence is chosen, then that with more sources,
    then with more mentions, then with the smaller value; rows of other fields are all chosen. Sources are counted after
    equal (claim, source) rows were combined, and the choice is a minimum, so neither a claim that every page makes nor a
    field with as many values as pages is one task's list.
    """
    key = ["site", "category", "subcategory", "field", "type", "value"]
    by_source = claimed.groupBy(*key, "source").agg(F.max("confidence").alias("confidence"), F.count(F.lit(1)).alias("mentions"))
    named = Window.partitionBy(*key).orderBy(F.asc_nulls_last("source"))
    first = by_source.withColumn("_n", F.row_number().over(named)).where(F.col("_n") <= NAMED_SOURCES)
    first = first.groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("source")), " ").alias("first_sources"))
    rows = by_source.groupBy(*key).agg(F.max("confidence").alias("confidence"), F.sum("mentions").alias("mentions"), F.count("source").alias("sources"))
    rows = rows.join(first, key)
    group = ["site", "category", "subcategory", "field", "type"]
    order = F.struct(-F.col("confidence"), -F.col("sources"), -F.col("mentions"), F.col("value"))
    best = rows.where(F.col("type").isin(SINGLE)).groupBy(*group).agg(F.min_by("value", order).alias("_best"))
    return rows.join(best, group, "left").withColumn("chosen", F.coalesce(F.col("value") == F.col("_best"), F.lit(True))).drop("_best")


def confidence_band(confidence: Column) -> Column:
    return F.when(confidence > HIGH, "high").when(confidence > MEDIUM, "medium").otherwise("low")


def filter_by_confidence(truth: DataFrame, band: str = "all", search: str = "", sort: str = "confidence", descending: bool = True) -> DataFrame:
    """Rows of one confidence band (high, medium, low or all) that name ``search`` in field or value, sorted by ``sort``,
    ties by site, field and value."""
    rows = truth if band == "all" else truth.where(confidence_band(F.col("confidence")) == band)
    if search:
        rows = rows.where(F.lower("field").contains(search.lower()) | F.lower("value").contains(search.lower()))
    return rows.orderBy(F.desc(sort) if descending else F.asc(sort), "site", "field", "value")


def confidence_summary(truth: DataFrame) -> DataFrame:
    """Per site: fields, how many of high, medium and low confidence, their average to two digits, values that a
    single-valued field was claimed to have besides the chosen one, and rows by category."""
    band = confidence_band(F.col("confidence"))
    count = lambda c, name: F.count_if(c).alias(name)
    return truth.groupBy("site").agg(
        F.count(F.lit(1)).alias("total"), count(band == "high", "high"), count(band == "medium", "medium"), count(band == "low", "low"), F.round(F.avg("confidence"), 2).alias("average"),
        count(~F.col("chosen"), "contradicted"), count(F.col("category") == "Business", "business"), count(F.col("category") == "Assets", "assets"),
    )
