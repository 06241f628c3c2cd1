"""Sites side by side: the matrix of measures, and how many pages each one's checks concern."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Measures by section, each from ``site_scores`` or ``site_stats``.
SECTIONS = {
    "score": ("overall", "performance", "seo", "content", "structure"),
    "performance": ("avg_load", "median_load", "p90_load", "avg_kb", "max_kb"),
    "content": ("words", "avg_words", "media", "pages"),
}


def comparison_tables(stats: DataFrame, scores: DataFrame) -> DataFrame:
    """(section, metric, site, value): one row per measure and site, so that the number of sites has no bound; pivot by
    site for a few of them. A site without scores is left out, a measure without a value is null."""
    graded = scores.select("site", *SECTIONS["score"])
    rows = stats.select("site", *SECTIONS["performance"], *SECTIONS["content"]).join(graded, "site")
    each = [F.struct(F.lit(s).alias("section"), F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for s, metrics in SECTIONS.items() for m in metrics]
    return rows.select("site", F.explode(F.array(*each)).alias("m")).select("m.section", "m.metric", "site", "m.value")


def issue_page_counts(flags: DataFrame, robots: bool = True, sitemap: bool = True) -> DataFrame:
    """Per site the pages that ask not to be indexed, lack a viewport or failed, whether robots.txt and sitemap are missing,
    and long pages: counted (over 600 words), and estimated from the average as reports do that know no single page
    (fixed values: four fifths of the pages from 600 words on average, two fifths from 300, else a tenth, cut to whole pages)."""
    rows = flags.groupBy("site").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if("noindex").alias("noindex_pages"),
        F.count_if("no_viewport").alias("no_viewport_pages"),
        F.count_if(F.col("status") >= 400).alias("error_pages"),
        F.count_if(F.col("words") > 600).alias("long_form_pages"),
        F.avg("words").alias("mean"),
    )
    share = F.when(F.col("mean") >= 600, 0.8).when(F.col("mean") >= 300, 0.4).when(F.col("mean") > 0, 0.1).otherwise(0.0)
    estimate = F.floor(F.col("pages") * share).cast("bigint")
    return rows.withColumns({"long_form_estimate": estimate, "no_robots": F.lit(not robots), "no_sitemap": F.lit(not sitemap)}).drop("mean")
