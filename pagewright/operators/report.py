"""The insight report: issues by page, by issue and by site from one table of page flags.

``page_issues`` has a row for each issue of each page. Everything above it is counted, or cut to a few rows a group before
it is gathered, so a site of any size makes a report of bounded size.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Pages an issue names as examples.
EXAMPLES = 3
#: What helps against an issue.
FIXES = {
    "missing_title": "Give every page a title of its own that says what it is about.",
    "missing_description": "Describe each page in one or two sentences in its meta description.",
    "missing_h1": "Begin each page with one h1 that names its topic.",
    "missing_alt": "Say in the alternative text of every image what it shows.",
    "noindex": "Take noindex off the pages that search engines should list.",
    "no_viewport": "Set the viewport in the head of every page, so that phones scale it.",
    "mixed_content": "Load images and links of secure pages by https only.",
    "very_slow_pages": "Make the slowest pages lighter: smaller images, fewer scripts, compressed answers.",
    "slow_pages": "Bring load times under one and a half seconds with caching and smaller files.",
    "very_large_images": "Shrink images of more than a megabyte, or save them in a modern format.",
    "no_modern_images": "Offer images as WebP or AVIF as well.",
    "very_thin_content": "Write more on these pages, or merge them: there is too little to read.",
    "thin_content": "Add text that answers what visitors look for there.",
    "low_text_catalog": "Add short descriptions to the products shown.",
    "broken_links": "Correct or remove links to pages that are gone.",
    "error_pages": "Restore pages that answer with an error, or redirect them.",
    "deep_urls": "Bring pages closer to the start page with shorter paths.",
    "no_navigation": "Offer a menu with links to the main parts of the site.",
    "no_footer_contact": "Put a way to reach you into the footer.",
    "http_only": "Serve the whole site by https.",
}
OTHER_FIX = "Look at the pages named and mend what the issue describes."


def page_rules() -> list[tuple[str, str, Column, Column]]:
    """Issue, category, whether a row of ``page_flags`` with ``broken`` shows it, and a note (fixed values: the limits)."""
    col, none = F.col, F.lit(None).cast("string")
    important = col("page_type").isin("article", "landing", "generic")
    words = F.concat(col("words").cast("string"), F.lit(" words ("), col("page_type"), F.lit(")"))
    load = F.concat(col("load_time_ms").cast("string"), F.lit(" ms"))
    status = F.concat(F.lit("status "), col("status").cast("string"))
    return [
        ("missing_title", "seo", col("missing_title"), none),
        ("missing_description", "seo", col("missing_description"), none),
        ("missing_h1", "seo", col("missing_h1"), none),
        ("missing_alt", "seo", col("missing_alt") > 0, F.concat(col("missing_alt").cast("string"), F.lit(" images"))),
        ("noindex", "seo", col("noindex"), none),
        ("very_thin_content", "content", important & (col("thin") == "very_thin"), words),
        ("thin_content", "content", important & (col("thin") == "thin"), words),
        ("low_text_catalog", "content", ~important & col("thin").isNotNull(), words),
        ("very_slow_pages", "performance", col("load_time_ms") > 3000, load),
        ("very_large_images", "performance", col("very_large_images") > 0, F.concat(col("very_large_images").cast("string"), F.lit(" images"))),
        ("slow_pages", "performance", col("load_time_ms") > 1500, load),
        ("deep_urls", "structure", col("deep_url"), none),
        ("mixed_content", "structure", col("mixed_content"), none),
        ("no_viewport", "structure", col("no_viewport"), none),
        ("broken_links", "structure", col("broken") > 0, F.concat(col("broken").cast("string"), F.lit(" links"))),
        ("error_pages", "structure", col("bad"), status),
    ]


def page_issues(flags: DataFrame, broken: DataFrame) -> DataFrame:
    """``page_flags`` and ``broken_by_page`` -> (site, url, issue, category, note), a row for each issue of each page."""
    rows = flags.join(broken.select("url", "broken"), "url", "left").withColumn("broken", F.coalesce("broken", F.lit(0)))
    each = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(i).alias("issue"), F.lit(c).alias("category"), note.alias("note"))) for i, c, hit, note in page_rules()]))
    return rows.select("site", "url", F.explode(each).alias("i")).select("site", "url", "i.*")


def issue_urls(issues: DataFrame) -> DataFrame:
    """(site, issue, url, note): each affected URL of a site once by issue, with its smallest note."""
    return issues.groupBy("site", "issue", "url").agg(F.min("note").alias("note"))


def issue_examples(urls: DataFrame, examples: int = EXAMPLES) -> DataFrame:
    """``issue_urls`` -> (site, issue, affected, examples, more): how many URLs, the first of them with their notes, and how
    many are left. The first are cut by rank before they are gathered, the others only counted."""
    rank = F.row_number().over(Window.partitionBy("site", "issue").orderBy("url"))
    shown = urls.withColumn("rank", rank).where(F.col("rank") <= examples)
    text = F.concat(F.col("url"), F.coalesce(F.concat(F.lit(" ("), F.col("note"), F.lit(")")), F.lit("")))
    first = shown.groupBy("site", "issue").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", text.alias("text")))), lambda x: x["text"]).alias("e"))
    counts = urls.groupBy("site", "issue").agg(F.count(F.lit(1)).alias("affected"))
    rows = counts.join(first, ["site", "issue"])
    return rows.select("site", "issue", "affected", F.array_join("e", "; ").alias("examples"), F.greatest(F.col("affected") - examples, F.lit(0)).alias("more"))


def fix_recommendation(issue: Column) -> Column:
    return F.coalesce(F.create_map(*[F.lit(x) for pair in FIXES.items() for x in pair])[issue], F.lit(OTHER_FIX))


def insight_report(scores: DataFrame, issues: DataFrame, examples: DataFrame, keywords: DataFrame | None = None) -> DataFrame:
    """``site_scores``, ``site_issues``, ``issue_examples`` -> (site, overall, pages, high, medium, low, categories,
    issues): one row a site.

    ``categories`` maps each category to its score and number of issues. ``issues`` holds every issue of the site, the
    gravest first, with severity, pages affected, examples and what helps: as many as there are kinds of issues at most.
    ``keywords(site, phrase, rank)`` adds the best phrases. A site without issues has an empty list.
    """
    grade = F.when(F.col("severity") == "high", 0).when(F.col("severity") == "medium", 1).otherwise(2)
    entry = F.struct(
        grade.alias("order"), (-F.col("i.affected")).alias("less"), F.col("issue").alias("issue"), F.col("category").alias("category"), F.col("severity").alias("severity"), F.col("i.affected").alias("affected"),
        F.coalesce("examples", F.lit("")).alias("examples"), F.coalesce("more", F.lit(0)).cast("bigint").alias("more"), fix_recommendation(F.col("issue")).alias("fix"),
    )
    full = issues.alias("i").join(examples.select("site", "issue", "examples", "more"), ["site", "issue"], "left")
    count = lambda s: F.count_if(F.col("severity") == s).alias(s)
    kinds = ["performance", "seo", "content", "structure"]
    per_kind = [F.count_if(F.col("category") == k).alias(f"n_{k}") for k in kinds]
    listed = full.groupBy("site").agg(F.array_sort(F.collect_list(entry)).alias("all"), count("high"), count("medium"), count("low"), *per_kind)
    rows = scores.join(listed, "site", "left")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    categories = F.array(*[F.struct(F.lit(k).alias("category"), F.col(k).alias("score"), zero(f"n_{k}").alias("issues")) for k in kinds])
    bare = F.transform(F.coalesce("all", F.array()), lambda e: e.dropFields("order", "less"))
    out = rows.select("site", "overall", "pages", zero("high").alias("high"), zero("medium").alias("medium"), zero("low").alias("low"), "content_depth", "crawlability", "nav_type", categories.alias("categories"), bare.alias("issues"))
    if keywords is None:
        return out
    best = keywords.where("rank <= 10").groupBy("site").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "phrase"))), lambda k: k["phrase"]).alias("phrases"))
    return out.join(best, "site", "left")
