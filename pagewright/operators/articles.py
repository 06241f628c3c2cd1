"""Articles of pages, and pages as lists of components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import plain
from pagewright.functions.urls import resolve_url, url_host
from pagewright.operators.parse import page_files, page_images, without_scripts

#: Phrases of advertising that are cut from articles.
AD_PHRASES = "Advertisement|Sponsored Content|Related Articles|You might also like|Subscribe to|Follow us on|Share this article"
#: Classes of an article's title and content, in order of preference.
TITLE_CLASSES = ["entry-title", "article-title", "post-title"]
CONTENT_CLASSES = ["article-content", "entry-content", "post-content"]
MORE_CLASSES = ["content", "article-body", "story-body"]
#: Places of dates in text, and the formats of each.
DATES = [
    (r"(\d{4}-\d{2}-\d{2})", ["yyyy-MM-dd"]),
    (r"(\d{2}/\d{2}/\d{4})", ["MM/dd/yyyy", "dd/MM/yyyy"]),
    (r"(\d{1,2}/\d{1,2}/\d{4})", ["M/d/yyyy", "d/M/yyyy"]),
    (r"([A-Za-z]+ \d{1,2}, \d{4})", ["MMMM d, yyyy", "MMM d, yyyy"]),
    (r"(\d{1,2} [A-Za-z]+ \d{4})", ["d MMMM yyyy", "d MMM yyyy"]),
]


def clean_article_text(text: Column) -> Column:
    """Advertising phrases cut whatever their case, runs of line ends and of blanks squeezed."""
    squeezed = F.regexp_replace(F.regexp_replace(F.coalesce(text, F.lit("")), r"\n+", "\n"), " +", " ")
    return F.regexp_replace(F.regexp_replace(squeezed, f"(?i){AD_PHRASES}", ""), r"^\s+|\s+$", "")


def parse_article_date(text: Column) -> Column:
    """The first date that one of the patterns finds and one of its formats reads; else null."""
    tries = [F.to_date(F.try_to_timestamp(F.nullif(F.regexp_extract(text, pattern, 1), F.lit("")), F.lit(f))) for pattern, formats in DATES for f in formats]
    return F.coalesce(*tries)


def _by_class(html: Column, names: list[str], tags: str) -> list[Column]:
    """Content of the first element of each class, up to the first end tag of its kind."""
    return [F.regexp_extract(html, rf'(?is)<({tags})\s[^>]*class="(?:[^"]*\s)?{n}(?:\s[^"]*)?"[^>]*>(.*?)</\1>', 2) for n in names]


def _first(candidates: list[Column], more_than: int) -> Column:
    return F.try_element_at(F.filter(F.array(*map(plain, candidates)), lambda c: F.length(c) > more_than), F.lit(1))


def extract_articles(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> (page_id, site_name, url, title, content, author, publish_date, word_count,
    success), one row per page.

    The title is the first of more than 10 characters, the content the first of more than 100; without either the
    row stays, with ``success`` false. Null HTML counts as empty.
    """
    html = without_scripts(F.coalesce("html", F.lit("")))
    whole = lambda tag: F.regexp_extract(html, rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", 1)
    blocks = "div|section|article|main"
    title = _first([*_by_class(html, TITLE_CLASSES, "h1"), whole("h1"), whole("title")], 10)
    content = _first([*_by_class(html, CONTENT_CLASSES, blocks), whole("article"), *_by_class(html, MORE_CLASSES, blocks), whole("main")], 100)
    meta = lambda names: F.regexp_extract(html, rf'(?i)<meta\s[^>]*(?:name|property)="(?:{names})"[^>]*content="([^"]*)"', 1)
    author = _first([meta("author|article:author"), *_by_class(html, ["author", "byline"], "span|div|a|p")], 0)
    when = F.coalesce(*[parse_article_date(c) for c in (meta("article:published_time|date"), F.regexp_extract(html, r'(?i)<time\s[^>]*datetime="([^"]*)"', 1), whole("time"))])
    rows = pages.select("page_id", url_host(F.col("url")).alias("site_name"), "url", title.alias("title"), clean_article_text(content).alias("content"), author.alias("author"), when.alias("publish_date"))
    words = F.when(F.col("content") == "", 0).otherwise(F.size(F.split("content", r"\s+")))
    return rows.withColumn("word_count", words).withColumn("success", F.col("title").isNotNull() & (F.col("content") != ""))


def article_batch_summary(articles: DataFrame) -> DataFrame:
    return articles.groupBy("site_name").agg(F.count_if("success").alias("successful"), F.count(F.lit(1)).alias("total"))


def hero_content(parsed: DataFrame) -> DataFrame:
    """``parse_pages`` -> (site, url, heading, text, image), a row per page: its first h1, else its first heading, else ""; its
    first two paragraphs, one a line; its largest image by width times height, the first of equal ones, null if it has none.
    A missing size counts as 0; an image that is shown twice counts with its larger size."""
    area = lambda i: F.coalesce(i["width"], F.lit(0)).cast("bigint") * F.coalesce(i["height"], F.lit(0))
    shown = F.transform(F.filter("images", lambda i: i["src"] != ""), lambda i, n: F.struct((-area(i)).alias("a"), n.alias("n"), i["src"].alias("src")))
    heading = F.coalesce("h1", F.try_element_at("headings", F.lit(1))["text"], F.lit(""))
    return parsed.select("site", "url", heading.alias("heading"), F.array_join(F.slice("paragraphs", 1, 2), "\n").alias("text"), resolve_url(F.array_min(shown)["src"], F.col("url")).alias("image"))


def page_components(parsed: DataFrame) -> DataFrame:
    """``parse_pages`` -> (site, url, components): hero, section, gallery and files, each where there is something to
    show; a page with nothing gets a section that says so. Written as JSON it is a site's seed."""
    key = ["site", "url"]
    images = page_images(parsed).groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "img_url"))), lambda i: i["img_url"]).alias("pictures"))
    files = page_files(parsed).groupBy(*key).agg(F.array_sort(F.collect_set("href")).alias("files"))
    none = F.array().cast("array<string>")
    rows = parsed.select(*key, "headings", "paragraphs").join(images, key, "left").join(files, key, "left").withColumn("pictures", F.coalesce("pictures", none)).withColumn("files", F.coalesce("files", none))
    h1 = F.try_element_at(F.filter("headings", lambda h: h["tag"] == "h1"), F.lit(1))["text"]
    heading = F.coalesce(h1, F.try_element_at("headings", F.lit(1))["text"])
    part = lambda kind, head, texts, urls: F.struct(F.lit(kind).alias("type"), head.alias("heading"), texts.alias("texts"), urls.alias("urls"))
    no = F.lit(None).cast("string")
    rest = F.when(F.size("paragraphs") > 2, F.slice("paragraphs", 3, F.greatest(F.lit(1), F.size("paragraphs")))).otherwise(F.col("paragraphs"))
    found = F.array_compact(F.array(
        F.when((F.size("pictures") > 0) & heading.isNotNull(), part("hero", heading, F.slice("paragraphs", 1, 2), F.slice("pictures", 1, 1))),
        F.when(F.size(rest) > 0, part("section", no, rest, none)),
        F.when(F.size("pictures") > 1, part("gallery", no, none, F.slice("pictures", 2, F.greatest(F.lit(1), F.size("pictures"))))),
        F.when(F.size("files") > 0, part("files", no, none, F.col("files"))),
    ))
    empty = F.array(part("section", no, F.array(F.lit("Content not available")), none))
    return rows.select(*key, F.when(F.size(found) > 0, found).otherwise(empty).alias("components"))
