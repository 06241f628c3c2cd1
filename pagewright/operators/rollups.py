"""Rollups over pages and texts, exact duplicates, and business entities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.simhash import majority_bits, word_hashes
from pagewright.functions.text import extract_addresses, extract_emails, extract_phones, wordcount_bucket
from pagewright.functions.urls import url_host


def page_id(url: Column) -> Column:
    return F.left(F.md5(url.cast("binary")), F.lit(12))


def text_hash(title: Column, text: Column) -> Column:
    return F.sha1(F.concat(title, F.lit("\n"), F.left(text, F.lit(2000))).cast("binary"))


def exact_duplicates(docs: DataFrame, most: int | None = None) -> DataFrame:
    """Groups of equal texts: hash, size and first id; of texts equal in their first ``most`` characters on request.
    Map-side combined."""
    text = F.coalesce("text", F.lit(""))
    key = F.sha1((text if most is None else F.left(text, F.lit(most))).cast("binary")).alias("hash")
    return docs.groupBy(key).agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first_id")).where("copies > 1")


def simhash64(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> (doc_id, simhash) for each row: the low 64 bits of md5 of each word vote on each bit.
    A row's value depends on its own text alone, so nothing is shuffled, and its words are counted in one pass."""
    return docs.select("doc_id", word_hashes(F.col("text")).alias("h")).select("doc_id", majority_bits(F.col("h")).alias("simhash"))


def simhash_similarity(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / 64


def rollup_contacts(docs: DataFrame) -> DataFrame:
    """Distinct e-mail addresses, phone numbers and street addresses by source, and how many texts hold one, each counted."""
    found = docs.select("source", extract_emails(F.col("text")).alias("e"), extract_phones(F.col("text")).alias("p"), extract_addresses(F.col("text")).alias("a"))
    one = lambda c, k: found.select("source", F.explode(c).alias("value"), F.lit(k).alias("kind"))
    return one("e", "email").unionByName(one("p", "phone")).unionByName(one("a", "address")).groupBy("source", "kind").agg(F.count_distinct("value").alias("distinct_values"), F.count(F.lit(1)).alias("mentions"))


def rollup_emails(docs: DataFrame) -> DataFrame:
    rows = docs.select("source", F.explode(extract_emails(F.col("text"))).alias("email"))
    return rows.groupBy("source").agg(F.count_distinct("email").alias("emails"), F.count(F.lit(1)).alias("mentions"))


def rollup_wordcounts(flags: DataFrame) -> DataFrame:
    return flags.groupBy("site", wordcount_bucket(F.col("words")).alias("bucket")).agg(F.count(F.lit(1)).alias("pages"), F.avg("words").alias("avg_words"), F.min("words").alias("min_words"), F.max("words").alias("max_words"))


#: Words that make a page one about a service.
SERVICE_WORDS = "service services solutions consulting support maintenance repair installation design development marketing advertising sales training education".split()


def rollup_services(parsed: DataFrame, top: int = 10) -> DataFrame:
    """Services by site, the ``top`` most mentioned, ties by name: for every service word in a page's text the first
    heading that holds it names the service, so a page counts once for each such word. Confidence grows to 1 at ten."""
    text = F.lower(F.coalesce("text", F.lit("")))
    held = F.filter(F.array(*map(F.lit, SERVICE_WORDS)), lambda k: text.contains(k))
    naming = lambda k: F.get(F.filter("headings", lambda h: F.lower(h["text"]).contains(k)), F.lit(0))["text"]
    rows = parsed.select("site", F.explode(F.transform(held, naming)).alias("service")).where("service is not null")
    rows = rows.groupBy("site", "service").agg(F.count(F.lit(1)).alias("pages"))
    order = Window.partitionBy("site").orderBy(F.desc("pages"), "service")
    return rows.withColumns({"confidence": F.least(F.lit(1.0), F.col("pages") / 10), "rank": F.row_number().over(order)}).where(F.col("rank") <= top)


def rollup_top_paths(pages: DataFrame, top: int = 20) -> DataFrame:
    """First four slash parts of URLs, with their share of the site's pages; the ``top`` of each site."""
    rows = pages.groupBy("site", F.substring_index("url", "/", 4).alias("path")).agg(F.count(F.lit(1)).alias("pages"))
    share = F.col("pages") * 100 / F.sum("pages").over(Window.partitionBy("site"))
    order = Window.partitionBy("site").orderBy(F.desc("pages"), "path")
    return rows.withColumn("percent", share).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rollup_images(images: DataFrame) -> DataFrame:
    return images.groupBy("site").agg(F.count(F.lit(1)).alias("images"), F.count_distinct("img_url").alias("distinct_images"), F.count_if(F.trim("alt") == "").alias("no_alt"))


def image_domains(images: DataFrame, top: int = 10) -> DataFrame:
    """(site, domain, images, rank): hosts that a site's images come from, the ``top`` with most images of pages, ties by name;
    ``unknown`` where an image's URL has no host."""
    domain = F.coalesce(F.nullif(url_host(F.col("img_url")), F.lit("")), F.lit("unknown"))
    rows = images.groupBy("site", domain.alias("domain")).agg(F.count(F.lit(1)).alias("images"))
    order = Window.partitionBy("site").orderBy(F.desc("images"), "domain")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def rollup_content_types(types: DataFrame) -> DataFrame:
    """``types(site, content_type)``, a row per page -> (site, content_type, pages, percent, most_common): how many pages of
    a site have each type, their share, and whether it is the commonest one, ties to the smaller name."""
    rows = types.groupBy("site", "content_type").agg(F.count(F.lit(1)).alias("pages"))
    site = Window.partitionBy("site")
    order = site.orderBy(F.desc("pages"), "content_type")
    return rows.withColumns({"percent": F.col("pages") * 100 / F.sum("pages").over(site), "most_common": F.row_number().over(order) == 1})


def business_profile(flags: DataFrame) -> DataFrame:
    """Per site: commonest title, ties to the smaller; pages that carry it; first three URLs."""
    titles = flags.where("title <> ''").groupBy("site", "title").agg(F.count(F.lit(1)).alias("n"))
    best = titles.groupBy("site").agg(F.min_by("title", F.struct(-F.col("n"), "title")).alias("name"), F.max("n").alias("name_pages"))
    first = flags.withColumn("r", F.row_number().over(Window.partitionBy("site").orderBy("url"))).where("r <= 3").groupBy("site").agg(F.array_join(F.array_sort(F.collect_list("url")), " ").alias("sources"))
    return first.join(best, "site", "left")


def social_links(links: DataFrame) -> DataFrame:
    """Links to social platforms by domain."""
    #: Fixed values
    domains = {"facebook": "facebook.com", "twitter": "twitter.com", "x": "//x.com", "instagram": "instagram.com", "linkedin": "linkedin.com", "youtube": "youtube.com", "tiktok": "tiktok.com", "pinterest": "pinterest.com", "github": "github.com"}
    platform = F.coalesce(*[F.when(F.lower("href").contains(d), F.lit(p)) for p, d in domains.items()])
    return links.withColumn("platform", platform).where("platform is not null").select("site", "url", "platform", "href").distinct()


def extract_faqs(headings: DataFrame) -> DataFrame:
    return headings.where("text like '%?%' and length(text) > 10").select("site", "url", "text", F.lit(0.6).alias("confidence"))


def latest_by_page(index: DataFrame) -> DataFrame:
    """Upsert semantics: the last row of each page_id by ``ingested_at``."""
    order = Window.partitionBy("page_id").orderBy(F.desc("ingested_at"))
    return index.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


def list_pages(flags: DataFrame, page_type: str | None = None, min_words: int = 0, query: str = "", page: int = 1, size: int = 50) -> DataFrame:
    """One page of a filtered, ordered list."""
    rows = flags.where(F.col("words") >= min_words)
    rows = rows.where(F.col("page_type") == page_type) if page_type else rows
    rows = rows.where(F.lower(F.concat_ws(" ", "url", "title", "page_type")).contains(query.lower())) if query else rows
    return rows.orderBy("site", "url").offset((page - 1) * size).limit(size)
