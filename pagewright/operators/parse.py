"""Raw HTML pages to columns and child tables, by built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.text import clean_text, entities, plain, word_count
from pagewright.functions.urls import FILE, drop_fragment, is_internal, resolve_url, url_host

#: Content of an element: text and other tags up to one that starts like the closing one. Text is taken in whole
#: runs, so that matching goes as deep as there are tags, not characters.
PARAGRAPH = r"(?i)<p(?:\s[^>]*)?>((?:[^<]++|<[^/p][^>]*>|</[^p][^>]*>)*)"
ANCHOR = r"(?i)<a\s[^>]*>(?:[^<]++|<(?!/|a\s)[^>]*>|</(?!a\s*>)[^>]*>)*</a\s*>"
HEADING = r"(?i)<(h[1-6])(?:\s[^>]*)?>((?:[^<]++|<[^/][^>]*>|</[^h][^>]*>)*)</h[1-6]>"
IMAGE = r"(?i)<img\s([^>]*)>"
#: A video element up to its first source, or the start of an embedded frame.
VIDEO = r"(?i)<(?:iframe\b[^>]*+>|video\b[^>]*+>[^<]*+(?:<(?!/video\b|source\b|video\b|iframe\b)[^>]*+>[^<]*+)*+(?:<source\b[^>]*+>)?+)"
META = r"(?i)<meta\s([^>]*)>"
JSONLD = r"""(?i)<script[^>]*type\s*=\s*["']?application/ld\+json["']?[^>]*>([^<]*)</script>"""
#: The first image inside an element whose class or id has the word logo.
LOGO_BOX = (
    r"""(?i)<(?:a|div|span|header|h1|p|li|figure|section)\s[^>]*?(?:class|id)\s*=\s*(?:"[^"]*\blogo\b[^"]*"|'[^']*\blogo\b[^']*'|logo\b)[^>]*>"""
    r"(?:[^<]++|<(?!/(?:div|header|section|li|figure|h1)\b|img\b)[^>]*+>)*+<img\s([^>]*)>"
)
#: Domains of social platforms.
SOCIAL = r"(?i)href\s*=\s*[\"']?[^\"'>\s]*(facebook\.com|fb\.com|twitter\.com|x\.com|instagram\.com|linkedin\.com|youtube\.com|youtu\.be|tiktok\.com|pinterest\.com|github\.com)"


def _all(col: Column, pattern: str, group: int = 1) -> Column:
    return F.regexp_extract_all(col, F.lit(pattern), F.lit(group))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in a tag's inner text: in double quotes, in single ones or without; empty if missing."""
    pattern = rf"""(?i)(?:^|[\s"'/]){name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return entities(F.concat(*[F.regexp_extract(tag, pattern, i) for i in (1, 2, 3)]))


def anchor_href(piece: Column) -> Column:
    """Target of an anchor element; empty if it has none or one within the page."""
    href = F.trim(attribute(F.regexp_extract(piece, r"(?i)^<a\s([^>]*)>", 1), "href"))
    return F.when(href.startswith("#"), "").otherwise(href)


def anchor_label(piece: Column) -> Column:
    return F.regexp_replace(piece, r"(?i)^<a\s[^>]*>|</a\s*>$", "")


def without_scripts(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style)\b[^>]*>.*?</(script|style)\s*>", " ")


def parse_pages(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> one wide row per page, without the HTML.

    A page whose HTML is null or empty gives a row of empty values, never none. Paragraphs count beyond 20
    characters; anchors beginning with # don't count; the text is that of all paragraphs.
    """
    html = F.coalesce("html", F.lit(""))
    body = F.col("body")
    zipped = lambda pattern: F.arrays_zip(_all(body, pattern, 1).alias("a"), _all(body, pattern, 2).alias("b"))
    metas = F.transform(_all(html, META), lambda t: F.struct(F.lower(F.coalesce(F.nullif(attribute(t, "name"), F.lit("")), attribute(t, "property"))).alias("k"), attribute(t, "content").alias("v")))
    base = pages.withColumn("body", without_scripts(html)).withColumn("boxes", F.when(F.lower(body).contains("logo"), _all(body, LOGO_BOX)).otherwise(F.array()))
    raw = base.select(
        F.col("page_id"),
        F.col("url"),
        url_host(F.col("url")).alias("site"),
        plain(F.regexp_extract(html, r"(?i)<title[^>]*>([^<]*)</title>", 1)).alias("title"),
        F.filter(F.transform(zipped(HEADING), lambda h: F.struct(F.lower(h["a"]).alias("tag"), plain(h["b"]).alias("text"))), lambda h: h["text"] != "").alias("headings"),
        F.filter(F.transform(_all(body, PARAGRAPH), plain), lambda p: F.length(p) > 20).alias("paragraphs"),
        F.filter(F.transform(_all(body, ANCHOR, 0), lambda a: F.struct(anchor_href(a).alias("href"), plain(anchor_label(a)).alias("label"))), lambda a: a["href"] != "").alias("anchors"),
        F.transform(_all(body, IMAGE), lambda t: image(t, F.col("boxes"))).alias("images"),
        F.filter(F.transform(_all(body, VIDEO, 0), video), lambda v: v["src"] != "").alias("videos"),
        F.filter(metas, lambda m: m["k"] != "").alias("metas"),
        F.coalesce(F.try_element_at(F.transform(F.filter(_all(html, r"(?i)<link\s([^>]*)>"), lambda t: F.lower(attribute(t, "rel")) == "canonical"), lambda t: attribute(t, "href")), F.lit(1)), F.lit("")).alias("canonical_href"),
        F.regexp_extract(html, r"(?is)<nav[^>]*>(.*?)</nav>", 1).alias("nav"),
        F.regexp_extract(html, r"(?is)<footer[^>]*>(.*?)</footer>", 1).alias("footer"),
        _all(html, JSONLD).alias("jsonld"),
        F.octet_length(html).cast("bigint").alias("content_length_bytes"),
    )
    meta = lambda k: F.try_element_at(F.filter("metas", lambda m: m["k"] == k), F.lit(-1))["v"]
    links = F.transform("anchors", lambda a: F.struct(drop_fragment(resolve_url(a["href"], F.col("url"))).alias("href"), a["label"].alias("label")))
    wide = raw.withColumn("links", links).withColumn("text", F.array_join("paragraphs", " "))
    h1 = F.filter("headings", lambda h: h["tag"] == "h1")
    paragraph = F.element_at("paragraphs", 1)
    first = F.when(F.size("paragraphs") > 0, F.when(F.length(paragraph) > 200, F.concat(F.left(paragraph, F.lit(200)), F.lit("..."))).otherwise(paragraph))
    return wide.select(
        "page_id", "url", "site", "title", "headings", "paragraphs", "text", "links", "images", "videos", "metas", "jsonld", "content_length_bytes",
        F.when(F.size(h1) > 0, F.element_at(h1, 1)["text"]).alias("h1"),
        F.coalesce(F.try_element_at(F.filter(F.array(meta("description"), meta("og:description"), first), lambda d: F.coalesce(d, F.lit("")) != ""), F.lit(1)), F.lit("")).alias("description"),
        F.when(F.col("canonical_href") == "", F.col("url")).otherwise(resolve_url(F.col("canonical_href"), F.col("url"))).alias("canonical"),
        F.coalesce(meta("robots"), F.lit("")).alias("robots"),
        (F.coalesce(meta("viewport"), F.lit("")) != "").alias("has_viewport"),
        F.size(F.filter(_all(F.col("nav"), ANCHOR, 0), lambda a: anchor_href(a) != "")).alias("nav_links"),
        F.transform(_all(F.col("nav"), ANCHOR, 0), anchor_label).alias("nav_labels"),
        F.col("footer").rlike(SOCIAL).alias("footer_social"),
        F.size(F.filter(_all(F.col("footer"), ANCHOR, 0), lambda a: (anchor_href(a) != "") & (plain(anchor_label(a)) != ""))).alias("footer_links"),
        clean_text(plain(F.col("footer"))).alias("footer_text"),
        word_count(F.col("text")).alias("words"),
        F.size("links").alias("n_links"),
        F.size(F.filter("links", lambda x: is_internal(x["href"], F.col("url")))).alias("n_internal"),
        F.size("images").alias("n_images"),
    )


def image(tag: Column, boxes: Column) -> Column:
    """An img tag as (src, alt, css, id, srcset, width, height, boxed): ``data-src`` stands in for a missing src; boxed, if
    it stands in an element called a logo; sizes are whole pixels, null where they are none."""
    pixels = lambda name: F.nullif(F.regexp_extract(attribute(tag, name), r"^\s*([0-9]{1,6})(?:px)?(?:\.[0-9]+)?\s*$", 1), F.lit("")).cast("int")
    src = F.coalesce(F.nullif(attribute(tag, "src"), F.lit("")), attribute(tag, "data-src"))
    return F.struct(
        src.alias("src"), attribute(tag, "alt").alias("alt"), attribute(tag, "class").alias("css"), attribute(tag, "id").alias("id"), attribute(tag, "srcset").alias("srcset"),
        pixels("width").alias("width"), pixels("height").alias("height"), F.array_contains(boxes, tag).alias("boxed"),
    )


def video(piece: Column) -> Column:
    """What ``VIDEO`` matches as (src, kind): the element's own src, else its first source's; kind mp4 or embed."""
    frame = F.lower(piece).startswith("<iframe")
    own, source = attribute(F.regexp_extract(piece, r"^<([^>]*)>", 1), "src"), attribute(F.regexp_extract(piece, r"(?i)<source\b([^>]*)>$", 1), "src")
    return F.struct(F.trim(F.when(frame | (own != ""), own).otherwise(source)).alias("src"), F.when(frame, "embed").otherwise("mp4").alias("kind"))


def page_videos(parsed: DataFrame) -> DataFrame:
    """(site, url, video_url, pos, kind): videos and embedded frames of a page by absolute URL, the first of each kept; those
    without a source are none. ``pos`` counts those with one."""
    rows = parsed.select("site", "url", F.posexplode("videos").alias("pos", "v")).select("site", "url", resolve_url(F.col("v.src"), F.col("url")).alias("video_url"), "pos", "v.kind")
    return rows.groupBy("site", "url", "video_url").agg(F.min("pos").alias("pos"), F.min_by("kind", "pos").alias("kind"))


def page_jsonld(parsed: DataFrame) -> DataFrame:
    """(site, url, pos, type, payload): JSON-LD blocks of a page that hold JSON; others are left out, and ``pos`` counts all.
    ``type`` is @type of an object as text, else null."""
    rows = parsed.select("site", "url", F.posexplode("jsonld").alias("pos", "payload")).withColumn("payload", F.trim("payload"))
    return rows.where(F.try_parse_json("payload").isNotNull()).select("site", "url", "pos", F.get_json_object("payload", "$['@type']").alias("type"), "payload")


def page_links(parsed: DataFrame) -> DataFrame:
    """One row per anchor: site, url, pos, href, label, kind."""
    rows = parsed.select("site", "url", F.posexplode("links").alias("pos", "link"))
    kind = F.when(is_internal(F.col("link.href"), F.col("url")), "internal").otherwise("external")
    return rows.select("site", "url", "pos", "link.href", "link.label", kind.alias("kind"))


def page_headings(parsed: DataFrame) -> DataFrame:
    return parsed.select("site", "url", F.posexplode("headings").alias("pos", "h")).select("site", "url", "pos", "h.tag", "h.text")


def page_paragraphs(parsed: DataFrame) -> DataFrame:
    return parsed.select("site", "url", F.posexplode("paragraphs").alias("pos", "text"))


def page_images(parsed: DataFrame) -> DataFrame:
    """Images of a page by absolute URL, the first of each kept, with its size in pixels and whether it is a GIF."""
    rows = parsed.select("site", "url", F.posexplode("images").alias("pos", "i")).where("i.src <> ''")
    rows = rows.select("site", "url", resolve_url(F.col("i.src"), F.col("url")).alias("img_url"), "pos", F.col("i.alt").alias("alt"), "i.width", "i.height")
    first = [F.min_by(c, "pos").alias(c) for c in ("alt", "width", "height")]
    return rows.groupBy("site", "url", "img_url").agg(F.min("pos").alias("pos"), *first).withColumn("gif", F.lower("img_url").rlike(r"\.gif(?:[?#]|$)"))


def page_files(parsed: DataFrame) -> DataFrame:
    """Links to documents and archives; the label defaults to "Download EXT"."""
    ext = F.regexp_extract(F.lower("href"), FILE, 1)
    return page_links(parsed).withColumn("type", ext).where("type <> ''").select("site", "url", "href", "type", F.when(F.col("label") == "", F.concat(F.lit("Download "), F.upper("type"))).otherwise(F.col("label")).alias("label"))


def classify_block_page(status: Column, html: Column) -> Column:
    """Why a page is a block page rather than content, else null."""
    #: Fixed values
    words = ["robot or human", "are you a robot", "bot detection", "captcha", "unusual traffic", "access denied"]
    head = F.lower(F.left(html, F.lit(4096)))
    return F.when(status.isin(403, 409, 423, 429, 503), F.concat(F.lit("http_status_"), status.cast("string"))).when(head.rlike("|".join(words)), "captcha_content")


def classify_content_type(header: Column, url: Column) -> Column:
    """html, pdf, docx, json, csv, image or text: by the header if it tells, else by the extension, else html."""
    kind = F.lower(F.trim(F.substring_index(F.coalesce(header, F.lit("")), ";", 1)))
    ext = F.lower(F.regexp_extract(F.substring_index(F.substring_index(url, "#", 1), "?", 1), r"\.([A-Za-z0-9]+)$", 1))
    by_header = (
        F.when(kind.contains("html"), "html").when(kind == "application/pdf", "pdf").when(kind.contains("wordprocessingml"), "docx").when(kind.contains("json"), "json").when(kind.contains("csv"), "csv")
        .when(kind.startswith("image/"), "image").when(kind.startswith("text/"), "text")
    )
    by_name = F.when(ext.isin("html", "htm"), "html").when(ext.isin("pdf", "docx", "json", "csv"), ext).when(ext.isin("png", "jpg", "jpeg", "gif", "webp", "svg"), "image").when(ext == "txt", "text")
    return F.coalesce(by_header, by_name, F.lit("html"))
