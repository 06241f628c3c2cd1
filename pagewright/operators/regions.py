"""Navigation, footers and tables of pages, by built-in expressions over the slice of HTML that holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.text import EMAIL, plain
from pagewright.functions.urls import drop_fragment, resolve_url, url_host
from pagewright.operators.parse import ANCHOR, anchor_href, anchor_label, without_scripts

#: What no navigation label holds, labels that always are some, and what longer labels don't hold.
LABEL_PHONE = r"\([0-9]{3}\)\s*[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}"
LABEL_ACTIONS = "call us at|get a quote|free estimate|click here|learn more|read more|view more|shop now|buy now|sign up|subscribe|follow us|like us|share|download|sale|special offer"
LABEL_COMMON = (
    "home|about|about us|contact|contact us|services|service|work|blog|news|shop|store|products|gallery|portfolio|team|careers|jobs|faq|help|support|login|register|account|profile|settings|admin|dashboard|menu|search"
)
LABEL_PROMOTION = "@|mail|now available|limited time|act now"
#: Fixed value: the phone number of a footer; its groups are joined.
FOOTER_PHONE = r"(\+?1?[-.\s]?)?\(?([0-9]{3})\)?[-.\s]?([0-9]{3})[-.\s]?([0-9]{4})"
#: Content of an element up to the next tag that starts or ends one of its kind.
TABLE = r"(?is)<table\b[^>]*>(.*?)</table>"
ROW = r"(?is)<tr\b[^>]*>(.*?)(?=<tr\b|</tr>|$)"
CELL = r"(?is)<t[dh]\b[^>]*>(.*?)(?=<t[dhr]\b|</t[dhr]>|$)"


def is_nav_label(label: Column) -> Column:
    """No phone number, call to action, address or promotion; common words always pass, others by length and letters."""
    low = F.lower(label)
    long_ = F.length(label) >= 5
    return (
        F.when((label == "") | label.rlike(LABEL_PHONE) | low.rlike(LABEL_ACTIONS), False).when(low.rlike(f"^({LABEL_COMMON})$"), True).when(long_ & low.rlike(LABEL_PROMOTION), False)
        .when(long_ & (F.size(F.split(low, " ")) <= 5), True).otherwise((F.length(label) >= 3) & (F.length(F.regexp_replace(label, "[^a-zA-Z]", "")) >= 2))
    )


def _pieces(pages: DataFrame, region: str, pattern: str) -> DataFrame:
    """(page_id, url, site, pos, piece): what ``pattern`` finds, in order, in the first ``region`` of each page."""
    html = F.regexp_extract(without_scripts(F.coalesce("html", F.lit(""))), rf"(?is)<{region}[^>]*>(.*?)</{region}>", 1)
    return pages.select("page_id", "url", url_host(F.col("url")).alias("site"), F.posexplode(F.regexp_extract_all(html, F.lit(pattern), F.lit(0))).alias("pos", "piece"))


def _link(rows: DataFrame) -> DataFrame:
    """Anchors among the pieces get an absolute href and a label; anchors without a target go."""
    to, is_link = anchor_href(F.col("piece")), F.col("piece").rlike(r"(?i)^<a\s")
    rows = rows.where(~is_link | (to != "")).withColumn("href", F.when(is_link, drop_fragment(resolve_url(to, F.col("url")))))
    return rows.withColumn("label", plain(anchor_label(F.col("piece"))))


def nav_nodes(pages: DataFrame) -> DataFrame:
    """``pages(page_id, url, html)`` -> (page_id, site, pos, level, parent, href, label): links of the page's first
    ``<nav>`` with a label fit for navigation, each URL once, its first place kept.

    Links inside a nested list are of level 2, their parent is the last link of level 1 before them. The windows are over
    one page's navigation. A page without navigation has no rows.
    """
    rows = _link(_pieces(pages, "nav", rf"(?i)<ul\b|</ul>|{ANCHOR}"))
    order = Window.partitionBy("page_id", "url").orderBy("pos")
    step = F.when(F.lower("piece") == "<ul", 1).when(F.lower("piece") == "</ul>", -1).otherwise(0)
    rows = rows.withColumn("level", F.when(F.sum(step).over(order) > 1, 2).otherwise(1)).where("href is not null").where(is_nav_label(F.col("label")))
    top = F.when(F.col("level") == 1, F.col("href"))
    rows = rows.withColumn("parent", F.when(F.col("level") == 2, F.last(top, ignorenulls=True).over(order)))
    first = Window.partitionBy("page_id", "url", "href").orderBy("pos")
    return rows.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("page_id", "site", "pos", "level", "parent", "href", "label")


def footer_links(pages: DataFrame) -> DataFrame:
    """``pages`` -> (page_id, site, pos, heading, href, label): labelled links of the page's first ``<footer>``
    with the last heading before them, null if there is none."""
    heading = r"(?i)<h[1-6][^>]*>[^<]*</h[1-6]>"
    rows = _link(_pieces(pages, "footer", f"{heading}|{ANCHOR}"))
    order = Window.partitionBy("page_id", "url").orderBy("pos")
    last = F.last(F.when(F.col("href").isNull(), plain(F.col("piece"))), ignorenulls=True).over(order)
    return rows.withColumn("heading", last).where("href is not null and label <> ''").select("page_id", "site", "pos", "heading", "href", "label")


def footer_contacts(pages: DataFrame) -> DataFrame:
    """``pages`` -> (page_id, site, email, phone): the first of each in the footer's text, else null."""
    text = plain(F.regexp_extract(without_scripts(F.coalesce("html", F.lit(""))), r"(?s)<footer[^>]*>(.*?)</footer>", 1))
    phone = F.concat(*[F.regexp_extract(text, FOOTER_PHONE, i) for i in (1, 2, 3, 4)])
    return pages.select("page_id", url_host(F.col("url")).alias("site"), F.nullif(F.regexp_extract(text, EMAIL, 0), F.lit("")).alias("email"), F.nullif(phone, F.lit("")).alias("phone"))


def table_cells(pages: DataFrame) -> DataFrame:
    """``pages`` -> (page_id, site, table_no, row_no, col_no, text) of every ``td`` and ``th``, counted from 0.

    Unclosed rows and cells end where the next one starts; of nested tables the outer ends with the inner.
    """
    found = lambda c, p: F.regexp_extract_all(F.col(c), F.lit(p), F.lit(1))
    base = pages.select("page_id", url_host(F.col("url")).alias("site"), without_scripts(F.coalesce("html", F.lit(""))).alias("h"))
    tables = base.select("page_id", "site", F.posexplode(found("h", TABLE)).alias("table_no", "t"))
    rows = tables.select("page_id", "site", "table_no", F.posexplode(found("t", ROW)).alias("row_no", "r"))
    return rows.select("page_id", "site", "table_no", "row_no", F.posexplode(found("r", CELL)).alias("col_no", "c")).withColumn("text", plain(F.col("c"))).drop("c")
