"""The title of a page, as the first good one of its candidates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.functions.urls import url_path

#: What no good title holds (phone numbers, calls to action), and what a company's name does.
TITLE_PHONE = r"\([0-9]{3}\)\s*[0-9]{3}-[0-9]{4}|[0-9]{3}-[0-9]{3}-[0-9]{4}|[0-9]{3}\.[0-9]{3}\.[0-9]{4}"
TITLE_ACTIONS = (
    "call us at|contact us|get a quote|free estimate|click here|learn more|read more|view more|shop now|buy now|sign up|subscribe|follow us|like us|share|download|free|sale|special offer"
)
COMPANY = (
    r"\b(inc|llc|ltd|corp|corporation|company|co\.|group|solutions|services|systems|technologies|tech)\b"
    r"|\b(exterior|interior|construction|building|roofing|siding|landscaping|maintenance|upkeep)\b"
    r"|\b(northshore|north shore|southshore|south shore|eastside|westside)\b"
)
HOME_PATHS = ["", "index", "index.html", "home"]


def is_good_title(title: Column) -> Column:
    """Five characters or more, three Latin letters among them, no phone number and no call to action; null is not good."""
    letters = F.length(F.regexp_replace(title, "[^a-zA-Z]", ""))
    good = (F.length(title) >= 5) & ~title.rlike(TITLE_PHONE) & ~F.lower(title).rlike(TITLE_ACTIONS) & (letters >= 3)
    return F.coalesce(good, F.lit(False))


def looks_like_company(title: Column) -> Column:
    """A company's words, over 30 characters, or three words and more."""
    words = F.size(F.filter(F.split(title, r"\s+"), lambda w: w != ""))
    return F.coalesce(F.lower(title).rlike(COMPANY) | (F.length(title) > 30) | (words >= 3), F.lit(False))


def is_home(url: Column) -> Column:
    return F.regexp_replace(url_path(url), "^/+|/+$", "").isin(HOME_PATHS)


def title_candidates() -> Column:
    """Of a parsed page, in order of trust: og:title, title, first h1, each h2, each h3, as (origin, text)."""
    one = lambda origin, text: F.struct(F.lit(origin).alias("origin"), F.trim(F.coalesce(text, F.lit(""))).alias("text"))
    og = F.try_element_at(F.filter("metas", lambda m: m["k"] == "og:title"), F.lit(1))["v"]
    level = lambda tag: F.transform(F.filter("headings", lambda h: h["tag"] == tag), lambda h: F.struct(F.lit(tag).alias("origin"), F.trim(h["text"]).alias("text")))
    return F.concat(F.array(one("og:title", og), one("title", F.col("title"))), F.slice(level("h1"), 1, 1), level("h2"), level("h3"))


def page_titles(parsed: DataFrame) -> DataFrame:
    """``parse_pages`` -> (page_id, url, page_title, origin): the first good candidate. A heading of a home page that looks
    like a company's name gives "Home", as does a home page without a good candidate; any other page without one has an
    empty title of origin "none"."""
    first = F.try_element_at(F.filter(title_candidates(), lambda c: is_good_title(c["text"])), F.lit(1))
    rows = parsed.select("page_id", "url", is_home(F.col("url")).alias("home"), first.alias("c"))
    named = F.col("home") & F.col("c.origin").isin("h1", "h2", "h3") & looks_like_company(F.col("c.text"))
    title = F.when(F.col("c").isNull(), F.when(F.col("home"), "Home").otherwise("")).when(named, "Home").otherwise(F.col("c.text"))
    origin = F.when(F.col("c").isNull(), F.when(F.col("home"), "home").otherwise("none")).when(named, "home").otherwise(F.col("c.origin"))
    return rows.select("page_id", "url", title.alias("page_title"), origin.alias("origin"))
