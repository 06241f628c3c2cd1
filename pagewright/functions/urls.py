"""URL functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]+)"
ORIGIN = r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]+)"
FILE = r"\.(pdf|doc|docx|xls|xlsx|csv|txt|zip|rar)$"


def url_host(url: Column) -> Column:
    """Host with its port, lower case; empty for a relative URL."""
    return F.lower(F.regexp_extract(url, HOST, 1))


def url_path(url: Column) -> Column:
    path = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1)
    return F.when(path == "", "/").otherwise(path)


def path_segments(url: Column) -> Column:
    return F.filter(F.split(url_path(url), "/"), lambda s: s != "")


def drop_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def normalize_url(url: Column) -> Column:
    """No fragment, sorted query, a slash after a last segment without a dot, "/" for an empty path."""
    bare = drop_fragment(url)
    base = F.substring_index(bare, "?", 1)
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    host = F.regexp_extract(base, ORIGIN, 1)
    path = F.regexp_replace(base, ORIGIN, "")
    path = F.when(path == "", "/").when(path.endswith("/") | F.regexp_extract(path, r"([^/]*)$", 1).contains("."), path).otherwise(F.concat(path, F.lit("/")))
    sort = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda q: q != "")), "&")
    return F.concat(host, path, F.when(sort == "", "").otherwise(F.concat(F.lit("?"), sort)))


def resolve_url(href: Column, page: Column) -> Column:
    """``href`` as an absolute URL, seen from ``page``; dotted segments stay as they are."""
    bare = F.substring_index(drop_fragment(page), "?", 1)
    folder = F.when(F.regexp_replace(bare, ORIGIN, "") == "", F.concat(bare, F.lit("/"))).otherwise(F.regexp_replace(bare, r"[^/]*$", ""))
    return (
        F.when(href.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), href)
        .when(href.startswith("//"), F.concat(F.regexp_extract(page, r"^([A-Za-z][A-Za-z0-9+.-]*:)", 1), href))
        .when(href.startswith("/"), F.concat(F.regexp_extract(page, ORIGIN, 1), href))
        .when(href.startswith("?"), F.concat(bare, href))
        .otherwise(F.concat(folder, href))
    )


def is_internal(href: Column, page: Column) -> Column:
    """The page's host or one below it."""
    to, own = url_host(href), url_host(page)
    return (to == own) | ((own != "") & to.endswith(F.concat(F.lit("."), own)))
