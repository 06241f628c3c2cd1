"""The page index of a run as pages arrive: an upsert by page that keeps the first place and the last values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pagewright.functions.urls import url_path

#: Values of a page that an upsert replaces, and what a page that is new has where one is missing (fixed values).
VALUES = {"title": None, "path": "/", "url": None, "status": None, "words": 0, "media": 0, "load_time_ms": None, "content_length_bytes": None, "page_type": "generic"}


def page_index_stream(rows: DataFrame) -> DataFrame:
    """``rows(run, page_id, ts, seq, *VALUES)``, streaming or not -> (run, page_id, first, version, *VALUES), a row per
    page: its first and its last event as (ts, seq), and the values of the last.

    The state of a page is the least and the greatest event, so rows may come late, repeated and in any order, over any
    number of batches or a restart, and the result is that of one batch. It is built-in keyed state of an aggregation:
    run it in update mode, and take the greatest version of a page from what was put out (``index_view``). A page's state
    stays as long as the query, as its run may add to it at any time. A missing page id is left out; of events equal in
    ts and seq the greater values count.
    """
    event = F.struct("ts", "seq")
    last = F.max(F.struct(F.struct("ts", "seq").alias("event"), F.struct(*VALUES).alias("v")))
    agg = rows.where("page_id is not null").groupBy("run", "page_id").agg(F.min(event).alias("first"), last.alias("last"))
    fresh = F.col("first") == F.col("last.event")
    values = [F.when(fresh, F.coalesce(F.col(f"last.v.{c}"), F.lit(d))).otherwise(F.col(f"last.v.{c}")).alias(c) for c, d in VALUES.items()]
    return agg.select("run", "page_id", "first", F.col("last.event").alias("version"), *values)


def index_view(updates: DataFrame) -> DataFrame:
    """What ``page_index_stream`` put out -> (run, page_id, *VALUES, position): the last version of each page, counted
    from 1 in the order in which pages came first. Positions are counted run by run over one row a page."""
    newest = F.struct("version", -F.unix_micros("first.ts"), -F.col("first.seq"))  # a late first event comes with the same last one
    last = updates.groupBy("run", "page_id").agg(F.max_by(F.struct(*VALUES), newest).alias("v"), F.min("first").alias("first"))
    order = Window.partitionBy("run").orderBy("first", "page_id")
    return last.select("run", "page_id", *[F.col(f"v.{c}").alias(c) for c in VALUES], F.row_number().over(order).alias("position"))


def page_events(flags: DataFrame) -> DataFrame:
    """A page table as arrivals of one run a site: each page once, and every third again, as it was fetched anew, with
    another status and without a page type."""
    base = flags.select(
        F.col("site").alias("run"), "page_id", F.timestamp_seconds(F.lit(1_700_000_000) + F.col("page_id") % 997).alias("ts"), F.col("page_id").cast("bigint").alias("seq"), "title", url_path(F.col("url")).alias("path"), "url", "status",
        F.col("words").cast("bigint").alias("words"), F.col("n_images").cast("bigint").alias("media"), "load_time_ms", "content_length_bytes", F.when(F.col("page_id") % 2 == 0, F.col("page_type")).alias("page_type"),
    )
    again = base.where("page_id % 3 = 0").withColumns({"ts": F.expr("ts + interval 1 hour"), "status": F.lit(304), "page_type": F.lit(None).cast("string")})
    return base.unionByName(again)
