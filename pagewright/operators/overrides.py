"""Page types that users set by hand, merged onto the inferred ones as they stood at a time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The page types there are.
PAGE_TYPES = ["article", "landing", "catalog", "product", "media_gallery", "contact", "utility", "generic"]


def override_page_type(pages: DataFrame, overrides: DataFrame) -> DataFrame:
    """``pages(page_id, page_type, run_at)`` and ``overrides(page_id, page_type, set_at, seq)`` -> (page_id, page_type,
    inferred_type, set_at, overridden): the last valid override set before or at the page's run, else the inferred type.

    Types that don't exist, null ids and overrides after the run don't count; of overrides set at one time the one with
    the highest ``seq`` wins, of equal ones the smaller type. The overrides of a page are combined before and after the
    shuffle by their maximum, so a page that was set a million times is no long group; pages keep their rows, repeated
    ones too.
    """
    valid = overrides.where(F.col("page_type").isin(PAGE_TYPES) & F.col("set_at").isNotNull() & F.col("page_id").isNotNull())
    asked = pages.where("page_id is not null and run_at is not null").select(F.col("page_id").alias("p"), "run_at").distinct()
    hits = valid.join(asked, (valid.page_id == F.col("p")) & (valid.set_at <= F.col("run_at")))
    kind = F.lit(len(PAGE_TYPES)) - F.array_position(F.lit(sorted(PAGE_TYPES)), F.col("page_type")).cast("int")
    last = hits.groupBy("p", "run_at").agg(F.max_by(F.struct("page_type", "set_at"), F.struct("set_at", F.coalesce("seq", F.lit(-1)), kind)).alias("o"))
    last = last.select("p", F.col("run_at").alias("r"), F.col("o.page_type").alias("set_type"), F.col("o.set_at").alias("set_at"))
    rows = pages.join(last, (pages.page_id == F.col("p")) & (pages.run_at == F.col("r")), "left")
    return rows.select("page_id", F.coalesce("set_type", "page_type").alias("page_type"), F.col("page_type").alias("inferred_type"), "set_at", F.col("set_type").isNotNull().alias("overridden"))
