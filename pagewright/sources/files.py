"""Readers and writers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

INDEX = "pageId string, titleGuess string, path string, url string, status int, words int, mediaCount int, status_code int, loadTimeMs int, contentLengthBytes bigint, page_type string"


def read_pages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_run_index(spark: SparkSession, glob: str) -> DataFrame:
    """Recorded page indexes; the run id is the folder's name."""
    rows = spark.read.schema(INDEX).option("multiLine", True).json(glob)
    return rows.withColumn("run_id", F.regexp_extract("_metadata.file_path", r"/([^/]+)/pages_index\.json$", 1)).withColumn("status", F.coalesce("status", "status_code")).drop("status_code")


def write_pages(pages: DataFrame, path: str) -> None:
    pages.write.mode("append").partitionBy("site").parquet(path)


def write_articles_jsonl(articles: DataFrame, path: str) -> None:
    articles.write.mode("append").json(path)


def json_profile(rows: DataFrame) -> DataFrame:
    """(id, payload) -> top-level kind, length, first five keys of a JSON payload; a bad one is ``invalid``."""
    keys = F.json_object_keys("payload")
    v = F.try_parse_json("payload")
    kind = F.when(v.isNull(), "invalid").when(keys.isNotNull(), "object").when(F.json_array_length("payload").isNotNull(), "array").otherwise("scalar")
    return rows.select("id", kind.alias("kind"), F.length("payload").alias("size"), F.coalesce(F.array_join(F.slice(keys, 1, 5), ","), F.lit("")).alias("first_keys"))


def csv_profile(rows: DataFrame) -> DataFrame:
    """(id, payload) -> header columns and data rows of a CSV payload."""
    lines = F.filter(F.split("payload", "\r?\n"), lambda x: x != "")
    return rows.select("id", F.size(F.split(F.element_at(lines, 1), ",")).alias("columns"), (F.size(lines) - 1).alias("rows"))
