"""Helpers the training-data operators share: durable intermediate tables and row tests."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, as in the word class ``[^\x20\x09-\x0D]+``.
BLANKS = r"[\x20\x09-\x0D]+"


#: Rows that Spark passes to Python at a time, where the session sets no number.
BATCH_OPTION, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1_000


def short_batches(spark: SparkSession) -> None:
    """Whole texts are long, and Spark, Arrow and Python each hold a batch of them: take fewer rows than Spark's default,
    unless the session names a number of its own."""
    if BATCH_OPTION not in spark.conf.getAll:
        spark.conf.set(BATCH_OPTION, str(BATCH_ROWS))


@contextmanager
def batches_restored(spark: SparkSession) -> Iterator[None]:
    """Whatever ``short_batches`` sets inside ends with the block."""
    own = BATCH_OPTION in spark.conf.getAll
    try:
        yield
    finally:
        if not own:
            spark.conf.unset(BATCH_OPTION)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir; a temporary one only where that is unset on a local master."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if where:
        return where
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
    where = os.path.join(tempfile.gettempdir(), f"pagewright-{os.getuid()}")
    spark.conf.set("spark.checkpoint.dir", where)
    return where


def saved(df: DataFrame, name: str, by: str | None = None) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back: lineage ends there, so a lost
    executor costs a re-read instead of the work above. ``by``: a column to part its files by."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path, partitionBy=by)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """A ``saved`` whose tables go when the block ends; what the block returns must not read them any more."""
    where = f"scratch-{uuid.uuid4().hex}"
    yield lambda df, name: saved(df, f"{where}/{name}")
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/{where}")
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def crc_bucket(col: str | Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; a null id counts as the empty text."""
    c = F.col(col) if isinstance(col, str) else col
    return F.crc32(F.coalesce(c.cast("string"), F.lit("")).cast("binary")) % F.lit(modulus)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't use, for operators that keep a caller's extra columns."""
    taken, name = {c.lower() for c in df.columns}, stem
    while name.lower() in taken:
        name = f"_{name}"
    return name
