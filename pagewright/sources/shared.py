"""Intermediate tables in the folder that the driver and the executors share."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder in spark.checkpoint.dir and read again: lineage ends there, so that rounds don't stack
    up and a lost executor costs a re-read. Only where the setting is unset, on a local master, a temporary folder."""
    spark = df.sparkSession
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and the executors share")
        where = os.path.join(tempfile.gettempdir(), f"pagewright-{os.getuid()}")
    path = f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
