"""What the two vector operators share: which vectors count, and folding equal vectors into classes."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(col: str) -> Column:
    """Not null, not empty, not zero, every component finite."""
    return F.coalesce(
        F.expr(
            f"size({col}) > 0 and forall({col}, x -> x is not null and not isnan(x) and abs(x) < double('infinity'))"
            f" and exists({col}, x -> x <> 0)"
        ),
        F.lit(False),
    )


def unit_rows(column: pd.Series) -> np.ndarray:
    """Rows scaled to length 1 in double precision; the largest component comes first to 1, so no square over- or underflows."""
    x = np.array(column.tolist(), dtype=np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def as_doubles(df: DataFrame, col: str) -> DataFrame:
    """``col`` as array<double>, with -0.0 as 0.0 so that equal vectors are equal keys."""
    return df.withColumn(col, F.transform(F.col(col).cast("array<double>"), lambda x: x + F.lit(0.0)))
