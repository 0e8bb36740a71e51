"""Vectors as packed rows: validity, unit length and classes of equal vectors."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(vectors: DataFrame, id_col: str, vec_col: str, *more: str) -> DataFrame:
    """``(id, v, *more)``: v is the vector as packed doubles.

    Vectors that are null, empty, zero, or hold a null or non-finite component are left out, and rows
    with a null id.
    """
    v = F.transform(F.col(vec_col), lambda x: x.cast("double"))
    rows = vectors.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), v.alias("v"), *more)
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = rows.where(F.col("v").isNotNull() & ~F.coalesce(bad, F.lit(True)) & F.exists("v", lambda x: x != 0))

    @F.pandas_udf("binary")
    def packed(rows: pd.Series) -> pd.Series:
        return rows.map(lambda x: (np.asarray(x, np.float64) + 0.0).tobytes())

    return rows.withColumn("v", packed("v"))


def matrix(blobs) -> np.ndarray:
    """Rows of packed doubles; shorter rows are not expected within one call."""
    return np.frombuffer(b"".join(blobs), np.float64).reshape(len(blobs), -1)


def unit(m: np.ndarray) -> np.ndarray:
    """Rows scaled to length one; scaled by their largest component first, so that nothing overflows."""
    m = m / np.abs(m).max(1, keepdims=True)
    return m / np.sqrt((m * m).sum(1, keepdims=True))


def cosines(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Cosine of each row of x with the row of y, in doubles."""
    return np.clip((unit(x) * unit(y)).sum(1), -1.0, 1.0)
