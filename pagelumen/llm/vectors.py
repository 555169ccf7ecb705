"""Vectors as exact integers: what the operators on embeddings share."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def finite(v: Column) -> Column:
    """Not null, and without null or non-finite components."""
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return v.isNotNull() & ~F.coalesce(bad, F.lit(True))


def equally_long(rows: DataFrame, vector: str = "v") -> tuple[DataFrame, int]:
    """The rows with shorter vectors continued by zeros, and the common length."""
    least, most = rows.agg(F.min(F.size(vector)), F.max(F.size(vector))).first()
    if most is None:
        return rows, 0
    if least != most:
        rows = rows.withColumn(vector, F.concat(vector, F.array_repeat(F.lit(0.0), F.lit(most) - F.size(vector))))
    return rows, most


def largest(dim: int) -> int:
    """The bound of an integer component at which no distance or product of two vectors leaves 64 bits."""
    return math.isqrt((1 << 60) // max(1, dim))


def integers(column: pa.Array, dim: int, scale: int) -> np.ndarray:
    """floor(scale * x) of vectors of one length, as a matrix of 64-bit integers, held within ``largest``."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    bound = float(largest(dim))
    return np.clip(np.floor(flat * scale), -bound, bound).astype(np.int64).reshape(len(column), dim)
