"""Arrow columns of float vectors as matrices, and which rows take part."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_usable(column: str = "embedding") -> Column:
    """Whether a vector is not null, not empty, not all zero, and holds finite numbers only."""
    v = F.col(column)
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(v.isNotNull() & (F.size(v) > 0) & ~odd & F.exists(v, lambda x: x != 0), F.lit(False))


def usable(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    return vectors.filter(is_usable(column))


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, dimensions) in double precision; all rows have the same length."""
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))
