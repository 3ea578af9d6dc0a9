"""Columns of vectors as whole numbers, and as matrices inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Whole numbers beyond it, either way, count as it.
LARGEST = 1 << 55


def usable(vector: str) -> Column:
    """True for a vector that is not null and holds finite numbers only."""
    odd = lambda c: c.isNull() | F.isnan(c.cast("double")) | (F.abs(c.cast("double")) == float("inf"))
    return F.col(vector).isNotNull() & ~F.coalesce(F.exists(vector, odd), F.lit(False))


def floored(vector: str, factor: int, offset: int = 0) -> Column:
    """floor(factor * c) + offset of each component."""
    whole = lambda c: F.least(F.greatest(F.floor(c.cast("double") * factor), F.lit(-LARGEST)), F.lit(LARGEST)) + offset
    return F.transform(vector, whole)


def matrix(column: pa.Array | pa.ChunkedArray, width: int, missing: int = 0) -> np.ndarray:
    """The vectors as rows of whole numbers; components that a shorter one lacks are filled."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64, copy=False)
    lengths = column.value_lengths().to_numpy(zero_copy_only=False)
    if len(column) * width == len(values):
        return values.reshape(len(column), width)
    rows = np.full((len(column), width), missing, np.int64)
    rows[np.arange(width) < lengths[:, None]] = values
    return rows
