"""Vectors as whole numbers, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F


def usable(vector: str) -> Column:
    """No null or non-finite component; false for a null vector."""
    bad = F.exists(vector, lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    return F.coalesce(~bad, F.lit(False))


def whole(vector: str, scale: int) -> Column:
    """floor(scale * component) as bigint; values beyond its range become its ends."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("bigint"))


def shape(rows: DataFrame, x: str = "x") -> tuple[int, int, float]:
    """Rows, components of the longest vector, and a bound of the squared norms."""
    norm = F.aggregate(x, F.lit(0.0), lambda s, c: s + c.cast("double") * c.cast("double"))
    n, width, most = rows.agg(F.count("*"), F.max(F.size(x)), F.max(norm)).first()
    return n, width or 0, (most or 0.0) * (1 + 1e-9)


def matrix(column: pa.ListArray, width: int, dtype) -> np.ndarray:
    """One row per vector; vectors that are too short end in zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    sizes = column.value_lengths().to_numpy(zero_copy_only=False)
    if (sizes == width).all():
        return flat.reshape(len(sizes), width).astype(dtype)
    out = np.zeros((len(sizes), width), dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out
