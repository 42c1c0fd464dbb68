"""Vector columns: which rows count, and Arrow lists as numpy matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def vector_column(df: DataFrame, name: str) -> Column:
    """The column as an array of float or double; other element types become double."""
    kind = df.schema[name].dataType.simpleString()
    return F.col(name) if kind in ("array<float>", "array<double>") else F.col(name).cast("array<double>")


def is_finite(vector: Column) -> Column:
    """Not null, not empty, and every component is a finite number."""
    ok = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    return F.coalesce((F.size(vector) > 0) & ok, F.lit(False))


def matrices(column: pa.Array):
    """(row numbers, matrix) of the rows of each length of a list column without nulls."""
    offsets = column.offsets.to_numpy()
    values, length = column.values.to_numpy(zero_copy_only=False), np.diff(offsets)
    for n in np.unique(length):
        rows = np.flatnonzero(length == n)
        yield rows, values[offsets[rows][:, None] + np.arange(n)]


def list_array(matrix: np.ndarray) -> pa.ListArray:
    """A matrix as a list column of its rows."""
    n, width = matrix.shape
    return pa.ListArray.from_arrays(pa.array(np.arange(0, n * width + 1, max(1, width), dtype=np.int32)[: n + 1] if width else np.zeros(n + 1, np.int32)), pa.array(np.ascontiguousarray(matrix).ravel()))
