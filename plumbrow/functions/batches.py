"""Array columns of an Arrow batch as matrices, without an object per row."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, functions as F


def to_matrix(column: pa.Array) -> np.ndarray:
    """List column of equal lengths to rows × length; missing rows are refused."""
    if column.null_count:
        raise ValueError("array column has missing rows; impute first")
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def to_lists(matrix: np.ndarray) -> pa.Array:
    rows, width = matrix.shape
    return pa.ListArray.from_arrays(np.arange(rows + 1, dtype=np.int32) * width, np.ascontiguousarray(matrix).ravel())


def map_rows(column: Column, function: Callable[[np.ndarray], np.ndarray]) -> Column:
    """Apply a matrix function to an ``array<double>`` column, one Arrow batch at a time."""

    @F.arrow_udf("array<double>")
    def apply(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield to_lists(function(to_matrix(batch))) if len(batch) else pa.array([], pa.list_(pa.float64()))

    return apply(column)
