"""Runs numpy functions of matrices over Spark columns of arrays: rows of equal length are stacked within an Arrow batch."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql.functions import arrow_udf


def rows_of(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """(row numbers, matrix) for each length of the arrays; null arrays are in none."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    sizes = np.diff(offsets)
    valid = column.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for n in np.unique(sizes[valid]):
        at = np.flatnonzero(valid & (sizes == n))
        out.append((at, values[offsets[at][:, None] + np.arange(n)] if n else np.zeros((len(at), 0))))
    return out


def matrix_udf(function: Callable[[np.ndarray], np.ndarray]):
    """A column function array<double> -> array<double> from a function of matrices that keeps the number of rows. Null stays null."""

    def run(column: pa.Array) -> pa.Array:
        parts, sizes, valid = [None] * len(column), np.zeros(len(column), np.int64), np.zeros(len(column), bool)
        for at, matrix in rows_of(column):
            result = np.asarray(function(matrix), np.float64)
            valid[at], sizes[at] = True, result.shape[1]
            for i, row in zip(at.tolist(), result, strict=True):
                parts[i] = row
        values = np.concatenate([p for p in parts if p is not None] or [np.zeros(0)])
        offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(~valid))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return arrow_udf(run, "array<double>")


def arrow_rows_udf(function: Callable[[np.ndarray], pa.Array], result: str, arrow: pa.DataType):
    """A column function from a function that gives, for a matrix, an Arrow array with one value for each row. Null stays null."""

    def run(column: pa.Array) -> pa.Array:
        found, at = [pa.array([], arrow)], np.full(len(column), -1)
        for rows, matrix in rows_of(column):
            at[rows] = sum(map(len, found)) + np.arange(len(rows))
            found.append(function(matrix).cast(arrow))
        return pa.concat_arrays(found).take(pa.array(at, mask=at < 0))

    run.__annotations__ = {"column": pa.Array, "return": pa.Array}
    return arrow_udf(run, result)
