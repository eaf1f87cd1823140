"""Arrow list columns as matrices; imported by tasks, so it stays light."""

import numpy as np
import pyarrow as pa


def matrix_of(column: pa.Array) -> np.ndarray:
    """Rows of an Arrow list column as a matrix; NULL items become NaN, and all lists must be there and equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    rows = len(column)
    if column.null_count:
        raise ValueError(f"{column.null_count} of {rows} feature arrays are NULL")
    sizes = np.diff(column.offsets.to_numpy())
    if rows and (sizes != sizes[0]).any():
        raise ValueError(f"feature arrays have from {sizes.min()} to {sizes.max()} items")
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(rows, -1) if rows else np.zeros((0, 0))


def column_medians(column: pa.Array, parts: list[np.ndarray]) -> pa.Array:
    """Element-wise medians of groups of rows: NULL items are left out, NaN is the largest value."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    x = matrix_of(column)
    if not np.isnan(x).any():
        return list_column(np.vstack([np.median(x[part], axis=0) for part in parts]))
    missing = column.flatten().is_null().to_numpy(zero_copy_only=False).reshape(x.shape)
    out = []
    for part in parts:
        row = []
        for values, gone in zip(x[part].T, missing[part].T):
            kept = np.sort(values[~gone])
            row.append(float((kept[(len(kept) - 1) // 2] + kept[len(kept) // 2]) / 2) if len(kept) else None)
        out.append(row)
    return pa.array(out, pa.list_(pa.float64()))


def list_column(matrix: np.ndarray) -> pa.Array:
    """A matrix as an Arrow list column."""
    rows, width = matrix.shape
    offsets = pa.array(np.arange(rows + 1, dtype=np.int32) * width)
    return pa.ListArray.from_arrays(offsets, pa.array(np.ascontiguousarray(matrix).ravel()))
