"""Arrow list columns as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def matrix(vectors: pa.Array) -> np.ndarray:
    """Rows of equal length as a float matrix, without a Python object per row.

    Missing rows and missing values become NaN.
    """
    n = len(vectors)
    if n == 0:
        return np.zeros((0, 0))
    lengths = vectors.value_lengths().to_numpy(zero_copy_only=False)
    width = int(np.nanmax(np.nan_to_num(lengths.astype(float))))
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(float, copy=False)
    if len(flat) == n * width:
        return flat.reshape(n, width)
    out = np.full((n, width), np.nan)
    at = 0
    for i, size in enumerate(np.nan_to_num(lengths.astype(float)).astype(int)):
        out[i, :size] = flat[at : at + size]
        at += size
    return out
