"""Vectors as integers: floor(256 * x) of every component, x in double precision."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

#: Largest size of a component for which the squared distance of 64 of them fits a long.
MOST = 1 << 27
#: Sizes up to which sums of products are exact in double precision.
EXACT = 1 << 22


def quantised(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, their components as int32) for every length of vector in a list column.

    Vectors that are null, or hold null, non-finite or (past MOST) too large components are left out.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not len(column):
        return
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)
    size, there = np.diff(offsets), column.is_valid().to_numpy(zero_copy_only=False)
    for n in np.unique(size[there]).tolist():
        rows = np.flatnonzero(there & (size == n))
        with np.errstate(over="ignore", invalid="ignore"):
            x = np.floor(256 * values[offsets[rows][:, None] + np.arange(n)])
            fine = (np.abs(x) <= MOST).all(1)  # False for NaN and infinity
        if fine.any():
            yield rows[fine], x[fine].astype(np.int32)


def packed(q: np.ndarray) -> pa.Array:
    return pa.array([x.tobytes() for x in q.astype(np.int32)], pa.binary())


def unpacked(column: pa.Array | pa.ChunkedArray, dims: int) -> np.ndarray:
    """The rows of a column made by packed, all of ``dims`` components."""
    return np.frombuffer(b"".join(x.as_py() for x in column), np.int32).reshape(len(column), dims).astype(np.int64)


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of all rows of a with all rows of b."""
    if max(np.abs(a).max(initial=0), np.abs(b).max(initial=0)) <= EXACT and a.shape[1] <= 256:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distances of all rows of a from all rows of b."""
    return (a * a).sum(1)[:, None] + (b * b).sum(1)[None, :] - 2 * products(a, b)
