"""Vectors as matrices: what tasks make of Arrow columns of lists or of packed numbers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def lengths(column: pa.Array) -> np.ndarray:
    """The length of each list, -1 for a null and for a list with a null in it."""
    n = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False).astype(np.int64)
    values = column.flatten()
    if values.null_count:
        rows = pc.list_parent_indices(column).to_numpy(zero_copy_only=False)
        n[np.unique(rows[values.is_null().to_numpy(zero_copy_only=False)])] = -1
    return n


def matrix(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, vectors): the places of lists of that size that are whole, finite and not zero, and their values in double precision."""
    at = np.flatnonzero(lengths(column) == size)
    x = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), size)
    good = np.isfinite(x).all(1) & (x != 0).any(1)
    return at[good], x[good]


def unit(x: np.ndarray) -> np.ndarray:
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def packed(x: np.ndarray) -> pa.Array:
    """Each row of a matrix as bytes."""
    x = np.ascontiguousarray(x)
    width = x.shape[1] * x.itemsize
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(np.arange(len(x) + 1, dtype=np.int32) * np.int32(width)), pa.py_buffer(x.tobytes())])


def unpacked(column: pa.Array, kind: type, width: int) -> np.ndarray:
    """The matrix of a column of packed rows, none of them null."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), width)


def best(score: np.ndarray, names: np.ndarray, limit: int) -> np.ndarray:
    """Places, row by row, of the ``limit`` least scores of a matrix, ties by name."""
    if score.shape[1] > 4 * limit:  # what is above the limit-th least cannot be among them
        edge = np.partition(score, limit - 1, 1)[:, limit - 1 : limit]
        keep = np.flatnonzero((score <= edge).any(0))
        return keep[np.lexsort((np.broadcast_to(names[keep], (len(score), len(keep))), score[:, keep]), axis=1)[:, :limit]]
    return np.lexsort((np.broadcast_to(names, score.shape), score), axis=1)[:, :limit]
