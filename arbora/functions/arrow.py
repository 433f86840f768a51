"""Arrow batches as matrices."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrix(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of a batch as rows, and which of them are there; null vectors are rows of NaN."""
    there = np.asarray(column.is_valid())
    flat, n = column.flatten().to_numpy(zero_copy_only=False), int(there.sum())
    x = np.full((len(column), len(flat) // max(1, n)), np.nan)
    if n:
        x[there] = flat.reshape(n, -1)
    return x, there


def rows_of(x: np.ndarray, there: np.ndarray | None = None) -> pa.Array:
    """A list a row of a matrix; null where a row is not there."""
    ends = pa.array(np.arange(0, len(x) * x.shape[1] + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, dtype=np.int32))
    return pa.ListArray.from_arrays(ends, pa.array(x.ravel()), mask=None if there is None or there.all() else pa.array(~there))


def by_key(batch: pa.RecordBatch, n_keys: int) -> Iterator[tuple[tuple[int, ...], np.ndarray, np.ndarray]]:
    """(key, vectors, values) of each key of a batch of whole-number keys, a vector and a value; rows
    with a null among them are left out."""
    for i in range(n_keys + 2):
        batch = batch.filter(pc.is_valid(batch.column(i)))
    if not batch.num_rows:
        return
    x, value = matrix(batch.column(n_keys))[0], batch.column(n_keys + 1).to_numpy(zero_copy_only=False)
    if not n_keys:
        yield (), x, value
        return
    keys, at = np.unique(np.stack([batch.column(i).to_numpy() for i in range(n_keys)], axis=1), axis=0, return_inverse=True)
    order = np.argsort(at.ravel(), kind="stable")
    for key, rows in zip(keys.tolist(), np.split(order, np.cumsum(np.bincount(at.ravel()))[:-1]), strict=True):
        yield tuple(key), x[rows], value[rows]
