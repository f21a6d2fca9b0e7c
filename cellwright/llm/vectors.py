"""Vectors of an Arrow batch as matrices, one for each length that occurs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def matrices(lists: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, positions and rows, in double precision, of the vectors that are not null or empty and hold only finite components."""
    sizes = pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    values = lists.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # a null component becomes NaN
    starts = np.concatenate([[0], np.cumsum(sizes)])
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    usable = (sizes > 0) & (bad[starts[1:]] == bad[starts[:-1]])
    for size in np.unique(sizes[usable]).tolist():
        at = np.flatnonzero(usable & (sizes == size))
        yield size, at, values[starts[at][:, None] + np.arange(size)]


def stepped(rows: np.ndarray, scale: int, limit: float) -> tuple[np.ndarray, np.ndarray]:
    """Which rows stay within `limit` after scaling, and floor(scale * component) of those."""
    scaled = np.floor(rows * scale)
    fits = (np.abs(scaled) <= limit).all(axis=1)
    return fits, scaled[fits].astype(np.int64)
