"""Whole groups out of a partition that is sorted by its leading columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.Table]:
    """Batches cut and joined so that rows which agree in the first ``keys`` columns come together; a piece holds a batch and one group more."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(keys)]
        same = np.logical_and.reduce([c == c[-1] for c in cols])
        first = int(np.argmax(same))
        if held and first == 0 and all(held[-1].column(k)[0].as_py() == batch.column(k)[0].as_py() for k in range(keys)):
            held.append(batch)
            continue
        ready = [*held, batch.slice(0, first)]
        if sum(b.num_rows for b in ready):
            yield pa.Table.from_batches(ready)
        held = [batch.slice(first)]
    if held:
        yield pa.Table.from_batches(held)


def starts(*keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First row and size of each group of sorted keys."""
    new = np.ones(keys[0].size, dtype=bool)
    new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    start = np.flatnonzero(new)
    return start, np.diff(np.r_[start, keys[0].size])


def pairs(start: np.ndarray, size: np.ndarray, left: np.ndarray, at_once: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers (x, y): each row of ``left`` with every row of its group, about ``at_once`` pairs at a time."""
    first, many = np.repeat(start, size)[left], np.repeat(size, size)[left]
    ends = np.cumsum(many)
    k = 0
    while k < left.size:
        to = max(k + 1, int(np.searchsorted(ends, ends[k] - many[k] + at_once, "right")))
        n = many[k:to]
        yield np.repeat(left[k:to], n), np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first[k:to], n)
        k = to


def merged(x: np.ndarray, y: np.ndarray, count: int) -> np.ndarray:
    """Smallest node that each of ``count`` nodes reaches over the links (x, y)."""
    root = np.arange(count)
    while True:
        a, b = root[x], root[y]
        if not (a != b).any():
            return root
        np.minimum.at(root, np.maximum(a, b), np.minimum(a, b))
        while (root[root] != root).any():
            root = root[root]
