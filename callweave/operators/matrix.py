"""Small numeric helpers used inside tasks on bounded batches."""

from __future__ import annotations

import numpy as np
import pandas as pd


def stack(series: pd.Series) -> np.ndarray:
    """Rows of a list column as one float64 matrix."""
    if len(series) == 0:
        return np.zeros((0, 0))
    return np.vstack(series.to_numpy()).astype(np.float64)


def cells_of(chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows and columns of the true cells, as ``nonzero`` gives them, which takes ten times as long for a matrix as for a vector."""
    return np.divmod(np.flatnonzero(chosen.ravel()), max(1, chosen.shape[1]))


# Cells of a distance matrix that are finished at once, while they are in the processor's cache.
TILE_CELLS = 1 << 17


def distances(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Euclidean distances of all rows of ``a`` to all rows of ``b``.

    The product form, one product with the squared lengths as two more columns, loses digits for points that nearly coincide, so those are
    taken again as differences.
    """
    own, other = (a * a).sum(1), (b * b).sum(1)
    one = np.ones((max(len(a), len(b)), 1))
    sq = np.hstack([-2.0 * a, own[:, None], one[: len(a)]]) @ np.hstack([b, one[: len(b)], other[:, None]]).T
    loose = 1e-4 * max(1.0, (np.sqrt(own.max(initial=0.0)) + np.sqrt(other.max(initial=0.0))) ** 2)
    step = max(1, TILE_CELLS // max(1, len(b)))
    for begin in range(0, len(a), step):
        tile = sq[begin : begin + step]
        i, j = cells_of(tile < loose)
        for at in range(0, len(i), 65536):
            rows, cols = i[at : at + 65536], j[at : at + 65536]
            diff = a[begin + rows] - b[cols]
            tile[rows, cols] = (diff * diff).sum(1)
        np.sqrt(tile, out=tile)
    return sq


def nearest(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index and distance of the nearest centre; distances equal to nine digits go to the first."""
    d = distances(points, centres)
    index = np.round(d, 9).argmin(1)
    return index, d[np.arange(len(points)), index]


def group_sums(rows: np.ndarray, index: np.ndarray, k: int) -> np.ndarray:
    """Sum of the rows with the same index, for indices 0 to k - 1."""
    out = np.zeros((k, rows.shape[1]))
    order = np.argsort(index, kind="stable")
    present, start = np.unique(index[order], return_index=True)
    out[present] = np.add.reduceat(rows[order], start, axis=0)
    return out


def smallest(d: np.ndarray, ids: np.ndarray, k: int, digits: int = 9) -> tuple[np.ndarray, np.ndarray]:
    """Per row the ``k`` smallest entries, ordered by rounded distance and then id.

    Returns column positions and the rounded distances; entries of infinite distance may be among
    them when a row has fewer than ``k`` finite ones.
    """
    rounded = np.round(d, digits)
    k = min(k, d.shape[1])
    by_id = np.argsort(ids, kind="stable")
    order = np.argsort(rounded[:, by_id], axis=1, kind="stable")[:, :k]
    cols = by_id[order]
    return cols, np.take_along_axis(rounded, cols, 1)


def components(adjacent: np.ndarray) -> np.ndarray:
    """Smallest member position of the connected component of every row of a symmetric matrix."""
    n = len(adjacent)
    label = np.arange(n)
    while True:
        reach = np.where(adjacent, label[None, :], n).min(1, initial=n)
        new = np.minimum(label, reach)
        new = new[new]
        if (new == label).all():
            return label
        label = new
