"""Distances and seeded numbers, as Column expressions and as numpy kernels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def l2(a: str | Column, b: str | Column) -> Column:
    """Euclidean distance of two float arrays, in double; null where the lengths differ."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    squares = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.when(F.size(a) == F.size(b), F.sqrt(F.aggregate(squares, F.lit(0.0), lambda acc, x: acc + x)))


def l2_rows(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances of matching rows (broadcasting), widened to double before subtracting."""
    d = x.astype(np.float64) - y.astype(np.float64)
    return np.sqrt(np.einsum("...i,...i->...", d, d))


def nearest(queries: np.ndarray, base: np.ndarray, ids: np.ndarray, k: int, slack: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest base rows of each query by (distance, id): (positions, distances).

    A matrix product ranks candidates; the best k + slack are measured exactly, which settles rounding and ties. Where
    more rows than these may tie with the k-th, all that lie within the rounding of the product are measured.
    """
    q, b = queries.astype(np.float64), base.astype(np.float64)
    squares = (b * b).sum(1)
    rough = squares[None, :] - 2.0 * (q @ b.T)
    take = min(len(b), k + slack)
    part = np.argpartition(rough, take - 1, axis=1)[:, :take] if take < len(b) else np.broadcast_to(np.arange(len(b)), rough.shape)
    dist = l2_rows(q[:, None, :], b[part])
    order = np.lexsort((ids[part], dist), axis=1)[:, :k]
    place, dist = np.take_along_axis(part, order, 1), np.take_along_axis(dist, order, 1)
    if not 0 < k <= take < len(b):
        return place, dist
    # Rounding of the product and of the exact distances, for each query against the longest base row.
    reach = np.sqrt((q * q).sum(1)) + np.sqrt(squares.max())
    bound = 8 * (q.shape[1] + 4) * np.finfo(np.float64).eps * reach * reach
    limit = np.take_along_axis(rough, place, 1).max(1) + bound
    for i in np.flatnonzero(np.take_along_axis(rough, part, 1).max(1) <= limit).tolist():
        some = np.flatnonzero(rough[i] <= limit[i])
        exact = l2_rows(q[i][None, :], b[some])
        best = np.lexsort((ids[some], exact))[:k]
        place[i], dist[i] = some[best], exact[best]
    return place, dist


#: A prime below 2 ** 31 (fixed value): products of two residues fit into 64 bits.
PRIME = 2147483647


def seeded_id(n: int, seed: int, i: str | Column, slot: str | Column) -> Column:
    """A pseudo-random number in [0, n) from two numbers, by arithmetic that any SQL engine can repeat."""
    i, slot = (F.col(x) if isinstance(x, str) else x for x in (i, slot))
    a, s = i.cast("long") % PRIME, slot.cast("long") % PRIME
    h = (a * 7919 + s * 104729 + F.lit(seed * 1299709 % PRIME).cast("long") + (a * s) % PRIME * 31 + (a * a) % PRIME * 17) % PRIME
    h = (h * h + h * 48271) % PRIME
    return (h * h + h * 16807 + s) % PRIME % n
