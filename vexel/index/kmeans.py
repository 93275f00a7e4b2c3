"""Seeded k-means for coarse cells."""

from __future__ import annotations

import numpy as np

MAX_ROUNDS, TOLERANCE = 25, 1e-6


#: Distances held at once.
_HELD = 8_000_000


def squared_distances(points: np.ndarray, centers: np.ndarray) -> np.ndarray:
    points, centers = points.astype(float), centers.astype(float)
    return np.maximum((points**2).sum(1)[:, None] - 2 * points @ centers.T + (centers**2).sum(1)[None, :], 0)


def nearest(points: np.ndarray, centers: np.ndarray, copies: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """The ``copies`` nearest centres of each point and their squared distances, a bounded block at a time.

    Distances by the expanded square that are equal up to rounding are worked out anew as plain
    differences; what is equal then goes to the lower centre.
    """
    cells, dists = [], []
    few = min(len(centers), copies + 3)
    size = max(1, _HELD // max(len(centers), few * points.shape[1]))
    for a in range(0, len(points), size):
        block = points[a : a + size]
        dist = squared_distances(block, centers)
        at = np.sort(np.argpartition(dist, few - 1, axis=1)[:, :few], axis=1)
        exact = ((block[:, None, :].astype(float) - centers[at].astype(float)) ** 2).sum(axis=2)
        order = np.argsort(exact, axis=1, kind="stable")[:, :copies]
        cells.append(np.take_along_axis(at, order, axis=1))
        dists.append(np.take_along_axis(exact, order, axis=1))
    empty = np.zeros((0, min(copies, len(centers))))
    return np.concatenate(cells or [empty.astype(np.int64)]), np.concatenate(dists or [empty])


def train(points: np.ndarray, cells: int, seed: int = 42) -> np.ndarray:
    """Centres by k-means++ seeding and Lloyd rounds; an empty cell takes the farthest point of the largest."""
    rng = np.random.default_rng(seed)
    cells = min(cells, len(points))
    centers = np.zeros((cells, points.shape[1]), dtype=points.dtype)
    centers[0] = points[rng.integers(len(points))]
    closest = squared_distances(points, centers[:1])[:, 0]
    for k in range(1, cells):
        total = closest.sum()
        pick = rng.choice(len(points), p=closest / total) if total > 0 else rng.integers(len(points))
        centers[k] = points[pick]
        closest = np.minimum(closest, squared_distances(points, centers[k : k + 1])[:, 0])
    for _ in range(MAX_ROUNDS):
        cell, dist = (x[:, 0] for x in nearest(points, centers))
        count = np.bincount(cell, minlength=cells)
        sums = np.zeros_like(centers)
        np.add.at(sums, cell, points)
        new = np.where(count[:, None] > 0, sums / np.maximum(count, 1)[:, None], centers)
        for empty in np.flatnonzero(count == 0):
            members = np.flatnonzero(cell == count.argmax())
            new[empty] = points[members[dist[members].argmax()]]
            dist[members[dist[members].argmax()]] = 0  # another empty cell takes another point
        moved = ((new - centers) ** 2).sum(axis=1).max()
        centers = new
        if moved < TOLERANCE:
            break
    return centers.astype(np.float32)


def assign(points: np.ndarray, centers: np.ndarray, copies: int = 1, slack: float = 1.2) -> list[np.ndarray]:
    """Cells of each point: its nearest, and up to ``copies - 1`` more within ``slack`` times that squared distance."""
    order, near = nearest(points, centers, copies)
    return [o[d <= slack * d[0]] for o, d in zip(order, near, strict=True)]
