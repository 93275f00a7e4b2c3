"""Navigable graphs: one for each shard, pruned for diversity, walked greedily with a beam."""

from __future__ import annotations

import numpy as np

DEGREE, BEAM, ALPHA = 32, 64, 1.2
#: Points whose distances to all others are worked out at once; far points offered to each beside its nearest.
BLOCK, FAR = 512, 64
#: Places beyond its beam that a walk has room for; a key below all others.
SPARE, _NONE = 160, np.int64(-(2**63))


def build(points: np.ndarray, degree: int = DEGREE, beam: int = BEAM, alpha: float = ALPHA, seed: int = 42) -> tuple[list[np.ndarray], int]:
    """Neighbours of each point and the entry, the point nearest to the mean.

    Each point is linked to a diverse choice of its ``2 * beam`` nearest, found by matrix products,
    and of some points drawn by a seed, and back; overfull lists are pruned again. Then what can't be
    reached from the entry is linked to, so that a walk can come to every point.
    """
    n = len(points)
    if not n:
        return [], 0
    entry = int(((points - points.mean(axis=0)) ** 2).sum(axis=1).argmin())
    rng = np.random.default_rng(seed)
    squares = (points * points).sum(axis=1)
    near = min(2 * beam, n - 1)
    links: list[list[int]] = [[] for _ in range(n)]
    for first in range(0, n, BLOCK):
        own = np.arange(first, min(first + BLOCK, n))
        dist = squares[None, :] - 2 * (points[own] @ points.T)
        dist[np.arange(len(own)), own] = np.inf
        nearest = np.argpartition(dist, near - 1, axis=1)[:, :near] if near else np.zeros((len(own), 0), dtype=np.int64)
        far = rng.integers(0, n, (len(own), FAR))
        for p, x, y in zip(own.tolist(), nearest, far, strict=True):
            links[p] = _diverse(points, p, np.concatenate([x, y]), degree, alpha)
    back: list[list[int]] = [[] for _ in range(n)]
    for p, x in enumerate(links):
        for q in x:
            back[q].append(p)
    for q in range(n):
        both = [*links[q], *back[q]]
        links[q] = _diverse(points, q, np.asarray(both, dtype=np.int64), degree, alpha) if len(both) > degree else both
    _connect(points, squares, links, entry)
    return [np.asarray(sorted(set(x)), dtype=np.int32) for x in links], entry


def _connect(points: np.ndarray, squares: np.ndarray, links: list[list[int]], entry: int) -> None:
    """Link points that can't be reached from the entry to the nearest that can, one group after the other."""
    reached, todo = np.zeros(len(points), dtype=bool), [entry]
    reached[entry] = True
    lost = 0
    while True:
        while todo:
            for q in links[todo.pop()]:
                if not reached[q]:
                    reached[q] = True
                    todo.append(q)
        while lost < len(points) and reached[lost]:
            lost += 1
        if lost == len(points):
            return
        held = np.flatnonzero(reached)
        links[held[int((squares[held] - 2 * (points[held] @ points[lost])).argmin())]].append(lost)
        reached[lost] = True
        todo.append(lost)


def _diverse(points: np.ndarray, p: int, candidates: np.ndarray, degree: int, alpha: float) -> list[int]:
    """Nearest candidates of which none is much nearer to an earlier choice than to ``p``."""
    pool = np.unique(candidates)
    pool = pool[pool != p]
    if not len(pool):
        return []
    moved = points[pool] - points[p]
    dist = (moved * moved).sum(axis=1)
    order = np.argsort(dist, kind="stable")
    pool, dist, moved = pool[order], dist[order], moved[order]
    # Of squared distances between candidates: those that don't rule each other out.
    apart = alpha * (dist[:, None] + dist[None, :] - 2 * (moved @ moved.T)) > dist[None, :]
    alive = np.ones(len(pool), dtype=bool)
    chosen: list[int] = []
    for k in range(len(pool)):
        if alive[k]:
            chosen.append(int(pool[k]))
            if len(chosen) == degree:
                break
            alive &= apart[k]
    return chosen


def search(scores: np.ndarray, offsets: np.ndarray, neighbours: np.ndarray, entry: int, k: int, dead: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places and scores of the ``k`` best that each query's walk comes to, in no order, by a beam of ``max(4k, 64)``.

    ``scores`` has a row for each query and a column for each place, of which a walk sees those that it comes to.
    A walk goes on from its best place that is still ahead while that is among the beam's best; all queries take a
    step at once. Ties go to the smaller place. Dead places are passed through, not returned; where fewer than
    ``k`` are found, places are -1.
    """
    asked, n = scores.shape
    width, flat = min(n, max(4 * k, 64)), scores.reshape(-1)
    seen = np.zeros(asked * n, dtype=bool)
    seen[np.arange(asked) * n + entry] = True
    # What each walk came to, of which no more than the beam's best are kept when there is no more room; the last bit says what is ahead.
    room = width + SPARE
    held = np.full((asked, room), _NONE)
    held[:, 0] = _key(scores[:, entry], np.full(asked, entry)) | 1
    ahead, used, cut = held.copy(), np.ones(asked, dtype=np.int64), np.full(asked, _NONE)
    who, beams = np.arange(asked), np.full((asked, width), _NONE)
    while True:
        at = ahead.argmax(axis=1)
        best = ahead[np.arange(len(who)), at]
        on = (best != _NONE) & ((held > best[:, None]).sum(axis=1, dtype=np.uint32) < width)
        row = np.flatnonzero(on)
        if len(row) <= 0.9 * len(who):
            beams[who[~on]] = _best(held[~on], width)
            held, ahead, used, cut, who, at, best = held[on], ahead[on], used[on], cut[on], who[on], at[on], best[on]
            row = np.arange(len(who))
            if not len(row):
                break
        held[row, at[row]] -= 1
        ahead[row, at[row]] = _NONE
        places = _place(best[row])
        first, count = offsets[places], offsets[places + 1] - offsets[places]
        to = neighbours[np.repeat(first - np.cumsum(count) + count, count) + np.arange(count.sum())]
        cell = np.repeat(who[row] * n, count) + to
        new = np.flatnonzero(~seen[cell])
        row, cell, to = np.repeat(row, count)[new], cell[new], to[new]
        seen[cell] = True
        keys = _key(flat[cell], to) | 1
        near = np.flatnonzero(keys > cut[row])
        row, keys = row[near], keys[near]
        count = np.bincount(row, minlength=len(who))
        if (used + count).max() > room:
            kept, room = _best(held, width), max(room, width + int(count.max()))
            held = np.full((len(who), room), _NONE)
            held[:, :width], cut = kept, kept.min(axis=1)
            ahead, used = np.where(held & 1, held, _NONE), np.full(len(who), width)
        # Rows of the new keys are in order.
        at = used[row] + np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
        held[row, at] = ahead[row, at] = keys
        used += count
    if dead is not None and dead.any():
        beams[dead[_place(beams)] & (beams != _NONE)] = _NONE
    beams = _best(beams, k)
    places = np.where(beams == _NONE, -1, _place(beams))
    return places, np.take_along_axis(scores, np.maximum(places, 0), axis=1)


def _best(keys: np.ndarray, k: int) -> np.ndarray:
    """Of each row the ``k`` greatest keys, in no order."""
    beyond = keys.shape[1] - k
    return np.partition(keys, beyond, axis=1)[:, beyond:] if beyond > 0 else keys


def _key(scores: np.ndarray, places: np.ndarray) -> np.ndarray:
    """Single-precision scores and places as whole numbers in the order of the scores, at ties of descending places; the last bit is free."""
    bits = np.ascontiguousarray(scores, dtype=np.float32).view(np.int32)
    return ((bits ^ ((bits >> 31) & 0x7FFFFFFF)).astype(np.int64) << 32) | ((0x7FFFFFFF - places.astype(np.int64)) << 1)


def _place(keys: np.ndarray) -> np.ndarray:
    return 0x7FFFFFFF - ((keys >> 1) & 0x7FFFFFFF)
