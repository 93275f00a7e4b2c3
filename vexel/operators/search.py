"""Exact and quantised nearest-neighbour search, filters and distance joins."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.functions import call, vector
from vexel.quantize import Quantizer

#: Distance function by metric; all sort nearest first in ascending order.
METRICS = {"l2": "l2_distance", "l2_squared": "l2_squared_distance", "ip": "negative_inner_product", "cosine": "cosine_distance", "l1": "l1_distance"}
#: Queries sent to the tasks at a time; more are searched block by block.
QUERY_BLOCK = 4096
#: Queries of a block that are scored at a time, which bounds a task's arrays.
QUERY_STRIP = 256
#: The id of places that nobody has yet.
_NOBODY = np.int64(2**63 - 1)
#: Allowed or deleted ids joined by broadcast at most.
BROADCAST_IDS = 1_000_000
#: A distance join's pairs of blocks at most, while the left blocks stay within so many bytes; rows of a
#: block at least, about; rows multiplied at a time.
JOIN_CELLS, BLOCK_BYTES, JOIN_ROWS, TILE = 128, 64_000_000, 4096, 2048


def distance(metric: str, a: Column | str, b: Column | str) -> Column:
    return call(METRICS[metric], a, b)


def exact_topk(df: DataFrame, query: Sequence[float], k: int, metric: str = "l2", id_col: str = "id", vector_col: str = "vector") -> DataFrame:
    """The ``k`` nearest rows with a column ``dist``; ties by id, null vectors last, NaN after all numbers.

    A projection and ``TakeOrderedAndProject``: each task keeps its own ``k``. Filters set on
    ``df`` reach the scan.
    """
    scored = df.withColumn("dist", distance(metric, F.col(vector_col), vector(query)))
    return scored.orderBy(F.col("dist").asc_nulls_last(), id_col).limit(k)


def batch_topk(corpus: DataFrame, queries: DataFrame, k: int, metric: str = "l2", id_col: str = "id", vector_col: str = "vector", query_id: str = "qid", query_vector: str = "query", exclude_self: bool = False) -> DataFrame:
    """The ``k`` nearest corpus rows of every query: ``(qid, rank, id, dist)``.

    Queries go to the tasks in blocks of :data:`QUERY_BLOCK`; each task scores its rows against a
    block with array arithmetic and keeps its ``k`` best, so what is shuffled is ``k`` rows for
    each query and task. For ``cosine`` matrix products tell which pairs may be among these, and
    these alone are measured exactly. Rows and queries with null ids or vectors take no part.
    """
    asked = queries.where(F.col(query_vector).isNotNull() & F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
    rows = corpus.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<double>").alias("v"))
    found = None
    for ids, points in blocks_of(asked):
        one = rows.mapInArrow(_local_topk(ids, points, k, metric, exclude_self), "qid long, id long, dist double")
        found = one if found is None else found.union(one)
    if found is None:
        return corpus.sparkSession.createDataFrame([], "qid long, rank int, id long, dist double")
    order = Window.partitionBy("qid").orderBy("dist", "id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")


def blocks_of(asked: DataFrame, size: int = QUERY_BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of ``(q, v)`` in blocks of about ``size``, one on the driver at a time; their table is read once."""
    held = asked.persist()
    try:
        parts = max(1, -(-held.count() // size))
        for part in range(parts):
            block = held.where(F.pmod(F.xxhash64("q"), F.lit(parts)) == part).toArrow()
            if block.num_rows:
                points = block["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
                yield block["q"].to_numpy(), points.astype(float).reshape(block.num_rows, -1)
    finally:
        held.unpersist()


def pairwise(metric: str, queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Distances of all query and point pairs in double precision, summed in the order of the elements."""

    def total(term) -> np.ndarray:
        out = np.zeros((len(queries), len(points)))
        for d in range(queries.shape[1]):
            out += term(queries[:, d, None], points[None, :, d])
        return out

    if metric == "l1":
        return total(lambda a, b: np.abs(a - b))
    if metric in ("l2", "l2_squared"):
        squared = total(lambda a, b: (a - b) ** 2)
        return squared if metric == "l2_squared" else np.sqrt(squared)
    dot = total(lambda a, b: a * b)
    if metric == "ip":
        return -dot
    return _from_cosine(dot, _sizes(queries)[:, None] * _sizes(points))


def least(keys: np.ndarray, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Of each row the ``k`` smallest keys, in no order, and who has them; ties go to the smaller id, NaN comes last."""
    if keys.shape[1] <= k:
        return keys, who
    kept = keys <= np.partition(keys, k - 1, axis=1)[:, k - 1, None]
    plain = kept.sum(axis=1) == k
    at = np.empty((len(keys), k), dtype=np.int64)
    at[plain] = np.nonzero(kept[plain])[1].reshape(-1, k)
    at[~plain] = np.lexsort((who[~plain], keys[~plain]), axis=1)[:, :k]
    return np.take_along_axis(keys, at, axis=1), np.take_along_axis(who, at, axis=1)


def offered(best: tuple[np.ndarray, np.ndarray], asking: np.ndarray, keys: np.ndarray, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` least keys of each query, and who has them, once those of the ``asking`` ones are offered the same rows."""
    if best[0].shape[1] < k:
        new = np.full((len(best[0]), keys.shape[1]), np.inf, dtype=keys.dtype)
        new[asking] = keys
        best = np.concatenate([best[0], new], axis=1), np.concatenate([best[1], np.broadcast_to(who, new.shape)], axis=1)
        return least(*best, k)
    near = np.flatnonzero(keys <= best[0].max(axis=1)[asking, None])
    q, r = np.divmod(near, len(who))
    return joined(best, asking[q], keys.ravel()[near], who[r], k)


def joined(best: tuple[np.ndarray, np.ndarray], q: np.ndarray, keys: np.ndarray, who: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``best``, which holds ``k`` keys of each query, with more of the queries ``q``, which ascend; the ``k`` least stay."""
    if not len(q):
        return best
    count = np.bincount(q, minlength=len(best[0]))
    some = np.flatnonzero(count)
    at = (np.cumsum(count > 0) - 1)[q], np.arange(len(q)) - np.repeat(np.cumsum(count) - count, count)
    more = np.full((len(some), count.max()), np.nan, dtype=best[0].dtype), np.full((len(some), count.max()), _NOBODY)
    more[0][at], more[1][at] = keys, who
    best[0][some], best[1][some] = least(*(np.concatenate([x[some], y], axis=1) for x, y in zip(best, more, strict=True)), k)
    return best


def _local_topk(ids: np.ndarray, queries: np.ndarray, k: int, metric: str, exclude_self: bool):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips = [slice(a, a + QUERY_STRIP) for a in range(0, len(ids), QUERY_STRIP)]
        best = [(np.full((len(ids[s]), k), np.nan), np.full((len(ids[s]), k), _NOBODY)) for s in strips]
        asked = _directions(queries) if metric == "cosine" else None
        for part in (batch.slice(a, TILE) for batch in batches for a in range(0, batch.num_rows, TILE)):
            rows = part.column(0).to_numpy()
            points = part.column(1).flatten().to_numpy(zero_copy_only=False)
            if len(points) != len(rows) * queries.shape[1]:
                raise ValueError("different dimensions")
            points = points.reshape(len(rows), -1)
            held = _directions(points) if metric == "cosine" else None
            for i, s in enumerate(strips):
                cut = best[i][0].max(axis=1)
                cut[np.isnan(cut)] = np.inf
                maybe = None if held is None else _maybe_nearer([x[s] for x in asked], held, cut, k, ids[s, None] == rows if exclude_self and np.isinf(cut).any() else None)
                if maybe is None or 8 * np.count_nonzero(maybe) > maybe.size:
                    dist = pairwise(metric, queries[s], points)
                    near = np.flatnonzero(~(dist > cut[:, None]))
                    q, r = np.divmod(near, len(rows))
                    dist = dist.ravel()[near]
                else:
                    q, r = np.divmod(np.flatnonzero(maybe), len(rows))
                    sizes = asked[0][s][q] * held[0][r]
                    dist = np.concatenate([_cosines(queries[s][q[a : a + 32_768]], points[r[a : a + 32_768]], sizes[a : a + 32_768]) for a in range(0, len(q), 32_768)] or [sizes])
                if exclude_self:
                    other = ids[s][q] != rows[r]
                    q, r, dist = q[other], r[other], dist[other]
                best[i] = joined(best[i], q, dist, rows[r], k)
        for s, (dist, who) in zip(strips, best, strict=True):
            found = (who != _NOBODY) & ~np.isposinf(dist)
            owner = np.broadcast_to(ids[s, None], dist.shape)
            yield pa.RecordBatch.from_arrays([pa.array(owner[found]), pa.array(who[found]), pa.array(dist[found])], names=["qid", "id", "dist"])

    return task


def _directions(points: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sizes, unit vectors in single precision, and of which vectors these are sound; others are zero."""
    sizes = _sizes(points)
    sound = (sizes > 1e-100) & (sizes < 1e100)
    unit = np.zeros(points.shape, dtype=np.float32)
    unit[sound] = points[sound] / sizes[sound, None]
    return sizes, unit, sound


def _maybe_nearer(asked: Sequence[np.ndarray], held: Sequence[np.ndarray], cut: np.ndarray, k: int, own: np.ndarray | None) -> np.ndarray:
    """Of which pairs the cosine distance may be within the query's ``cut`` and among its ``k`` least; ``own`` pairs don't count.

    A product in single precision tells, of which what its rounding can hide is let through.
    """
    (_, unit, sound), (_, points, plain) = asked, held
    cosine = unit @ points.T
    slack = (unit.shape[1] + 8) * 2.0**-23
    first = np.flatnonzero(np.isinf(cut) & sound)
    if len(first) and len(points) > k:
        # Of queries without a cut, the k nearest of these rows give one.
        near = np.where(plain, cosine[first], -2) if own is None else np.where(own[first] | ~plain, -2, cosine[first])
        cut = cut.copy()
        cut[first] = 1 + slack - np.partition(near, len(points) - k, axis=1)[:, len(points) - k]
    floor = np.where(sound, 1 - slack - cut, -np.inf).astype(np.float32)
    return (cosine >= floor[:, None]) | ~plain


def _cosines(a: np.ndarray, b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Cosine distances of the rows of two arrays, as of :func:`pairwise`."""
    dot = np.zeros(len(a))
    for x, y in zip(a.T.copy(), b.T.copy(), strict=True):
        dot += x * y
    return _from_cosine(dot, sizes)


def _from_cosine(dot: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where(sizes > 0, 1 - np.clip(dot / sizes, -1, 1), np.nan)


def _sizes(points: np.ndarray) -> np.ndarray:
    """Norms, squares summed in the order of the elements."""
    out = np.zeros(len(points))
    with np.errstate(over="ignore", invalid="ignore"):
        for d in range(points.shape[1]):
            out += points[:, d] * points[:, d]
    return np.sqrt(out)


def with_ids(df: DataFrame, ids: DataFrame | Sequence[int] | None, id_col: str, keep: bool = True) -> DataFrame:
    """Rows whose id is among ``ids`` (or not among them): the filter comes before any scoring.

    ``None`` filters nothing, an empty list allows nothing; repeated and null ids don't matter.
    """
    if ids is None:
        return df
    if not isinstance(ids, DataFrame):
        listed = df.sparkSession.createDataFrame([(int(i),) for i in ids if i is not None], "allowed long")
    else:
        listed = ids.select(F.col(ids.columns[0]).cast("long").alias("allowed")).where("allowed is not null").distinct()
    small = F.broadcast(listed) if listed.count() <= BROADCAST_IDS else listed
    return df.join(small, F.col(id_col) == F.col("allowed"), "left_semi" if keep else "left_anti")


def parse_allowlist(text: str) -> list[int] | None:
    """Ids of a comma-separated list; blank text allows everything, a token that is no integer raises."""
    if not text.strip():
        return None
    try:
        return [int(t) for t in text.split(",") if t.strip()]
    except ValueError as e:
        raise ValueError(f"bad id in allowlist: {text!r}") from e


def knn(df: DataFrame, query: Sequence[float], k: int, bit_width: int = 4, allowed: DataFrame | Sequence[int] | None = None, id_col: str = "id", vector_col: str = "vector", normalize: bool = True) -> DataFrame:
    """Flat search over quantised vectors: ``(id, score)``, the estimated similarity, best first.

    Rows with a null id or vector, another dimension or non-finite elements are skipped. ``k``
    beyond the rows returns them all. ``k`` below one, a width outside 2 to 4 or a dimension that
    8 doesn't divide raise ``ValueError``.
    """
    found = knn_many(df, [query], k, bit_width, allowed, id_col, vector_col, normalize)
    return found.select("id", "score").orderBy(F.desc("score"), "id").limit(k)


def knn_many(df: DataFrame, queries: Sequence[Sequence[float]], k: int, bit_width: int = 4, allowed: DataFrame | Sequence[int] | None = None, id_col: str = "id", vector_col: str = "vector", normalize: bool = True) -> DataFrame:
    """:func:`knn` of several queries in one scan: ``(q, id, score)``, ``q`` the query's place, of each task its ``k`` best."""
    if k < 1:
        raise ValueError("k must be positive")
    dim = len(queries[0])
    quantizer = Quantizer(dim, bit_width)
    asked = np.stack([quantizer.prepare(np.asarray(q, dtype=np.float32), normalize) for q in queries])
    sound = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(vector_col) == dim)
    rows = df.where(sound & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    rows = with_ids(rows, allowed, id_col).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>").alias("v"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, scores = np.zeros((len(asked), 0), dtype=np.int64), np.zeros((len(asked), 0))
        for batch in batches:
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes, scale = quantizer.encode(points, normalize)
            new = np.stack([quantizer.scores(q, codes, scale) for q in asked])
            ids = np.concatenate([ids, np.broadcast_to(batch.column(0).to_numpy(), new.shape)], axis=1)
            scores = np.concatenate([scores, new], axis=1)
            keep = np.lexsort((ids, -scores), axis=1)[:, :k]
            ids, scores = np.take_along_axis(ids, keep, axis=1), np.take_along_axis(scores, keep, axis=1)
        place = np.broadcast_to(np.arange(len(asked), dtype=np.int32)[:, None], ids.shape)
        yield pa.RecordBatch.from_arrays([pa.array(x.ravel()) for x in (place, ids, scores)], names=["q", "id", "score"])

    return rows.mapInArrow(task, "q int, id long, score double")


def within(left: DataFrame, right: DataFrame, limit: float, metric: str = "l2", left_id: str = "left_id", right_id: str = "right_id", left_vector: str = "a", right_vector: str = "b") -> DataFrame:
    """Distance-threshold join: ``(left_id, right_id, dist)`` of all pairs no farther apart than ``limit``.

    Both sides are dealt into blocks by id and each pair of blocks meets in one task, which holds
    the left block, takes the right one as it comes and makes only pairs within the limit into
    rows. For ``l2`` matrix products tell which pairs may be near, and these alone are measured
    exactly; rows whose norms differ by more are passed over. Cost grows with the product of the
    sides. Rows with a null id or vector, and NaN distances, take no part.
    """
    lefts, rights = _keyed(left, left_id, left_vector), _keyed(right, right_id, right_vector)
    (n, held), m = _extent(lefts), _extent(rights)[0]
    cells = min(JOIN_CELLS, max(1, n * m // JOIN_ROWS**2))
    down = max(1, round((cells * n / max(m, 1)) ** 0.5), -(-held // BLOCK_BYTES))
    across = max(1, cells // down)
    lefts = lefts.select(F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("_c"), "*").select((_block(down) * across + F.col("_c")).alias("cell"), F.lit(0).alias("side"), "id", "v")
    rights = rights.select(F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("_c"), "*").select((F.col("_c") * across + _block(across)).alias("cell"), F.lit(1).alias("side"), "id", "v")
    return _met(lefts, rights, down * across, _local_within(limit, metric, (left_id, right_id)), f"{left_id} long, {right_id} long, dist double")


def within_self(rows: DataFrame, limit: float, metric: str = "l2", id_col: str = "id", vector_col: str = "vector", left_id: str = "left_id", right_id: str = "right_id") -> DataFrame:
    """:func:`within` of a table and itself, each pair of different ids once, the smaller on the left."""
    keyed = _keyed(rows, id_col, vector_col)
    n, held = _extent(keyed)
    blocks = max(1, min(int((2 * JOIN_CELLS) ** 0.5), n // JOIN_ROWS), -(-held // BLOCK_BYTES))
    keyed = keyed.withColumn("_b", _block(blocks))
    lefts = keyed.select(F.explode(F.sequence("_b", F.lit(blocks - 1))).alias("_c"), "*").select((F.col("_b") * blocks + F.col("_c")).alias("cell"), F.lit(0).alias("side"), "id", "v")
    rights = keyed.select(F.explode(F.sequence(F.lit(0), "_b")).alias("_c"), "*").select((F.col("_c") * blocks + F.col("_b")).alias("cell"), F.lit(1).alias("side"), "id", "v")
    return _met(lefts, rights, blocks * (blocks + 1) // 2, _local_within(limit, metric, (left_id, right_id), blocks), f"{left_id} long, {right_id} long, dist double")


def _keyed(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """``(id, v)`` of rows with both; vectors stay single where they are."""
    single = df.schema[vector_col].dataType.simpleString() == "array<float>"
    return df.where(F.col(vector_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).cast("array<float>" if single else "array<double>").alias("v"))


def _extent(keyed: DataFrame) -> tuple[int, int]:
    """Rows and bytes of ``(id, v)``."""
    width = 4 if keyed.schema["v"].dataType.simpleString() == "array<float>" else 8
    n, elements = keyed.agg(F.count("*"), F.coalesce(F.sum(F.size("v").cast("long")), F.lit(0))).first()
    return n, width * elements


def _block(n: int) -> Column:
    return F.pmod(F.xxhash64("id"), F.lit(n)).cast("int")


def _met(lefts: DataFrame, rights: DataFrame, cells: int, task, schema: str) -> DataFrame:
    """Rows of each cell in one task, the left side's first."""
    if lefts.schema["v"].dataType != rights.schema["v"].dataType:
        lefts, rights = (x.withColumn("v", F.col("v").cast("array<double>")) for x in (lefts, rights))
    return lefts.union(rights).repartition(cells, "cell").sortWithinPartitions("cell", "side").mapInArrow(task, schema)


def _local_within(limit: float, metric: str, names: tuple[str, str], blocks: int = 0):
    """Joins cell after cell. With ``blocks``, the cells are pairs of blocks of one table, of which each pair of rows counts once."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, parts, tiles = None, [], None
        for batch in batches:
            keys = batch.column(0).to_numpy().astype(np.int64) * 2 + batch.column(1).to_numpy()
            cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                here, side = divmod(int(keys[a]), 2)
                if here != cell:
                    cell, parts, tiles = here, [], None
                part = batch.slice(a, b - a)
                if not side:
                    parts.append(_vectors(part))
                    continue
                if not parts:
                    continue
                tiles = _tiles(parts) if tiles is None else tiles
                diagonal = blocks > 0 and cell // blocks == cell % blocks
                for c in range(0, part.num_rows, TILE):
                    ids, points = _vectors(part.slice(c, TILE))
                    norms = _norms(points)
                    for own, queries, sizes in tiles:
                        if queries.shape[1] != points.shape[1]:
                            raise ValueError("different dimensions")
                        for q, r, dist in _near(queries, sizes, points, norms, limit, metric):
                            q, r = own[q], ids[r]
                            if blocks:
                                once = q < r if diagonal else q != r
                                q, r, dist = np.minimum(q, r)[once], np.maximum(q, r)[once], dist[once]
                            yield pa.RecordBatch.from_arrays([pa.array(q), pa.array(r), pa.array(dist)], names=[*names, "dist"])

    return task


def _vectors(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of ``(cell, side, id, v)``."""
    sizes = np.diff(part.column(3).offsets.to_numpy())
    if (sizes != sizes[0]).any():
        raise ValueError("different dimensions")
    return part.column(2).to_numpy(), part.column(3).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)


def _norms(points: np.ndarray) -> np.ndarray:
    wide = points.astype(float)
    with np.errstate(over="ignore", invalid="ignore"):
        return np.sqrt((wide * wide).sum(axis=1))


def _tiles(parts: list[tuple[np.ndarray, np.ndarray]]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Ids, vectors and norms of a block in order of the norms, in tiles."""
    if len({p.shape[1] for _, p in parts}) > 1:
        raise ValueError("different dimensions")
    ids, points = np.concatenate([i for i, _ in parts]), np.concatenate([p for _, p in parts])
    norms = _norms(points)
    order = np.argsort(norms, kind="stable")
    return [(ids[at], points[at], norms[at]) for at in (order[a : a + TILE] for a in range(0, len(order), TILE))]


def _near(queries: np.ndarray, sizes: np.ndarray, points: np.ndarray, norms: np.ndarray, limit: float, metric: str) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Places and exact distances of the pairs within the limit, a bounded number at a time."""
    top = sizes.max() + norms.max()
    if metric != "l2" or not 0 <= limit < np.inf or not top < 1e100:
        for a in range(0, len(queries), 256):
            dist = pairwise(metric, queries[a : a + 256].astype(float), points.astype(float))
            q, r = np.nonzero(dist <= limit)
            yield q + a, r, dist[q, r]
        return
    slack = limit + 1e-9 * (1 + top)
    if sizes.min() - norms.max() > slack or norms.min() - sizes.max() > slack:
        return
    # Half the squared distance by one product of vectors with their squared norms beside them; what
    # its rounding can hide is let through. Where single precision would hide much, it's double.
    wide = (queries.shape[1] + 8) * top**2
    kind, unit = (np.float32, 2.0**-23) if wide * 2.0**-23 <= 1e-3 * limit**2 and 1e-10 < top < 1e10 else (np.float64, 2.0**-52)
    x = np.column_stack([queries, -(sizes**2) / 2, np.ones(len(queries))]).astype(kind)
    y = np.column_stack([points, np.ones(len(points)), -(norms**2) / 2]).astype(kind)
    maybe = np.flatnonzero((x @ y.T).ravel() >= kind(-(limit**2) / 2 - wide * unit))
    for a in range(0, len(maybe), 32_768):
        q, r = np.divmod(maybe[a : a + 32_768], len(points))
        apart = (queries[q].astype(float) - points[r]).T.copy()
        dist = np.zeros(len(q))
        for d in apart:
            dist += d * d
        dist = np.sqrt(dist)
        found = dist <= limit
        yield q[found], r[found], dist[found]
