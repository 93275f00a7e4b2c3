"""Nearest neighbours by vantage-point trees, one per shard.

A tree splits its vectors by their distance to a vantage point: the inner half lies within the
median radius, the outer half beyond it. By the triangle inequality a half can be skipped when
the query's distance to the radius exceeds the distance of the k-th neighbour found so far;
``factor`` relaxes this to that distance divided by ``factor``. Factor 1 is exact search, a
greater one skips more and may miss neighbours.

Shards are dealt the same way: a small tree of a sample, the top, gives every vector its leaf,
and a leaf of many rows is several shards. A query first searches the shards of its own leaf. The
distance of the k-th neighbour found there bounds what can still count, so of the other leaves
it is sent only to those that the top can't exclude. Queries travel to the trees, which
are moved once; a shard's queries pass through its task block by block.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vexel.llm.scratch import written

SHARD_ROWS, BLOCK_QUERIES, LEAF = 8192, 1024, 256
#: Leaves of the top at most, sampled vectors for each, and bytes of the sample at most: it goes to the driver.
#: This decides where rows lie and what can be excluded, not what is found.
MAX_LEAVES, SAMPLE_PER_LEAF, SAMPLE_BYTES = 1024, 64, 32_000_000
#: Shards joined by broadcast at most.
BROADCAST_SHARDS = 100_000
#: Relative slack for rounding in the bounds.
_SLACK = 1e-9


def distances(queries: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances in double precision, summed in the order of the components."""
    total = np.zeros((len(queries), len(points)))
    for d in range(queries.shape[1]):
        step = queries[:, d, None] - points[None, :, d]
        total += step * step
    return np.sqrt(total)


@dataclass
class Tree:
    """Points in tree order. A node covers ``[start, stop)``, its vantage point first; ``radius`` is NaN at a leaf."""

    ids: np.ndarray
    points: np.ndarray
    start: np.ndarray
    middle: np.ndarray
    stop: np.ndarray
    radius: np.ndarray
    inner: np.ndarray
    outer: np.ndarray

    @staticmethod
    def build(ids: np.ndarray, points: np.ndarray, leaf: int = LEAF) -> Tree:
        order = np.argsort(ids, kind="stable")
        nodes: list[list] = []
        rng = np.random.default_rng(len(ids))
        stack = [(0, len(ids), -1, 0)]
        while stack:
            a, b, parent, side = stack.pop()
            here = len(nodes)
            nodes.append([a, b, b, np.nan, -1, -1])
            if parent >= 0:
                nodes[parent][4 + side] = here
            if b - a <= leaf:
                continue
            # Of a few candidates, the vantage point with the widest spread of distances.
            trial = rng.integers(a, b, size=4)
            some = order[rng.integers(a, b, size=64)]
            spread = distances(points[order[trial]].astype(float), points[some].astype(float)).var(axis=1)
            pick = trial[int(np.argmax(spread))]
            order[a], order[pick] = order[pick], order[a]
            rest = order[a + 1 : b]
            dist = distances(points[order[a : a + 1]].astype(float), points[rest].astype(float))[0]
            radius = float(np.median(dist))
            within = dist <= radius
            if within.all():
                within = dist < radius
            if not within.any():
                continue  # all at one distance: nothing to split by
            order[a + 1 : b] = np.concatenate([rest[within], rest[~within]])
            middle = a + 1 + int(within.sum())
            nodes[here][1], nodes[here][3] = middle, float(dist[within].max())
            stack += [(middle, b, here, 1), (a + 1, middle, here, 0)]
        cols = list(zip(*nodes, strict=True)) if nodes else [[]] * 6
        start, middle, stop = (np.asarray(c, dtype=np.int64) for c in cols[:3])
        inner, outer = (np.asarray(c, dtype=np.int64) for c in cols[4:])
        return Tree(ids[order], points[order], start, middle, stop, np.asarray(cols[3], dtype=float), inner, outer)

    def search(self, query_ids: np.ndarray, queries: np.ndarray, k: int, factor: float = 1.0, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
        """Distances and ids of the ``k`` nearest of each query but itself (inf where fewer), and the distances computed.

        With ``bound``, what is farther than that from a query need not be found.
        """
        best = np.full((len(queries), k), np.inf)
        who = np.full((len(queries), k), np.iinfo(np.int64).max)
        limit = np.full(len(queries), np.inf) if bound is None else bound
        computed = 0
        queries = queries.astype(float)
        points = self.points.astype(float)

        def offer(active: np.ndarray, a: int, b: int) -> np.ndarray:
            nonlocal computed
            dist = distances(queries[active], points[a:b])
            computed += dist.size
            own = np.where(query_ids[active, None] == self.ids[None, a:b], np.inf, dist)
            better = own.min(axis=1) <= np.minimum(best[active, -1], limit[active])
            if better.any():
                mine, own = active[better], own[better]
                all_d = np.concatenate([best[mine], own], axis=1)
                all_i = np.concatenate([who[mine], np.broadcast_to(self.ids[a:b], own.shape)], axis=1)
                all_i = np.where(np.isinf(all_d), np.iinfo(np.int64).max, all_i)
                at = np.lexsort((all_i, all_d), axis=1)[:, :k]
                best[mine] = np.take_along_axis(all_d, at, axis=1)
                who[mine] = np.take_along_axis(all_i, at, axis=1)
            return dist

        if not len(self.ids):
            return best, who, 0
        stack = [(0, np.arange(len(queries)), np.zeros(len(queries)))]
        while stack:
            node, active, gap = stack.pop()
            near = gap <= np.minimum(best[active, -1], limit[active]) / factor + _SLACK * (1 + gap)
            active = active[near]
            if not len(active):
                continue
            a = self.start[node]
            radius = self.radius[node]
            if np.isnan(radius):
                offer(active, a, self.stop[node])
                continue
            dist = offer(active, a, a + 1)[:, 0]
            inside = dist <= radius
            # Popped in reverse: each query's nearer side first, then the other with its bound.
            stack.append((self.inner[node], active[~inside], (dist - radius)[~inside]))
            stack.append((self.outer[node], active[inside], (radius - dist)[inside]))
            stack.append((self.outer[node], active[~inside], np.zeros((~inside).sum())))
            stack.append((self.inner[node], active[inside], np.zeros(inside.sum())))
        return best, who, computed

    def leaves(self, points: np.ndarray, bound: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Places of the points and the leaves they belong to; with ``bound``, all leaves that may hold what is so near."""
        if not len(self.ids):
            return np.arange(len(points)), np.zeros(len(points), dtype=np.int64)
        where, found = [], []
        stack = [(0, np.arange(len(points)))]
        while stack:
            node, active = stack.pop()
            if not len(active):
                continue
            radius = self.radius[node]
            if np.isnan(radius):
                where.append(active)
                found.append(np.full(len(active), node))
                continue
            dist = distances(points[active], self.points[self.start[node]][None, :].astype(float))[:, 0]
            slack = 0.0 if bound is None else bound[active] + _SLACK * (1 + dist)
            stack.append((self.inner[node], active[dist <= radius + slack]))
            stack.append((self.outer[node], active[dist > radius - slack]))
        return np.concatenate(where or [np.zeros(0, int)]), np.concatenate(found or [np.zeros(0, int)])


def usable(vector: Column) -> Column:
    """Neither null nor empty nor zero, without null or non-finite components."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & finite & F.exists(vector, lambda x: x != 0)


_PARTS = ("ids", "points", "start", "middle", "stop", "radius", "inner", "outer")
_TREE = "dim int, leaf long, part long, " + ", ".join(f"{c} binary" for c in _PARTS)
_ASKED = "dim int, leaf long, row long, query_id long, bound double, vector array<double>"
_FOUND = "row long, query_id long, vec_id long, score double"


def _packed(tree: Tree) -> list[bytes]:
    return [x.tobytes() for x in (tree.ids, tree.points.astype("<f8"), tree.start, tree.middle, tree.stop, tree.radius, tree.inner, tree.outer)]


def _unpacked(parts: dict[str, bytes], dim: int) -> Tree:
    kinds = {c: "<f8" if c in ("points", "radius") else "<i8" for c in _PARTS}
    read = {c: np.frombuffer(parts[c], dtype=kinds[c]) for c in _PARTS}
    return Tree(**(read | {"points": read["points"].reshape(-1, dim)}))


@dataclass
class Index:
    """Shards, a row each with its tree ``(dim, leaf, part, ids, points, ...)``, and the top of each dimension."""

    shards: DataFrame
    tops: dict[int, Tree]


def build_index(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> Index:
    """Every usable row is indexed: null ids and vectors that are null, empty, zero or hold null or
    non-finite components are left out. Rows that repeat an id are held each.

    The top is a tree of a sample of at most :data:`SAMPLE_BYTES`, those of the least hash of the id.
    """
    rows = _rows(df, id_col, vector_col)
    tops = {}
    for dim, n in rows.groupBy("dim").count().collect():
        want = min(MAX_LEAVES, -(-n // SHARD_ROWS))
        size = min(SAMPLE_PER_LEAF * want, max(1, SAMPLE_BYTES // (8 * dim)))
        some = rows.where(F.col("dim") == dim).select("id", "vector").orderBy(F.xxhash64("id"), "id").limit(size).toArrow()
        tops[dim] = Tree.build(*_arrays(some), leaf=-(-size // want))
    placed = written(_placed(rows, tops), "placed")
    sizes = F.broadcast(placed.groupBy("dim", "leaf").agg(F.ceil(F.count("*") / SHARD_ROWS).alias("parts")))  # MAX_LEAVES of each dimension

    def build(table: pa.Table) -> pa.Table:
        head = [table.column(c).slice(0, 1).combine_chunks() for c in ("dim", "leaf", "part")]
        parts = _packed(Tree.build(*_arrays(table)))
        return pa.Table.from_arrays([*head, *[pa.array([p], pa.binary()) for p in parts]], names=["dim", "leaf", "part", *_PARTS])

    keyed = placed.join(sizes, ["dim", "leaf"]).withColumn("part", F.pmod(F.xxhash64("id", F.lit(1)), "parts")).drop("parts")
    return Index(written(keyed.groupBy("dim", "leaf", "part").applyInArrow(build, _TREE), "trees"), tops)


def _placed(rows: DataFrame, tops: dict[int, Tree]) -> DataFrame:
    """``(dim, leaf, id, vector)``: every row with its leaf."""
    shared = rows.sparkSession.sparkContext.broadcast({d: _packed(t) for d, t in tops.items()})

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {d: _unpacked(dict(zip(_PARTS, t, strict=True)), d) for d, t in shared.value.items()}
        for batch in batches:
            dims = batch.column(2).to_numpy()
            for d in np.unique(dims):
                part = batch.filter(pa.array(dims == d))
                points = part.column(1).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                where, leaf = trees[int(d)].leaves(points)
                found = part.take(pa.array(where))
                yield pa.RecordBatch.from_arrays([found.column(2), pa.array(leaf.astype(np.int64)), found.column(0), found.column(1)], names=["dim", "leaf", "id", "vector"])

    return rows.select("id", "vector", "dim").mapInArrow(task, "dim int, leaf long, id long, vector array<double>")


def _rows(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    vector = F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"))
    return rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))


def _arrays(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    ids = table["id"].to_numpy()
    points = table["vector"].combine_chunks().flatten().to_numpy(zero_copy_only=False)
    return ids, points.reshape(len(ids), -1)


def _others(asked: DataFrame, tops: dict[int, Tree], factor: float) -> DataFrame:
    """The queries once for each leaf, but their own, that may hold a neighbour within the bound."""
    shared = asked.sparkSession.sparkContext.broadcast({d: _packed(t) for d, t in tops.items()})
    names = [x.split()[0] for x in _ASKED.split(", ")]

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trees = {d: _unpacked(dict(zip(_PARTS, t, strict=True)), d) for d, t in shared.value.items()}
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK_QUERIES):
                block = batch.slice(at, BLOCK_QUERIES)
                dims = block.column(0).to_numpy()
                for d in np.unique(dims):
                    part = block.filter(pa.array(dims == d))
                    points = part.column(5).flatten().to_numpy(zero_copy_only=False).reshape(part.num_rows, -1)
                    where, leaf = trees[int(d)].leaves(points, part.column(4).to_numpy() / factor)
                    other = leaf != part.column(1).to_numpy()[where]
                    where, leaf = where[other], leaf[other]
                    for a in range(0, len(where), 4096):
                        found = part.take(pa.array(where[a : a + 4096]))
                        columns = [found.column(0), pa.array(leaf[a : a + 4096].astype(np.int64)), *found.columns[2:]]
                        yield pa.RecordBatch.from_arrays(columns, names=names)

    return asked.select(*names).mapInArrow(task, _ASKED)


def _walked(index: Index, asked: DataFrame, k: int, factor: float) -> DataFrame:
    """``(row, query_id, vec_id, score)``: what each shard of its leaf gives a query."""
    shards = index.shards.select("dim", "leaf", "part")
    if shards.count() <= BROADCAST_SHARDS:
        shards = F.broadcast(shards)
    keys, fields = ("dim", "leaf", "part"), ("row", "query_id", "bound", "vector")
    kinds = {"row": "long", "query_id": "long", "bound": "double", "vector": "array<double>"} | dict.fromkeys(_PARTS, "binary")
    trees = index.shards.select(*keys, *[F.lit(None).cast(kinds[c]).alias(c) for c in fields], *_PARTS)
    sent = asked.join(shards, ["dim", "leaf"]).select(*keys, *fields, *[F.lit(None).cast("binary").alias(c) for c in _PARTS])
    wanted = sent.select(*keys).distinct()
    met = trees.join(wanted, list(keys), "left_semi").union(sent)
    met = met.repartition(*keys).sortWithinPartitions(*keys, F.col("row").asc_nulls_first())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree, dim = None, 0
        for batch in batches:
            is_tree = np.flatnonzero(batch.column(3).is_null().to_numpy(zero_copy_only=False))
            cuts = sorted({0, batch.num_rows, *is_tree.tolist(), *(is_tree + 1).tolist()})
            for a, b in zip(cuts, cuts[1:], strict=False):
                if a in is_tree:
                    dim = batch.column(0)[a].as_py()
                    tree = _unpacked({c: batch.column(7 + i)[a].as_py() for i, c in enumerate(_PARTS)}, dim)
                    continue
                for at in range(a, b, BLOCK_QUERIES):
                    block = batch.slice(at, min(BLOCK_QUERIES, b - at))
                    ids = block.column(4).to_numpy()
                    points = block.column(6).flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
                    best, who, _ = tree.search(ids, points, k, factor, block.column(5).to_numpy())
                    found = np.isfinite(best)
                    wide = lambda x: pa.array(np.broadcast_to(x[:, None], best.shape)[found])  # noqa: E731, B023
                    yield pa.RecordBatch.from_arrays([wide(block.column(3).to_numpy()), wide(ids), pa.array(who[found]), pa.array(best[found])], names=["row", "query_id", "vec_id", "score"])

    return met.mapInArrow(task, _FOUND)


def search(index: Index, queries: DataFrame, k: int = 10, factor: float = 1.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` nearest of each query among the indexed rows of other ids: ``(query_id, rank, vec_id, score)``.

    Ties go to the smaller ``vec_id``; a query with fewer candidates gets them all. Queries are
    compared with rows of their own dimension only. Null ids and vectors that are null, empty,
    zero or hold null or non-finite components take no part, as query or candidate. Rows that
    repeat an id are candidates of their own, and queries of their own with ``k`` neighbours each.
    """
    rows = _rows(queries, id_col, vector_col)
    rows = rows.where(F.col("dim").isin(*index.tops)) if index.tops else rows.limit(0)
    asked = _placed(rows, index.tops).withColumn("row", F.monotonically_increasing_id())
    asked = written(asked.select("dim", "leaf", "row", F.col("id").alias("query_id"), F.lit(float("inf")).alias("bound"), "vector"), "asked")
    order = Window.partitionBy("row").orderBy("score", "vec_id")
    home = written(_walked(index, asked, k, factor).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).drop("rank"), "home")
    farthest = home.groupBy("row").agg(F.when(F.count("*") == k, F.max("score")).alias("far"))
    bounded = asked.join(farthest, "row", "left").withColumn("bound", F.coalesce("far", F.lit(float("inf")))).drop("far")
    others = written(_others(bounded, index.tops, factor), "others")
    found = home.union(_walked(index, others, k, factor))
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return ranked.select("query_id", "rank", "vec_id", "score")


def nearest(df: DataFrame, every: int = 100, k: int = 10, factor: float = 1.0) -> DataFrame:
    """Search ``df`` for its own rows whose ``vec_id`` is divisible by ``every``, against all rows."""
    return search(build_index(df), df.where(F.col("vec_id") % every == 0), k, factor)
