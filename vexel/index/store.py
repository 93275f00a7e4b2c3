"""Build, search and maintain persistent indexes.

An index is a folder with numbered manifests and a folder for each version. A version holds
``codes`` (row id, scale, packed codes; by cell for ``ivf`` and ``colbert``), for ``graph`` a row
for each shard instead, and ``deltas`` with what was inserted since, all as Parquet. ``deleted``
lists removed and replaced ids. Deltas and lists are numbered: a list hides what is older than itself, so
an id may come again. Every change is written beside the old data and takes effect when a
manifest of the next number appears by a rename; readers take the one of the greatest number,
which is always whole.
"""

from __future__ import annotations

import json
import uuid
import warnings
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vexel.config import SearchConfig
from vexel.functions import vector
from vexel.index import graph, kmeans
from vexel.quantize import Quantizer
from vexel.operators.search import BROADCAST_IDS, QUERY_BLOCK, QUERY_STRIP, blocks_of, distance, least, offered, parse_allowlist, with_ids

FORMAT = 2
KINDS = ("flat", "ivf", "graph", "colbert")
#: Vectors sampled for each cell to train its centre, and bytes of the sample, which goes to the driver, at most.
SAMPLE_PER_CELL, SAMPLE_BYTES = 256, 256_000_000
#: Rows of a graph shard, about.
GRAPH_SHARD_ROWS = 5_000
DEFAULT_TOKEN_LISTS = 64
KEPT_MANIFESTS = 8
_CODES = "row_id long, scale float, codes binary"
_FOUND = "qid long, row_id long, score double"
#: Estimates that a task keeps at once, for all queries of a block together.
_KEPT = 16_000_000
#: Rows scored at a time; estimates held at once of a graph's shard, for the queries that walk it together.
_SCORED, _WALKED = 2048, 2_500_000
_GRAPH = "shard int, entry int, ids binary, scales binary, codes array<binary>, offsets binary, neighbours binary"


class IndexFormatError(RuntimeError):
    """The folder holds no index that this version reads; build it again."""


class IndexConflictError(RuntimeError):
    """Another change of the index came first."""


@dataclass(frozen=True)
class IndexSpec:
    """Options of an index. ``metric`` orders the exact re-ranking; candidates are drawn by cosine."""

    kind: str = "flat"
    metric: str = "cosine"
    bit_width: int = 4
    dim: int = 0
    lists: int = 0
    assign_dups: int = 1
    normalize: bool = True
    predicate: str | None = None

    def __post_init__(self) -> None:
        if self.kind not in KINDS or self.metric not in ("ip", "cosine", "l2", "l1"):
            raise ValueError("unknown kind or metric")
        if not 2 <= self.bit_width <= 4 or self.dim < 0 or self.dim % 8 or not 0 <= self.lists <= 1_000_000 or not 1 <= self.assign_dups <= 4:
            raise ValueError("bit_width must be 2 to 4, dim a multiple of 8, lists 0 to 1000000, assign_dups 1 to 4")
        if self.kind == "graph" and self.lists:
            raise ValueError("a graph has no lists")
        if self.kind == "ivf" and not self.lists:
            raise ValueError("ivf needs lists")


@dataclass
class Index:
    """A handle on one version of an index."""

    spark: SparkSession
    path: str
    manifest: dict = field(default_factory=dict)

    @staticmethod
    def open(spark: SparkSession, path: str) -> Index:
        number = _newest(spark, path)
        text = _read(spark, f"{path}/{_name(number)}" if number else f"{path}/manifest.json")
        if text is None:
            raise IndexFormatError(f"no index at {path}; build it")
        manifest = json.loads(text)
        if manifest.get("format") != FORMAT:
            raise IndexFormatError(f"the index at {path} has format {manifest.get('format')}, not {FORMAT}; build it again")
        return Index(spark, path, manifest)

    @property
    def spec(self) -> IndexSpec:
        return IndexSpec(**self.manifest["spec"])

    @property
    def quantizer(self) -> Quantizer:
        return Quantizer(self.spec.dim, self.spec.bit_width, self.manifest["rotation_seed"])

    @property
    def centers(self) -> np.ndarray:
        return np.asarray(self.manifest["centers"], dtype=np.float32)

    def _dir(self, name: str) -> str:
        return f"{self.path}/{self.manifest['version']}/{name}"

    def codes(self) -> DataFrame:
        """Rows ``(row_id, scale, codes[, cell])`` of this version, deltas in, what is hidden out (graph: deltas only)."""
        parts = [] if self.spec.kind == "graph" or not self.manifest["rows"] else [(self._dir("codes"), 0)]
        parts += self.manifest["deltas"]
        if not parts:
            return self.spark.createDataFrame([], _CODES + (", cell int" if self.manifest["centers"] else ""))
        rows = None
        for path, number in parts:
            one = self.spark.read.parquet(path).withColumn("_number", F.lit(number))
            rows = one if rows is None else rows.unionByName(one)
        gone = self._gone()
        if gone is not None:
            hiding = F.broadcast(gone) if gone.count() <= BROADCAST_IDS else gone
            rows = rows.join(hiding, "row_id", "left").where("_hidden IS NULL OR _number >= _hidden").drop("_hidden")
        return rows.drop("_number")

    def _gone(self) -> DataFrame | None:
        """``(row_id, _hidden)``: rows of the id older than that number are hidden."""
        gone = None
        for path, number in self.manifest["deleted"]:
            one = self.spark.read.parquet(path).select("row_id", F.lit(number).alias("_hidden"))
            gone = one if gone is None else gone.union(one)
        return None if gone is None else gone.groupBy("row_id").agg(F.max("_hidden").alias("_hidden"))

    def _shard_ids(self) -> DataFrame:
        """``(shard, row_id)`` of the rows in a graph's shards, hidden ones in."""

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for shard, ids in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    ids = np.frombuffer(ids, "<i8")
                    yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), shard, dtype=np.int32)), pa.array(ids)], names=["shard", "row_id"])

        return self.spark.read.parquet(self._dir("codes")).select("shard", "ids").mapInArrow(task, "shard int, row_id long")

    def ids(self) -> DataFrame:
        """``(row_id)`` of all live rows, each once."""
        rows = self.codes().select("row_id")
        if self.spec.kind == "graph" and self.manifest["rows"]:
            shards = self._shard_ids().select("row_id")
            rows = rows.union(with_ids(shards, self._gone(), "row_id", keep=False))
        return rows.distinct()

    def is_degraded(self) -> bool:
        """Whether rows of an index with cells are held outside of them."""
        return self.spec.lists > 0 and not self.manifest["centers"] and bool(self.manifest["rows"])

    def candidates(self, query: Sequence[float], n: int, allowed=None, probes: int | None = None) -> DataFrame:
        """``(row_id, score)`` of the ``n`` rows with the best estimates, each row once.

        Allowed ids filter before scoring, so the answer is short only if the allowed rows are few
        or in cells that were not probed.
        """
        found = self._candidates(np.zeros(1, dtype=np.int64), np.asarray([query], dtype=np.float32), n, allowed, probes)
        return found.groupBy("row_id").agg(F.max("score").alias("score")).orderBy(F.desc("score"), "row_id").limit(n)

    def _candidates(self, ids: np.ndarray, queries: np.ndarray, n: int, allowed=None, probes: int | None = None) -> DataFrame:
        """``(qid, row_id, score)``: every task's best rows for each query of a block, in one scan."""
        quantizer = self.quantizer  # worked out anew each time
        q = np.stack([quantizer.prepare(x, self.spec.normalize) for x in queries])
        if self.is_degraded():
            warnings.warn(f"index {self.path} serves without its cells; rebuild it", stacklevel=3)
        rows, probed = self.codes(), None
        if len(self.manifest["centers"]):
            dist = kmeans.squared_distances(q, self.centers)
            order = np.argsort(dist, axis=1, kind="stable")[:, : probes or SearchConfig().probes]
            probed = np.zeros(dist.shape, dtype=bool)
            np.put_along_axis(probed, order, True, axis=1)
            if not probed.any(axis=0).all():
                rows = rows.where(F.col("cell").isin(*[int(c) for c in np.flatnonzero(probed.any(axis=0))]))
        rows = with_ids(rows, allowed, "row_id").select("row_id", "scale", "codes", *(["cell"] if probed is not None else []))
        found = rows.mapInArrow(_score(quantizer, ids, q, n * self.spec.assign_dups, probed), _FOUND)
        if self.spec.kind == "graph" and self.manifest["rows"]:
            found = found.union(self._walk(ids, q, n, allowed))
        return found

    def _walk(self, query_ids: np.ndarray, queries: np.ndarray, n: int, allowed) -> DataFrame:
        """Graph search in every shard. Filters can't steer a walk: with allowed ids, shards are scored in full, as where all rows are wanted.

        A shard's beam is widened by what is hidden of that shard.
        """
        shards = self.spark.read.parquet(self._dir("codes"))
        quantizer, whole = self.quantizer, allowed is not None
        gone, dead, n_dead = self._gone(), np.zeros(0, dtype=np.int64), 0
        if gone is not None:
            n_dead = gone.count()
            if n_dead <= BROADCAST_IDS:
                dead, n_dead = np.sort(gone.select("row_id").toArrow()["row_id"].to_numpy()), 0

        def rows_of(asked: np.ndarray, who: np.ndarray, scores: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x) for x in (asked, who, scores.astype(float))], names=["qid", "row_id", "score"])

        def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best = None
            for r in (batch.slice(at, 1).to_pylist()[0] for batch in batches for at in range(batch.num_rows)):
                ids, scales = np.frombuffer(r["ids"], "<i8"), np.frombuffer(r["scales"], "<f4")
                points = quantizer.levels[quantizer.unpack(r["codes"])] * scales[:, None]
                offsets, neighbours = np.frombuffer(r["offsets"], "<i8"), np.frombuffer(r["neighbours"], "<i4")
                hidden = np.isin(ids, dead)
                wanted = n + n_dead + int(hidden.sum())
                full = whole or wanted >= len(ids)
                # The best of a task's shards are kept, unless all are wanted, rows go out later on, or an id has several places.
                merged = not (full or n_dead or (ids[1:] == ids[:-1]).any())
                if merged and best is None:
                    best, who = np.full((len(query_ids), n), np.inf, dtype=np.float32), np.zeros((len(query_ids), n), dtype=np.int64)
                strip = max(1, _WALKED // max(len(ids), 1))
                for s in (slice(a, a + strip) for a in range(0, len(query_ids), strip)):
                    # A product for all places costs less than to gather those that the walks come to.
                    scores = queries[s] @ points.T
                    if full:
                        live = np.flatnonzero(~hidden)
                        places, scores = np.broadcast_to(live, (len(scores), len(live))), scores[:, live]
                    else:
                        places, scores = graph.search(scores, offsets, neighbours, r["entry"], wanted, hidden)
                    if merged:
                        keys = np.concatenate([best[s], np.where(places >= 0, -scores, np.inf)], axis=1)
                        best[s], who[s] = least(keys, np.concatenate([who[s], ids[places]], axis=1), n)
                    else:
                        some = places >= 0
                        yield rows_of(np.broadcast_to(query_ids[s, None], some.shape)[some], ids[places[some]], scores[some])
            if best is not None:
                some = ~np.isposinf(best)
                yield rows_of(np.broadcast_to(query_ids[:, None], some.shape)[some], who[some], -best[some])

        found = shards.mapInArrow(task, _FOUND)
        return with_ids(with_ids(found, gone if n_dead else None, "row_id", keep=False), allowed, "row_id")

    def search(self, base: DataFrame, query: Sequence[float], k: int, config: SearchConfig | None = None, id_col: str = "id", vector_col: str = "vector", allowed=None, where: str | None = None, exhaustive: bool = False) -> DataFrame:
        """The ``k`` nearest rows of ``base`` by the index: candidates, then exact distances ``dist``.

        If ``exhaustive``, every row is a candidate, which gives the exact answer. ``where`` filters candidates after the fact and may leave fewer than ``k``; with
        ``iterative_scan`` set to relaxed_order, candidates and probes double until there are
        ``k`` or the limits of the settings are reached.
        """
        if k < 1:
            raise ValueError("k must be positive")
        config = config or SearchConfig()
        allowed = parse_allowlist(config.allowlist) if allowed is None else allowed
        n, probes = config.candidates(k, self.spec.dim), config.probes
        if exhaustive:
            n, probes = max(k, self.manifest["rows"] + self.manifest["inserted"]), max(1, len(self.manifest["centers"]))
        most = min(config.max_scan_tuples, max(1, self.manifest["rows"] + self.manifest["inserted"]))
        while True:
            if exhaustive:
                near = self._candidates(np.zeros(1, dtype=np.int64), np.asarray([query], dtype=np.float32), n, allowed, probes).select("row_id").distinct()
            else:
                near = self.candidates(query, n, allowed, probes).select("row_id")
            # At most n candidate rows.
            near = near.withColumnRenamed("row_id", "_row")
            near = F.broadcast(near) if n <= BROADCAST_IDS else near
            rows = base.join(near, F.col(id_col) == F.col("_row")).drop("_row")
            rows = rows.where(where) if where else rows
            top = rows.withColumn("dist", distance(self.spec.metric, F.col(vector_col), vector(query))).orderBy(F.col("dist").asc_nulls_last(), id_col).limit(k)
            last = n >= most and probes >= min(config.max_probes, max(1, len(self.manifest["centers"])))
            if exhaustive or config.iterative_scan == "off" or last or top.count() >= k:
                return top
            n, probes = min(2 * n, most), min(2 * probes, config.max_probes)

    def batch_search(self, base: DataFrame, queries: DataFrame, k: int, config: SearchConfig | None = None, id_col: str = "id", vector_col: str = "vector", query_id: str = "qid", query_vector: str = "query", exclude_self: bool = False) -> DataFrame:
        """The ``k`` nearest rows of ``base`` for every query: ``(qid, rank, id, dist)``.

        Queries go to the tasks in blocks, each of which scans the index once; candidates and exact
        distances are as in :meth:`search`. Queries with null ids or vectors take no part. With
        ``exclude_self`` a query's own id is no candidate.
        """
        if k < 1:
            raise ValueError("k must be positive")
        config = config or SearchConfig()
        n = config.candidates(k, self.spec.dim) + exclude_self
        asked = queries.where(F.col(query_vector).isNotNull() & F.col(query_id).isNotNull()).select(F.col(query_id).cast("long").alias("q"), F.col(query_vector).cast("array<double>").alias("v"))
        found = None
        for ids, points in blocks_of(asked, max(1, min(QUERY_BLOCK, _KEPT // (n * self.spec.assign_dups)))):
            one = self._candidates(ids, points.astype(np.float32), n, parse_allowlist(config.allowlist), config.probes)
            found = one if found is None else found.union(one)
        if found is None:
            return self.spark.createDataFrame([], "qid long, rank int, id long, dist double")
        best = found.groupBy("qid", "row_id").agg(F.max("score").alias("score"))
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "row_id")
        near = best.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= n)
        near = near.where("qid <> row_id") if exclude_self else near
        rows = base.select(F.col(id_col).cast("long").alias("id"), F.col(vector_col).alias("_vector")).join(near.select("qid", F.col("row_id").alias("id")), "id")
        rows = rows.join(asked.select(F.col("q").alias("qid"), F.col("v").cast("array<float>").alias("_query")), "qid")
        rows = rows.select("qid", "id", distance(self.spec.metric, F.col("_vector"), F.col("_query")).alias("dist"))
        order = Window.partitionBy("qid").orderBy(F.col("dist").asc_nulls_last(), "id")
        return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("qid", "rank", "id", "dist")

    def colbert_search(self, docs: DataFrame, query: Sequence[Sequence[float]], k: int, per_token_k: int = 64, candidate_n: int = 256, id_col: str = "id", token_col: str = "tokens", probes: int | None = None) -> DataFrame:
        """Late-interaction search with the token index for its first stage."""
        from vexel.operators.hybrid import rank_by_max_sim

        if self.spec.kind != "colbert":
            raise ValueError("not a token index")
        rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(token_col).alias("tokens"))
        if not len(query):
            return rows.select("id", F.lit(0.0).alias("score")).limit(0)
        found = self._candidates(np.arange(len(query)), np.asarray(query, dtype=np.float32), per_token_k, probes=probes)
        order = Window.partitionBy("qid").orderBy(F.desc("score"), "row_id")
        best = found.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= per_token_k * self.spec.assign_dups)
        chosen = best.groupBy("row_id").agg(F.max("score").alias("s")).orderBy(F.desc("s"), "row_id").limit(candidate_n)
        return rank_by_max_sim(rows.join(F.broadcast(chosen.select(F.col("row_id").alias("id"))), "id"), query, k)

    def insert(self, df: DataFrame, id_col: str = "id", vector_col: str = "vector") -> Index:
        """Append rows as a delta, encoded with the index's own rotation, codebook and cells.

        A row whose id is present replaces what was there, and one whose id was deleted is found
        again. Of rows that repeat an id within ``df`` all are held; the best counts in results.
        """
        number = self.manifest["last"] + 1
        name = f"{self.path}/{self.manifest['version']}/delta-{uuid.uuid4().hex}"
        rows = _encoded(_points(df, id_col, vector_col, self.spec), self.quantizer, self.spec, self.centers)
        rows.write.parquet(name)
        added = self.spark.read.parquet(name).select("row_id").distinct()
        changes = {"last": number, "deltas": [*self.manifest["deltas"], [name, number]], "inserted": self.manifest["inserted"] + added.count()}
        replaced = with_ids(added, self.ids(), "row_id")
        if replaced.limit(1).count():
            hidden = f"{name}-replaced"
            replaced.write.parquet(hidden)
            changes["deleted"] = [*self.manifest["deleted"], [hidden, number]]
        return self._swap(**changes)

    def delete(self, ids: DataFrame | Sequence[int]) -> Index:
        """Hide ids from every later search, until they are inserted again."""
        number = self.manifest["last"] + 1
        name = f"{self.path}/{self.manifest['version']}/deleted-{uuid.uuid4().hex}"
        listed = ids.select(F.col(ids.columns[0]).cast("long").alias("row_id")) if isinstance(ids, DataFrame) else self.spark.createDataFrame([(int(i),) for i in ids], "row_id long")
        listed.write.parquet(name)
        return self._swap(last=number, deleted=[*self.manifest["deleted"], [name, number]])

    def vacuum(self, base: DataFrame | None = None, id_col: str = "id", vector_col: str = "vector") -> Index:
        """Drop what is hidden and fold deltas in, without encoding live rows anew.

        A graph keeps the shards without hidden rows; the live rows of the others and of deltas,
        whose vectors are taken from ``base``, make new shards. The old version is kept for
        readers until the next change of version.
        """
        version, rows = uuid.uuid4().hex, self.ids().count()
        target = f"{self.path}/{version}/codes"
        if rows and self.spec.kind == "graph":
            if base is None:
                raise ValueError("a graph needs the base table")
            gone, parts = self._gone(), []
            if self.manifest["rows"]:
                shards = self._shard_ids()
                hit = with_ids(shards, gone, "row_id").select("shard").distinct() if gone is not None else shards.select("shard").limit(0)
                parts.append(self.spark.read.parquet(self._dir("codes")).join(hit, "shard", "left_anti"))
                loose = with_ids(shards.join(hit, "shard", "left_semi").select("row_id"), gone, "row_id", keep=False)
            else:
                loose = self.spark.createDataFrame([], "row_id long")
            points = with_ids(_points(base, id_col, vector_col, self.spec), loose.union(self.codes().select("row_id")), "row_id")
            count = points.count()
            if count:
                first = 1 + max([r[0] for r in parts[0].agg(F.coalesce(F.max("shard"), F.lit(-1))).collect()] if parts else [-1])
                parts.append(_sharded(points, count, -1, first, self.quantizer, self.spec))
            for part in parts:
                part.write.mode("append").parquet(target)
        elif rows:
            live = self.codes()
            if self.manifest["centers"]:
                live.sortWithinPartitions("cell").write.partitionBy("cell").parquet(target)
            else:
                live.write.parquet(target)
        return self._swap(version=version, rows=rows, inserted=0, deltas=[], deleted=[], previous=self.manifest["version"])

    def compact(self, base: DataFrame, id_col: str = "id", vector_col: str = "vector") -> Index:
        """Rebuild from the rows of ``base`` that are live in the index; the old version stays until the swap."""
        return build_index(with_ids(base, self.ids(), id_col), self.path, self.spec, id_col, vector_col)

    def drop(self) -> None:
        """Remove the index with all its versions."""
        fs, p = _fs(self.spark, self.path)
        fs.delete(p, True)

    def _swap(self, **changes) -> Index:
        manifest = self.manifest | changes
        return Index(self.spark, self.path, _publish(self.spark, self.path, manifest))


def _score(quantizer: Quantizer, ids: np.ndarray, queries: np.ndarray, n: int, probed: np.ndarray | None):
    """Scan of codes for a block of queries, each with the rows of the cells that it probes; the ``n`` best of each stay."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        strips = [slice(a, a + QUERY_STRIP) for a in range(0, len(ids), QUERY_STRIP)]
        # Scores are negative in here, so that the least are the best.
        best = [(np.zeros((len(ids[s]), 0), dtype=np.float32), np.zeros((len(ids[s]), 0), dtype=np.int64)) for s in strips]
        for batch in (whole.slice(a, _SCORED) for whole in batches for a in range(0, whole.num_rows, _SCORED)):
            rows, scale = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            points = -quantizer.levels[quantizer.unpack(batch.column(2).to_pylist())] * scale[:, None]
            cell = batch.column(3).to_numpy() if probed is not None else np.zeros(len(rows), dtype=np.int64)
            for c in np.unique(cell):
                at = np.flatnonzero(cell == c)
                for i, s in enumerate(strips):
                    asking = np.flatnonzero(probed[s, c]) if probed is not None else np.arange(len(ids[s]))
                    if len(asking):
                        best[i] = offered(best[i], asking, queries[s][asking] @ points[at].T, rows[at], n)
        for s, (scores, who) in zip(strips, best, strict=True):
            some = np.isfinite(scores)
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (np.broadcast_to(ids[s, None], scores.shape)[some], who[some], -scores[some].astype(float))], names=["qid", "row_id", "score"])

    return task


def _points(df: DataFrame, id_col: str, vector_col: str, spec: IndexSpec) -> DataFrame:
    """``(row_id, v)``; nulls are left out, a wrong dimension or a non-finite element raises."""
    df = df.where(spec.predicate) if spec.predicate else df
    if spec.kind == "colbert":
        df = df.select(id_col, F.explode(vector_col).alias(vector_col))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("row_id"), F.col(vector_col).cast("array<float>").alias("v"))
    wrong = (F.size("v") != spec.dim) | F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.withColumn("v", F.when(wrong, F.raise_error(F.lit("a vector has another dimension than the index or a non-finite element"))).otherwise(F.col("v")))


def _encoded(rows: DataFrame, quantizer: Quantizer, spec: IndexSpec, centers: np.ndarray) -> DataFrame:
    celled = len(centers) > 0

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            points = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            codes, scale = quantizer.encode(points, spec.normalize)
            packed, ids = quantizer.pack(codes), batch.column(0).to_numpy()
            columns = [ids, scale]
            names = ["row_id", "scale", "codes"]
            if celled:
                norm = np.sqrt((points.astype(float) ** 2).sum(axis=1, keepdims=True))
                turned = (points / np.where(norm > 0, norm, 1) if spec.normalize else points).astype(np.float32) @ quantizer.turn.T
                cells = kmeans.assign(turned, centers, spec.assign_dups)
                at = np.repeat(np.arange(len(ids)), [len(c) for c in cells])
                columns, packed = [ids[at], scale[at]], [packed[i] for i in at]
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(packed, pa.binary()), pa.array(np.concatenate(cells).astype(np.int32))], names=[*names, "cell"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(columns[0]), pa.array(columns[1]), pa.array(packed, pa.binary())], names=names)

    return rows.mapInArrow(task, _CODES + (", cell int" if celled else ""))


def build_index(df: DataFrame, path: str, spec: IndexSpec, id_col: str = "id", vector_col: str = "vector", config: SearchConfig | None = None) -> Index:
    """Build an index over ``df`` under ``path`` and make it the current version.

    Dimension 0 takes that of the first vector. Cells are trained on a bounded, seeded sample; every row is
    indexed. An empty input makes an empty index, to which rows can be inserted.
    """
    spark = df.sparkSession
    if not spec.dim:
        column = F.explode(vector_col) if spec.kind == "colbert" else F.col(vector_col)
        first = df.where(F.col(vector_col).isNotNull()).select(F.size(column.alias("v") if spec.kind != "colbert" else F.get(vector_col, F.lit(0)))).first()
        spec = replace(spec, dim=first[0] if first else 8)
    quantizer = Quantizer(spec.dim, spec.bit_width)
    if spec.kind == "colbert" and not spec.lists:
        spec = replace(spec, lists=DEFAULT_TOKEN_LISTS)
    rows = _points(df, id_col, vector_col, spec)
    n = rows.count()
    centers = np.zeros((0, spec.dim), dtype=np.float32)
    if spec.lists and n:
        few = rows.select("v", F.xxhash64("row_id", F.to_json("v")).alias("h")).orderBy("h").limit(min(SAMPLE_PER_CELL * spec.lists, SAMPLE_BYTES // (4 * spec.dim))).toArrow()
        points = few["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(few), -1)
        norm = np.sqrt((points.astype(float) ** 2).sum(axis=1, keepdims=True))
        centers = kmeans.train((points / np.where(norm > 0, norm, 1) if spec.normalize else points).astype(np.float32) @ quantizer.turn.T, spec.lists)
    version = uuid.uuid4().hex
    target = f"{path}/{version}/codes"
    if not n:
        pass
    elif spec.kind == "graph":
        parts = (config or SearchConfig()).graph_build_partitions
        _sharded(rows, n, parts, 0, quantizer, spec).write.parquet(target)
    else:
        coded = _encoded(rows, quantizer, spec, centers)
        if len(centers):
            # Several tasks may share a cell, so that a crowded one doesn't make one large file.
            coded.sortWithinPartitions("cell").write.partitionBy("cell").parquet(target)
        else:
            coded.write.parquet(target)
    manifest = {
        "format": FORMAT,
        "version": version,
        "spec": asdict(spec),
        "rows": n,
        "inserted": 0,
        "rotation_seed": quantizer.seed,
        "levels": [float(x) for x in quantizer.levels],
        "centers": [[float(x) for x in c] for c in centers],
        "last": 0,
        "deltas": [],
        "deleted": [],
    }
    number = _newest(spark, path)
    if number:
        old = json.loads(_read(spark, f"{path}/{_name(number)}"))
        manifest |= {"number": number, "previous": old.get("version")}
    return Index(spark, path, _publish(spark, path, manifest))


def _sharded(rows: DataFrame, n: int, parts: int, first: int, quantizer: Quantizer, spec: IndexSpec) -> DataFrame:
    """Graph shards of rows ``(row_id, v)``, ``parts`` of them or of about :data:`GRAPH_SHARD_ROWS`, numbered from ``first``."""
    shards = parts if parts > 0 else max(1, -(-n // GRAPH_SHARD_ROWS))
    keyed = rows.withColumn("shard", (F.pmod(F.xxhash64("row_id"), F.lit(shards)) + first).cast("int"))
    # As many partitions as shards: else several are built one after the other where they fit together by size.
    return keyed.repartition(shards, "shard").groupBy("shard").applyInArrow(_graph_shard(quantizer, spec), _GRAPH)


def _graph_shard(quantizer: Quantizer, spec: IndexSpec):
    def build(table: pa.Table) -> pa.Table:
        ids = table["row_id"].to_numpy()
        points = table["v"].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(len(ids), -1)
        order = np.argsort(ids, kind="stable")
        ids, points = ids[order], points[order]
        norm = np.sqrt((points.astype(float) ** 2).sum(axis=1, keepdims=True))
        links, entry = graph.build((points / np.where(norm > 0, norm, 1)).astype(np.float32))
        codes, scale = quantizer.encode(points, spec.normalize)
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in links])]).astype("<i8")
        flat = np.concatenate(links).astype("<i4") if links else np.zeros(0, "<i4")
        return pa.Table.from_arrays(
            [
                pa.array([table["shard"][0].as_py()], pa.int32()),
                pa.array([entry], pa.int32()),
                pa.array([ids.astype("<i8").tobytes()], pa.binary()),
                pa.array([scale.astype("<f4").tobytes()], pa.binary()),
                pa.array([quantizer.pack(codes)], pa.list_(pa.binary())),
                pa.array([offsets.tobytes()], pa.binary()),
                pa.array([flat.tobytes()], pa.binary()),
            ],
            names=[x.split()[0] for x in _GRAPH.split(", ")],
        )

    return build


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def _read(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def _name(number: int) -> str:
    return f"manifest-{number:010d}.json"


def _newest(spark: SparkSession, path: str) -> int:
    """Number of the newest manifest, 0 where there is none."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return 0
    names = [f.getPath().getName() for f in fs.listStatus(p)]
    return max((int(n[9:-5]) for n in names if n.startswith("manifest-") and n.endswith(".json")), default=0)


def _publish(spark: SparkSession, path: str, manifest: dict) -> dict:
    """Write the manifest of the next number beside the others, then give it its name by a rename.

    Raises :class:`IndexConflictError` if another change came first. Then versions older than the
    one before this and all manifests but the last few are removed.
    """
    number = manifest.get("number", 0) + 1
    manifest = manifest | {"number": number}
    fs, p = _fs(spark, f"{path}/{_name(number)}")
    fresh = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/.{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    out = fs.create(fresh, True)
    out.write(bytearray(json.dumps(manifest).encode()))
    out.close()
    if _newest(spark, path) >= number or not fs.rename(fresh, p):
        fs.delete(fresh, False)
        raise IndexConflictError(f"the index at {path} was changed meanwhile; open it again")
    keep = {manifest["version"], manifest.get("previous")}
    for f in fs.listStatus(p.getParent()):
        name = f.getPath().getName()
        old = f.isDirectory() and len(name) == 32 and name not in keep
        if old or name.startswith("manifest-") and int(name[9:-5]) <= number - KEPT_MANIFESTS:
            fs.delete(f.getPath(), True)
    return manifest
