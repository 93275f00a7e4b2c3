"""Everything for SQL in one session: scalar functions and the search table functions."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql.functions import pandas_udf, udtf
from pyspark.sql.types import DoubleType, LongType, StructType

from vexel import functions
from vexel.quantize import Quantizer


_RESULT = StructType().add("id", LongType()).add("score", DoubleType())
#: Rows that a table function holds before it scores them and keeps the ``k`` best.
_HELD = 4096


class _Best:
    """Rows come one by one; they are scored a few thousand at a time, and the ``k`` best stay."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.best: list[tuple[float, int]] = []
        self.args: tuple | None = None

    def score(self, rows: list[tuple]) -> list[float]:
        raise NotImplementedError

    def take(self, row: tuple, *args) -> None:
        self.args = args
        self.rows.append(row)
        if len(self.rows) >= _HELD:
            self.fold()

    def fold(self) -> None:
        if self.rows:
            found = [(-s, r[0]) for s, r in zip(self.score(self.rows), self.rows, strict=True)]
            self.best = sorted(self.best + found)[: self.args[1]]
            self.rows = []

    def results(self):
        self.fold()
        for s, i in self.best:
            yield int(i), float(-s)


def _sound(vector, dim: int) -> bool:
    return vector is not None and len(vector) == dim and all(x is not None and abs(x) < float("inf") for x in vector)


@udtf(returnType=_RESULT)
class KnnTable(_Best):
    """``knn(TABLE(SELECT id, vector ...), query, k, bit_width[, allowed])``: quantised similarity, best first.

    ``allowed`` is an array of ids; null allows all, an empty one none. The table comes in one
    partition, of which ``k`` rows and a few thousand are held at a time; the DataFrame API's
    ``knn`` is the way for large tables.
    """

    def eval(self, row, query: list, k: int, bit_width: int, allowed: list | None = None):
        if k < 1:
            raise ValueError("k must be positive")
        if row[0] is not None and _sound(row[1], len(query)) and (allowed is None or row[0] in allowed):
            self.take((row[0], row[1]), query, k, bit_width)

    def score(self, rows: list[tuple]) -> list[float]:
        query, _, bits = self.args
        q = Quantizer(len(query), bits)
        codes, scale = q.encode(np.asarray([v for _, v in rows], dtype=np.float32))
        return q.scores(q.prepare(np.asarray(query, dtype=np.float32)), codes, scale).tolist()

    def terminate(self):
        yield from self.results()


@udtf(returnType=_RESULT)
class ColbertTable(_Best):
    """``colbert_search(TABLE(SELECT id, tokens ...), query, k)``: exact late-interaction scores, best first.

    Every document is scored, in one partition; the DataFrame API's ``colbert_search`` draws
    candidates first and is the way for large tables. Query tokens are normalised; a document with a
    token of another dimension or a non-finite element is left out, an empty query finds nothing.
    """

    def eval(self, row, query: list, k: int):
        if k < 1:
            raise ValueError("k must be positive")
        if query and row[0] is not None and row[1] is not None and all(_sound(t, len(query[0])) for t in row[1]):
            self.take((row[0], row[1]), query, k)

    def score(self, rows: list[tuple]) -> list[float]:
        q = np.asarray(self.args[0], dtype=np.float32).astype(float)
        norm = np.sqrt((q * q).sum(axis=1, keepdims=True))
        q = (q / np.where(norm > 0, norm, 1)).astype(np.float32).astype(float)
        return [float((q @ np.asarray(t, dtype=float).T).max(axis=1).sum()) if len(t) else 0.0 for _, t in rows]

    def terminate(self):
        yield from self.results()


@pandas_udf(DoubleType())
def self_score(vector: pd.Series, bit_width: pd.Series) -> pd.Series:
    """Quantised similarity of a vector with itself, a diagnostic of the quantiser."""
    known: dict[tuple[int, int], Quantizer] = {}

    def one(v, bits):
        if v is None or bits is None or np.isnan(bits):
            return None
        key = (len(v), int(bits))
        if key not in known:
            known[key] = Quantizer(*key)
        return known[key].self_score(np.asarray(v, dtype=np.float32))

    return pd.Series([one(v, b) for v, b in zip(vector, bit_width, strict=True)], dtype=float)


def register(spark: SparkSession) -> None:
    """Register all scalar functions, ``vexel_self_score`` and the table functions ``knn`` and ``colbert_search``."""
    functions.register(spark)
    spark.udtf.register("knn", KnnTable)
    spark.udtf.register("colbert_search", ColbertTable)
    spark.udf.register("vexel_self_score", self_score)
