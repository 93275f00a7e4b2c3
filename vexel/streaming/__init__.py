"""Streams into an index: an extension beyond batch loading."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from vexel.index import Index


def append_to_index(spark: SparkSession, path: str, id_col: str = "id", vector_col: str = "vector") -> Callable[[DataFrame, int], None]:
    """A ``foreachBatch`` sink that inserts each micro-batch into the index at ``path``.

    A batch that is run again after a failure is inserted again; results name an id once, so
    searches don't change.
    """

    def sink(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            Index.open(spark, path).insert(batch, id_col, vector_col)

    return sink
