"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from vexel.storage import new_path, shared_dir

__all__ = ["Scratch", "cleaning", "drop_path", "new_path", "shared_dir", "written"]

#: Spark removes a query's shuffle files at its end: its result is a table then, and is read from there.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def drop_path(spark: SparkSession, path: str) -> None:
    """Remove a path made by :func:`new_path` before the application ends."""
    jvm_path = spark._jvm.org.apache.hadoop.fs.Path(path)
    jvm_path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jvm_path.getParent(), True)


@contextmanager
def cleaning(spark: SparkSession):
    """Queries run inside leave no shuffle files, so none should be run twice."""
    before = spark.conf.get(_CLEAN, None)
    spark.conf.set(_CLEAN, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN, before) if before is not None else spark.conf.unset(_CLEAN)


def _write(df: DataFrame, path: str) -> DataFrame:
    spark = df.sparkSession
    with cleaning(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def written(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet to the shared folder and read it back: cuts lineage, survives lost executors."""
    return _write(df, new_path(df.sparkSession, name))


class Scratch:
    """Named tables in the shared folder, each dropped as soon as nothing needs it."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, {}

    def write(self, df: DataFrame, name: str) -> DataFrame:
        """Write and reread ``df`` like :func:`written`; a table of that name is dropped after that."""
        old, self.paths[name] = self.paths.get(name), new_path(self.spark, name)
        found = _write(df, self.paths[name])
        if old:
            drop_path(self.spark, old)
        return found

    def drop(self, *names: str) -> None:
        for name in names:
            drop_path(self.spark, self.paths.pop(name))
