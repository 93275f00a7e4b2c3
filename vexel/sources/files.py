"""Bulk load of vectors from text and from flat binary files."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.functions import call


def read_text_vectors(spark: SparkSession, path: str, schema: str, vector_cols: list[str], sep: str = "\t") -> DataFrame:
    """Delimited text whose vector columns are in text form, like ``[1, 2.5, -3]``; bad text raises."""
    rows = spark.read.schema(schema).option("sep", sep).csv(path)
    return rows.withColumns({c: call("to_vec", F.col(c)) for c in vector_cols})


def read_vector_file(spark: SparkSession, path: str, kind: str = "vectors") -> DataFrame:
    """Binary files: ``u32 dim, u32 n, f32[n * dim]`` as ``(id, vector)``, or with ``kind`` truth
    ``u32 k, u32 n, u32[n * k]`` as ``(id, neighbours)``. Ids count from 0 in each file."""
    value = "vector array<float>" if kind == "vectors" else "neighbours array<long>"

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                width, n = np.frombuffer(content[:8], "<u4").astype(int)
                body = np.frombuffer(content[8:], "<f4" if kind == "vectors" else "<u4")
                if len(body) != width * n:
                    raise ValueError("the file's length doesn't fit its header")
                body = body if kind == "vectors" else body.astype(np.int64)
                rows = pa.FixedSizeListArray.from_arrays(pa.array(body), width).cast(pa.list_(pa.float32() if kind == "vectors" else pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), rows], names=["id", value.split()[0]])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(task, f"id long, {value}")
