"""The entry points and their agreement with DuckDB on the smallest tables."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb
import pytest

import __spark_entry__ as entry

DATA = "/root/testdata/sf0.001"
CORE = ["exact_l2_topk", "cosine_distance", "halfvec_cast", "sparsevec_l1_distance", "hamming_distance", "vector_avg_by_label", "batch_cosine_topk", "rrf_named_vectors", "colbert_exhaustive", "ann_ivf_all_probes", "ann_after_delete"]

pytestmark = pytest.mark.skipif(not Path(DATA).exists(), reason="no test tables")


def plain(x):
    if isinstance(x, float):
        return "nan" if math.isnan(x) else x
    return tuple(map(plain, x)) if isinstance(x, (list, tuple)) else x


def test_smoke(spark):
    assert entry.entry(spark).count() == 10


def test_oracles_belong_to_queries():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", CORE)
def test_core_queries_match_duckdb(spark, name):
    con = duckdb.connect()
    for t in ("embeddings", "documents"):
        con.execute(f"create view {t} as select * from '{DATA}/{t}.parquet'")
    expected = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, DATA)
    columns = sorted(df.columns)
    assert columns == sorted(expected.columns)
    want = [tuple(plain(v) for _, v in sorted(zip(expected.columns, r, strict=True))) for r in expected.fetchall()]
    got = [tuple(plain(r[c]) for c in columns) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, want))


def agree(spark, name, rows, folder):
    """A query's rows over a table of ``(vec_id, embedding, label)`` equal its SQL's, signs of zeros included."""
    spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").coalesce(1).write.parquet(f"{folder}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    expected = con.sql(entry.oracle_sql()[name])
    df = entry.queries()[name](spark, str(folder))
    got = [tuple(plain(r[c]) for c in expected.columns) for r in df.collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, map(plain, expected.fetchall())))
    return got


@pytest.mark.parametrize("name", ["vector_sum_rollup", "vector_sum_cube"])
def test_sums_that_round_to_zero_keep_their_sign(spark, tmp_path, name):
    got = agree(spark, name, [(i, [-0.0001, 0.0001, 0.25, -0.25], 1) for i in range(3)], tmp_path)
    assert any("-0.0" in repr(r) for r in got)


@pytest.mark.parametrize("name", ["halfvec_avg_by_label", "halfvec_sum_by_label", "halfvec_mul", "halfvec_cast", "vector_avg_by_label", "vector_sum_by_label", "sparsevec_sum_by_label"])
def test_vectors_that_round_to_zero_keep_their_sign(spark, tmp_path, name):
    """Elements, products, sums and averages that are tiny, of both signs, and just around half of the least half-precision number."""
    least = 2.0**-25
    first = [-1e-6, 1e-6, 0.25, -1e-4, -least, least, -least * 1.001, -0.5, 0.2, 0.0]
    agree(spark, name, [(0, first, 1), (1, first, 1), (2, [-x for x in first[:8]] + [-0.2000001, -0.0], 1), (3, [-x for x in first], 2)], tmp_path)


@pytest.mark.parametrize("name", ["vec_normalize", "l2_normalize", "inner_product", "negative_inner_product", "halfvec_negative_inner_product", "max_sim"])
def test_numbers_that_round_to_zero_keep_their_sign(spark, tmp_path, name):
    """Of 64 elements, all but a tiny one are orthogonal to row 0's."""
    rows = [(0, [1.0] + [0.0] * 63, 1)] + [(i, [x] + [0.0] * 62 + [0.7], 1) for i, x in enumerate((-1e-11, 1e-11, -1e-7, 1e-7), 1)]
    agree(spark, name, rows, tmp_path)


def test_whole_numbers_are_cut_from_single_precision(spark, tmp_path):
    """0.01 times 100 falls on either side of a whole number as it is worked out in single or double precision."""
    import numpy as np

    x = np.arange(1, 100, dtype=np.float32) / np.float32(100)
    x = x[np.trunc(x * np.float32(100)) != np.trunc(x.astype(float) * 100)]
    assert len(x)
    agree(spark, "int4_array_to_vec", [(0, [*map(float, x), *map(float, -x)], 1)], tmp_path)
