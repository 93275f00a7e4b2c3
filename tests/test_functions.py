"""Scalar functions on literal values: results, nulls and errors."""

from __future__ import annotations

import math

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vexel import functions as V


def v(*xs) -> str:
    return "cast(array(" + ",".join(map(str, xs)) + ") as array<float>)"


@pytest.fixture(scope="module")
def one(spark):
    V.register(spark)
    return lambda expr: spark.sql(f"select {expr}").first()[0]


@pytest.mark.parametrize(
    "expr, expected",
    [
        (f"l2_distance({v(1, 2, 3)}, {v(4, 6, 3)})", 5.0),
        (f"l2_squared_distance({v(1, 2, 3)}, {v(4, 6, 3)})", 25.0),
        (f"l1_distance({v(1, 2, 3)}, {v(4, 6, 3)})", 7.0),
        (f"inner_product({v(1, 2, 3)}, {v(4, 5, 6)})", 32.0),
        (f"negative_inner_product({v(1, 2, 3)}, {v(4, 5, 6)})", -32.0),
        (f"cosine_distance({v(1, 0)}, {v(0, 1)})", 1.0),
        (f"cosine_distance({v(1, 0)}, {v(-1, 0)})", 2.0),
        (f"vector_dims({v(1, 2)})", 2),
        (f"vector_norm({v(3, 4)})", 5.0),
        (f"vec_normalize({v(0, 0)})", [0.0, 0.0]),
        (f"subvector({v(10, 20, 30, 40)}, 2, 2)", [20.0, 30.0]),
        (f"vec_add({v(1, 2)}, {v(3, 4)})", [4.0, 6.0]),
        (f"vec_sub({v(1, 2)}, {v(3, 5)})", [-2.0, -3.0]),
        (f"vec_mul({v(1, 2)}, {v(3, 4)})", [3.0, 8.0]),
        ("vec_zeros(2)", [0.0, 0.0]),
        ("to_vec(' [1, 2.5,-3 ] ')", [1.0, 2.5, -3.0]),
        ("vec_to_text(to_vec('[1,2.5,1e10,-2.5e-7]'))", "[1, 2.5, 10000000000, -0.00000025]"),
        ("jsonb_to_vec('[1, 2.5]')", [1.0, 2.5]),
        ("to_half(cast(2049 as float))", 2048.0),
        ("sparsevec_to_text(to_sparsevec('{1:1.5,5:2.25}/10'))", "{1:1.5,5:2.25}/10"),
        ("sparsevec_l2_distance(to_sparsevec('{1:1,2:2}/3'), to_sparsevec('{2:2,3:1}/3'))", math.sqrt(2)),
        ("sparsevec_inner_product(to_sparsevec('{1:1,2:2}/3'), to_sparsevec('{2:2,3:1}/3'))", 4.0),
        ("hamming_distance(to_bitvec('1010'), to_bitvec('1100'))", 2.0),
        ("jaccard_distance(to_bitvec('1110'), to_bitvec('1011'))", 0.5),
        ("jaccard_distance(to_bitvec('00'), to_bitvec('00'))", 0.0),
        (f"bitvec_to_text(binary_quantize({v(-0.1, 0.5, 0, 0.7, -2.0)}))", "01010"),
        ("bitvec_popcount(to_bitvec('11010110'))", 5),
        (f"max_sim(array({v(1, 0)}, {v(0, 1)}), array({v(1, 0)}, {v(0, 1)}, {v(1, 1)}))", 2.0),
        (f"max_sim(array({v(1, 0)}), cast(array() as array<array<float>>))", 0.0),
        (f"max_sim_cosine(array({v(1, 0)}), array({v(0, 0)}))", -math.inf),
        ("rrf_score(0)", 1 / 60),
        ("rrf_score(1, 10)", 1 / 11),
        ("l2_distance(null, array(1.0f))", None),
        ("vec_to_text(null)", None),
        ("binary_quantize(null)", None),
    ],
)
def test_values(one, expr, expected):
    assert one(expr) == expected


@pytest.mark.parametrize("expr", [f"cosine_distance({v(0, 0)}, {v(0, 1)})", "sparsevec_cosine_distance(to_sparsevec('{}/3'), to_sparsevec('{2:2}/3'))"])
def test_zero_norm_is_nan(one, expr):
    assert math.isnan(one(expr))


@pytest.mark.parametrize(
    "expr",
    [
        f"l2_distance({v(1, 2)}, {v(1, 2, 3)})",
        f"subvector({v(1, 2, 3)}, 2, 5)",
        f"subvector({v(1, 2, 3)}, 0, 1)",
        "to_vec('')",
        "to_vec('1, 2, 3')",
        "to_vec('[1, 2,]')",
        "to_vec('[]')",
        "to_vec('[NaN]')",
        "to_vec('[inf]')",
        "to_vec('[1e40]')",
        "jsonb_to_vec('{\"a\":1}')",
        "jsonb_to_vec('[1,\"x\",3]')",
        "jsonb_to_vec('[1,null,3]')",
        f"halfvec_mul({v(300)}, {v(300)})",
        "vector_concat(vec_zeros(9000), vec_zeros(9000))",
        "to_sparsevec('{5:1,1:2}/10')",
        "to_sparsevec('{11:1}/10')",
        "to_bitvec('102')",
        f"vec_check_dim({v(1)}, 2)",
        f"vec_add({v('3.4e38')}, {v('3.4e38')})",
        "rrf_score(-60)",
        f"max_sim(array({v(1, 0)}), array({v(1)}))",
        "array_to_vec(array(1.0f, null))",
        "float8_array_to_vec(array(1e300D))",
        "vec_zeros(0)",
    ],
)
def test_errors(one, expr):
    with pytest.raises(Exception, match="USER_RAISED_EXCEPTION"):
        one(expr)


def test_columns_and_operators_are_the_same_functions(spark):
    df = spark.createDataFrame([([1.0, 2.0], [4.0, 6.0])], "a array<float>, b array<float>")
    row = df.select(V.l2_distance("a", "b").alias("f"), V.operator("<->", "a", "b").alias("o"), V.vec_add("a", "b").alias("s")).first()
    assert (row["f"], row["o"], row["s"]) == (5.0, 5.0, [5.0, 8.0])


def test_random_unit_vectors_vary(spark):
    V.register(spark)
    rows = [r[0] for r in spark.range(3).select(F.expr("vec_random_unit(16)")).collect()]
    assert len({tuple(r) for r in rows}) == 3
    assert all(abs(np.linalg.norm(r) - 1) < 1e-5 for r in rows)


floats = st.floats(-100, 100, width=32)


@settings(max_examples=15, deadline=None)
@given(st.lists(st.tuples(floats, floats, floats), min_size=1, max_size=8))
def test_half_rounding_and_metric_axioms(spark, rows):
    a, b, c = (np.asarray(x, dtype=np.float32) for x in zip(*rows, strict=True))
    df = spark.createDataFrame([(a.tolist(), b.tolist(), c.tolist())], "a array<float>, b array<float>, c array<float>")
    r = df.select(V.vector_to_halfvec("a").alias("h"), *[V.l2_distance(x, y).alias(x + y) for x, y in ("ab", "ba", "bc", "ac")]).first()
    assert r["h"] == a.astype(np.float16).astype(np.float32).tolist()
    assert r["ab"] == r["ba"] >= 0
    assert r["ac"] <= r["ab"] + r["bc"] + 1e-9
