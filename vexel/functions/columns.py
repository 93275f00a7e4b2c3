"""Column builders for the functions of the catalog, under their own names.

``l2_distance("a", "b")`` and ``spark.sql("SELECT l2_distance(a, b) ...")`` are the same expression.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import partial

from pyspark.sql import Column
from pyspark.sql import functions as F

from vexel.functions.catalog import FUNCTIONS, call


def _builder(name: str) -> Callable[..., Column]:
    build = partial(call, name)
    build.__doc__ = f"``{name}({FUNCTIONS[name].parameters})`` -> ``{FUNCTIONS[name].returns}``"
    return build


globals().update({name: _builder(name) for name in FUNCTIONS})


def vector(values) -> Column:
    """A literal vector."""
    return F.array(*[F.lit(float(x)) for x in values]).cast("array<float>")


#: Symbols of the distance and arithmetic operators and the functions they stand for, by type.
OPERATORS = {
    "vector": {"<->": "l2_distance", "<#>": "negative_inner_product", "<=>": "cosine_distance", "<+>": "l1_distance", "+": "vec_add", "-": "vec_sub", "*": "vec_mul", "||": "vector_concat"},
    "halfvec": {"<->": "halfvec_l2_distance", "<#>": "halfvec_negative_inner_product", "<=>": "halfvec_cosine_distance", "<+>": "halfvec_l1_distance", "+": "halfvec_add", "-": "halfvec_sub", "*": "halfvec_mul", "||": "halfvec_concat"},
    "sparsevec": {"<->": "sparsevec_l2_distance", "<#>": "sparsevec_negative_inner_product", "<=>": "sparsevec_cosine_distance", "<+>": "sparsevec_l1_distance"},
    "bitvec": {"<~>": "hamming_distance", "<%>": "jaccard_distance"},
}


def operator(symbol: str, a: Column | str, b: Column | str, type: str = "vector") -> Column:
    """The operator's function applied to two columns."""
    return call(OPERATORS[type][symbol], a, b)


__all__ = [*FUNCTIONS, "vector", "operator", "OPERATORS"]
