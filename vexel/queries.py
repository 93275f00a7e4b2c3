"""Registered queries over ``embeddings`` and ``documents``, with their DuckDB equivalents.

Distances are rounded to nine places on both sides, as the last bits depend on the engines' order
of addition.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vexel.functions import call, expr, vector
from vexel.index import IndexSpec, build_index
from vexel.operators import aggregates, hybrid, search
from vexel.storage import new_path

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The query vector of single-vector searches: row 0 of ``embeddings``, in SQL.
_Q = "(SELECT embedding FROM embeddings WHERE vec_id = 0)"
_PAIRS = "SELECT e.vec_id, e.embedding AS a, q.embedding AS b FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"


def _ip(a: str, b: str) -> str:
    return f"list_inner_product({a}::DOUBLE[], {b}::DOUBLE[])"


def _fold(term: str, a: str, b: str) -> str:
    term = term.replace("x", f"{a}[i]::DOUBLE").replace("y", f"{b}[i]::DOUBLE")
    return f"list_sum(list_transform(range(1, len({a}) + 1), i -> {term}))"


_DUCK = {
    "l2": lambda a, b: f"sqrt({_fold('(x - y) * (x - y)', a, b)})",
    "l2_squared": lambda a, b: _fold("(x - y) * (x - y)", a, b),
    "ip": lambda a, b: f"-{_ip(a, b)}",
    "cosine": lambda a, b: f"1 - greatest(-1, least(1, {_ip(a, b)} / (sqrt({_ip(a, a)}) * sqrt({_ip(b, b)}))))",
    "l1": lambda a, b: _fold("abs(x - y)", a, b),
}


def _register(name: str, query: Query, sql: str | None = None) -> None:
    QUERIES[name] = query
    if sql is not None:
        SQL[name] = sql


def _embeddings(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/embeddings.parquet")


def _first(spark: SparkSession, d: str, n: int = 0) -> list[float]:
    return list(_embeddings(spark, d).where(F.col("vec_id") == n).first()["embedding"])


def _rounded(x: str, places: int) -> str:
    """``round`` in SQL; what it takes to zero keeps its sign, as in DuckDB."""
    return f"transform(array({x}), r -> CASE WHEN round(r, {places}) = 0 THEN r * 0D ELSE round(r, {places}) END)[0]"


def _rounded_all(array: str, places: int) -> str:
    """The elements of an array as doubles, each rounded by :func:`_rounded`'s rule."""
    return f"transform({array}, x -> CASE WHEN round(cast(x AS DOUBLE), {places}) = 0 THEN x * 0D ELSE round(cast(x AS DOUBLE), {places}) END)"


def _paired(spark: SparkSession, d: str) -> DataFrame:
    """Every row with row 0 beside it as ``b``."""
    return _embeddings(spark, d).select("vec_id", F.col("embedding").alias("a"), vector(_first(spark, d)).alias("b"))


# Exact searches
def _topk(metric: str) -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        top = search.exact_topk(_embeddings(spark, d), _first(spark, d), 10, metric, "vec_id", "embedding")
        return top.select("vec_id", F.expr(_rounded("dist", 9)).alias("dist"))

    dist = _DUCK[metric]("a", "b")
    _register(f"exact_{metric}_topk", query, f"SELECT vec_id, round({dist}, 9) AS dist FROM ({_PAIRS}) ORDER BY {dist}, vec_id LIMIT 10")


for _m in ("l2", "ip", "cosine", "l1"):
    _topk(_m)


# Scalars: one column for each function, over the whole table
def _scalar(name: str, spark_expr: Callable[[], F.Column] | str, duck: str, out: str = "value") -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        value = expr(spark_expr) if isinstance(spark_expr, str) else spark_expr()
        return _paired(spark, d).select("vec_id", value.alias(out))

    _register(name, query, f"SELECT vec_id, {duck} AS {out} FROM ({_PAIRS})")


for _m, _f in (("l2", "l2_distance"), ("l2_squared", "l2_squared_distance"), ("ip", "negative_inner_product"), ("cosine", "cosine_distance"), ("l1", "l1_distance")):
    _scalar(_f, _rounded(f"{_f}(a, b)", 9), f"round({_DUCK[_m]('a', 'b')}, 9)")
_scalar("inner_product", _rounded("inner_product(a, b)", 9), f"round({_ip('a', 'b')}, 9)")
_scalar("vector_dims", "vector_dims(a)", "len(a)::INTEGER")
_scalar("vector_norm", "round(vector_norm(a), 9)", f"round(sqrt({_ip('a', 'a')}), 9)")
_SCALED = "transform(a, x -> cast(x * (1 + vec_id % 7) AS FLOAT))"
_DSCALED = "list_transform(a, x -> (x * (1 + vec_id % 7))::FLOAT)"
_scalar("vec_normalize", _rounded_all(f"vec_normalize({_SCALED})", 6), f"list_transform({_DSCALED}, x -> round((x * (1 / sqrt({_ip(_DSCALED, _DSCALED)}))::FLOAT)::DOUBLE, 6))")
for _n, _o in (("add", "+"), ("sub", "-"), ("mul", "*")):
    _scalar(f"vec_{_n}", f"vec_{_n}(a, b)", f"list_transform(range(1, len(a) + 1), i -> (a[i] {_o} b[i])::FLOAT)")
_scalar("vector_concat", "vector_concat(a, b)", "list_concat(a, b)")
_scalar("subvector", "subvector(a, 9, 16)", "a[9:24]")
_scalar("vec_zeros", "vec_zeros(vector_dims(a))", "list_transform(range(len(a)), i -> 0::FLOAT)")
_scalar("vec_check_dim", "vec_check_dim(a, 64)", "a")
_scalar("array_to_vec", "array_to_vec(a)", "a")
_scalar("float8_array_to_vec", "float8_array_to_vec(transform(a, x -> cast(x AS DOUBLE)))", "a")
_scalar("int4_array_to_vec", "int4_array_to_vec(transform(a, x -> cast(x * cast(100 AS FLOAT) AS INT)))", "list_transform(a, x -> trunc(x * 100)::INTEGER::FLOAT)")
_scalar("jsonb_roundtrip", "jsonb_to_vec(vec_to_jsonb(a))", "a")
_scalar("text_roundtrip", "to_vec(vec_to_text(a))", "a")
_scalar("binary_quantize_text", "bitvec_to_text(binary_quantize(a))", "array_to_string(list_transform(a, x -> CASE WHEN x > 0 THEN '1' ELSE '0' END), '')")
_BITS = "list_sum(list_transform(range(1, len(a) + 1), i -> CASE WHEN {c} THEN 1 ELSE 0 END))"
_scalar("bitvec_popcount", "bitvec_popcount(binary_quantize(a))", _BITS.format(c="a[i] > 0") + "::BIGINT")
_scalar("hamming_distance", "hamming_distance(binary_quantize(a), binary_quantize(b))", _BITS.format(c="(a[i] > 0) <> (b[i] > 0)") + "::DOUBLE")
_BOTH, _EITHER = _BITS.format(c="a[i] > 0 AND b[i] > 0"), _BITS.format(c="a[i] > 0 OR b[i] > 0")
_scalar("jaccard_distance", "round(jaccard_distance(binary_quantize(a), binary_quantize(b)), 9)", f"round(CASE WHEN {_EITHER} = 0 THEN 0 ELSE 1 - {_BOTH}::DOUBLE / {_EITHER} END, 9)")

# Half precision: in DuckDB by rounding to the step of the number's binade
_HALF = "(CASE WHEN x = 0 THEN x ELSE round_even(x::DOUBLE / pow(2, greatest(-14, floor(log2(abs(x::DOUBLE)))) - 10), 0) * pow(2, greatest(-14, floor(log2(abs(x::DOUBLE)))) - 10) END)::FLOAT"
_HA, _HB = f"list_transform(a, x -> {_HALF})", f"list_transform(b, x -> {_HALF})"
_scalar("halfvec_cast", "vector_to_halfvec(a)", _HA)
_H = f"SELECT vec_id, {_HA} AS a, {_HB} AS b FROM ({_PAIRS})"
for _m, _f in (("l2", "l2_distance"), ("l2_squared", "l2_squared_distance"), ("ip", "negative_inner_product"), ("cosine", "cosine_distance"), ("l1", "l1_distance")):
    _scalar(f"halfvec_{_f}", _rounded(f"halfvec_{_f}(vector_to_halfvec(a), vector_to_halfvec(b))", 9), "0")
    SQL[f"halfvec_{_f}"] = f"SELECT vec_id, round({_DUCK[_m]('a', 'b')}, 9) AS value FROM ({_H})"
_scalar("halfvec_norm", "round(halfvec_norm(vector_to_halfvec(a)), 9)", "0")
SQL["halfvec_norm"] = f"SELECT vec_id, round(sqrt({_ip('a', 'a')}), 9) AS value FROM ({_H})"
_scalar("halfvec_concat", "halfvec_concat(vector_to_halfvec(a), vector_to_halfvec(b))", f"list_concat({_HA}, {_HB})")
for _n, _o in (("add", "+"), ("sub", "-"), ("mul", "*")):
    _scalar(f"halfvec_{_n}", f"halfvec_{_n}(vector_to_halfvec(a), vector_to_halfvec(b))", "0")
    SQL[f"halfvec_{_n}"] = f"SELECT vec_id, list_transform(list_transform(range(1, len(a) + 1), i -> (a[i] {_o} b[i])::FLOAT), x -> {_HALF}) AS value FROM ({_H})"

# Sparse vectors: elements beyond 0.15 in size
_SP = "vector_to_sparsevec(transform({v}, x -> if(abs(x) > cast(0.15 AS FLOAT), x, cast(0 AS FLOAT))))"
_DSP = "list_transform({v}, x -> CASE WHEN abs(x) > 0.15::FLOAT THEN x ELSE 0 END)"
_S = f"SELECT vec_id, {_DSP.format(v='a')} AS a, {_DSP.format(v='b')} AS b FROM ({_PAIRS})"
for _m, _f in (("l2", "l2_distance"), ("l2_squared", "l2_squared_distance"), ("ip", "negative_inner_product"), ("cosine", "cosine_distance"), ("l1", "l1_distance")):
    _scalar(f"sparsevec_{_f}", f"round(sparsevec_{_f}({_SP.format(v='a')}, {_SP.format(v='b')}), 9) + 0D", "0")
    SQL[f"sparsevec_{_f}"] = f"SELECT vec_id, round({_DUCK[_m]('a', 'b')}, 9) + 0.0::DOUBLE AS value FROM ({_S})"
_scalar("sparsevec_inner_product", _rounded(f"sparsevec_inner_product({_SP.format(v='a')}, {_SP.format(v='b')})", 9), "0")
SQL["sparsevec_inner_product"] = f"SELECT vec_id, round({_ip('a', 'b')}, 9) AS value FROM ({_S})"
_scalar("sparsevec_norm", f"round(sparsevec_norm({_SP.format(v='a')}), 9)", "0")
SQL["sparsevec_norm"] = f"SELECT vec_id, round(sqrt({_ip('a', 'a')}), 9) AS value FROM ({_S})"
_scalar("sparsevec_nnz", f"sparsevec_nnz({_SP.format(v='a')})", "0")
SQL["sparsevec_nnz"] = f"SELECT vec_id, len(list_filter(a, x -> x <> 0))::INTEGER AS value FROM ({_S})"
_scalar("sparsevec_roundtrip", f"sparsevec_to_vector(to_sparsevec(sparsevec_to_text({_SP.format(v='a')})))", "0")
SQL["sparsevec_roundtrip"] = f"SELECT vec_id, list_transform(a, x -> x::FLOAT) AS value FROM ({_S})"


_scalar("halfvec_inner_product", _rounded("halfvec_inner_product(vector_to_halfvec(a), vector_to_halfvec(b))", 9), "0")
SQL["halfvec_inner_product"] = f"SELECT vec_id, round({_ip('a', 'b')}, 9) AS value FROM ({_H})"
_scalar("halfvec_dims", "halfvec_dims(vector_to_halfvec(a))", "len(a)::INTEGER")
_scalar("sparsevec_dims", f"sparsevec_dims({_SP.format(v='a')})", "len(a)::INTEGER")
_scalar("bitvec_dims", "bitvec_dims(binary_quantize(a))", "len(a)::INTEGER")
_scalar("to_bitvec", "bitvec_to_text(to_bitvec(bitvec_to_text(binary_quantize(a))))", "array_to_string(list_transform(a, x -> CASE WHEN x > 0 THEN '1' ELSE '0' END), '')")
_scalar("vec_to_array", "vec_to_array(a)", "a")
_scalar("vector_to_float4", "vector_to_float4(a, 64, false)", "a")
_scalar("l2_normalize", _rounded_all(f"l2_normalize({_SCALED})", 6), SQL["vec_normalize"].split("SELECT vec_id, ", 1)[1].rsplit(" AS value FROM (", 1)[0])


# Late interaction: 8 tokens of 8 elements each
def _tokens(v: str) -> str:
    return f"transform(sequence(0, 7), i -> slice({v}, 8 * i + 1, 8))"


_DT = "list_transform(range(0, 8), i -> {v}[8 * i + 1 : 8 * i + 8])"


def _duck_max_sim(pair: str) -> str:
    q, t = _DT.format(v="b"), _DT.format(v="a")
    return f"list_sum(list_transform({q}, q -> list_max(list_transform({t}, d -> {pair}))))"


_COS = f"greatest(-1, least(1, {_ip('q', 'd')} / (sqrt({_ip('q', 'q')}) * sqrt({_ip('d', 'd')}))))"
_scalar("max_sim", _rounded(f"max_sim({_tokens('b')}, {_tokens('a')})", 9), f"round({_duck_max_sim(_ip('q', 'd'))}, 9)")
_scalar("max_sim_cosine", _rounded(f"max_sim_cosine({_tokens('b')}, {_tokens('a')})", 9), f"round({_duck_max_sim(_COS)}, 9)")


# Aggregates
def _grouped(name: str, build: Callable[[DataFrame], DataFrame], sql: str) -> None:
    _register(name, lambda spark, d: build(_embeddings(spark, d)), sql)


def _wide(column: str) -> F.Column:
    return F.expr(_rounded_all(column, 5))


_UNNEST = "SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings"
for _agg in ("avg", "sum"):
    _grouped(
        f"vector_{_agg}_by_label",
        lambda e, f=getattr(aggregates, f"vector_{_agg}"): f(e, ["label"], "embedding", "value").select("label", _wide("value").alias("value")),
        f"SELECT label, list(round(v::FLOAT::DOUBLE, 5) ORDER BY pos) AS value FROM (SELECT label, pos, {_agg}(x::DOUBLE) AS v FROM ({_UNNEST}) GROUP BY ALL) GROUP BY label",
    )
_KEYED = "SELECT label, vec_id % 3 AS third, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings"
for _kind, _sets in (("rollup", "(label, third, pos), (label, pos), (pos)"), ("cube", "(label, third, pos), (label, pos), (third, pos), (pos)")):
    _grouped(
        f"vector_sum_{_kind}",
        lambda e, sets=getattr(aggregates, f"{_kind}_sets"): aggregates.vector_sum(e.withColumn("third", F.col("vec_id") % 3), ["label", "third"], "embedding", "value", sets(["label", "third"])).select("label", "third", F.col("grouping_id").cast("long").alias("grouping_id"), F.expr(_rounded_all("value", 3)).alias("value")),
        f"SELECT label, third, g::BIGINT AS grouping_id, list(round(v::FLOAT::DOUBLE, 3) ORDER BY pos) AS value FROM (SELECT label, third, grouping(label, third) AS g, pos, sum(x::DOUBLE) AS v FROM ({_KEYED}) GROUP BY GROUPING SETS ({_sets})) GROUP BY label, third, g",
    )
_grouped(
    "vector_avg_distinct",
    lambda e: aggregates.vector_avg(e.select("label", F.transform("embedding", lambda x: F.signum(x).cast("float")).alias("embedding")).select("label", F.slice("embedding", 1, 4).alias("embedding")), ["label"], "embedding", "value", distinct=True).select("label", _wide("value").alias("value")),
    "SELECT label, list(round(v::FLOAT::DOUBLE, 5) ORDER BY pos) AS value FROM (SELECT label, pos, avg(x::DOUBLE) AS v FROM (SELECT label, unnest(e) AS x, generate_subscripts(e, 1) AS pos FROM (SELECT DISTINCT label, list_transform(embedding[1:4], x -> sign(x)) AS e FROM embeddings)) GROUP BY ALL) GROUP BY label",
)
_grouped(
    "sparsevec_sum_by_label",
    lambda e: aggregates.sparsevec_sum(e.select("label", F.expr("named_struct('dim', 64, 'indices', transform(filter(transform(embedding, (x, i) -> struct(x AS x, i AS i)), z -> abs(z.x) > cast(0.15 AS FLOAT)), z -> z.i), 'values', filter(embedding, x -> abs(x) > cast(0.15 AS FLOAT)))").alias("v")), ["label"], "v", "s").select("label", F.explode(F.arrays_zip(F.col("s.indices").alias("idx"), F.col("s.values").alias("x"))).alias("e")).select("label", F.col("e.idx").alias("idx"), F.expr(_rounded("cast(e.x AS DOUBLE)", 5)).alias("value")),
    f"SELECT label, (pos - 1)::INTEGER AS idx, round(sum(x::DOUBLE)::FLOAT::DOUBLE, 5) AS value FROM ({_UNNEST}) WHERE abs(x) > 0.15::FLOAT GROUP BY ALL HAVING sum(x::DOUBLE)::FLOAT <> 0",
)


def _half_avg(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d).select("label", call("vector_to_halfvec", "embedding").alias("h"))
    return aggregates.halfvec_avg(rows, ["label"], "h", "value").select("label", F.expr(_rounded_all("value", 3)).alias("value"))


_HALF_UNNEST = f"SELECT label, unnest({_HA}) AS x, generate_subscripts(a, 1) AS pos FROM (SELECT label, embedding AS a FROM embeddings)"
_register("halfvec_avg_by_label", _half_avg, f"SELECT label, list(round(v::DOUBLE, 3) ORDER BY pos) AS value FROM (SELECT label, pos, {_HALF.replace('x', 'm')} AS v FROM (SELECT label, pos, avg(x::DOUBLE)::FLOAT AS m FROM ({_HALF_UNNEST}) GROUP BY ALL)) GROUP BY label")


def _half_sum(spark: SparkSession, d: str) -> DataFrame:
    rows = _embeddings(spark, d).select("label", call("vector_to_halfvec", "embedding").alias("h"))
    return aggregates.halfvec_sum(rows, ["label"], "h", "value").select("label", F.expr(_rounded_all("value", 2)).alias("value"))


_register("halfvec_sum_by_label", _half_sum, f"SELECT label, list(round(v::DOUBLE, 2) ORDER BY pos) AS value FROM (SELECT label, pos, {_HALF.replace('x', 'm')} AS v FROM (SELECT label, pos, sum(x::DOUBLE)::FLOAT AS m FROM ({_HALF_UNNEST}) GROUP BY ALL)) GROUP BY label")


# Searches over many rows
def _batch(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    asked = e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))
    found = search.batch_topk(e, asked, 5, "cosine", "vec_id", "embedding", exclude_self=True)
    return found.select("qid", "rank", F.col("id").alias("vec_id"), F.round("dist", 9).alias("dist"))


_COSQ = _DUCK["cosine"]("e.embedding", "q.embedding")
_register(
    "batch_cosine_topk",
    _batch,
    f"SELECT qid, rank::INTEGER AS rank, vec_id, round(dist, 9) AS dist FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY dist, vec_id) AS rank FROM (SELECT q.vec_id AS qid, e.vec_id, {_COSQ} AS dist FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0)) WHERE rank <= 5",
)


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d).where("label = 3")
    return search.exact_topk(e, _first(spark, d), 10, "l2", "vec_id", "embedding").select("vec_id", "label", F.round("dist", 9).alias("dist"))


_L2 = _DUCK["l2"]("a", "b")
_LP = "SELECT e.vec_id, e.label, e.embedding AS a, q.embedding AS b FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 0) q"
_register("filtered_topk_label", _filtered, f"SELECT vec_id, label, round({_L2}, 9) AS dist FROM ({_LP}) WHERE label = 3 ORDER BY {_L2}, vec_id LIMIT 10")


def _allowed(spark: SparkSession, d: str) -> DataFrame:
    rows = search.with_ids(_embeddings(spark, d), spark.range(0, 300, 7), "vec_id")
    return search.exact_topk(rows, _first(spark, d), 10, "l2", "vec_id", "embedding").select("vec_id", F.round("dist", 9).alias("dist"))


_register("allowlist_topk", _allowed, f"SELECT vec_id, round({_L2}, 9) AS dist FROM ({_PAIRS}) WHERE vec_id < 300 AND vec_id % 7 = 0 ORDER BY {_L2}, vec_id LIMIT 10")


def _threshold(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of every 20th row with any row of a greater id; the whole table is joined by ``distance_join_whole``."""
    e = _embeddings(spark, d)
    left = e.where(F.col("vec_id") % 20 == 0).select(F.col("vec_id").alias("left_id"), F.col("embedding").alias("a"))
    right = e.select(F.col("vec_id").alias("right_id"), F.col("embedding").alias("b"))
    return search.within(left, right, 1.1).where("left_id < right_id").select("left_id", "right_id")


_register("distance_join", _threshold, f"SELECT l.vec_id AS left_id, r.vec_id AS right_id FROM embeddings l, embeddings r WHERE l.vec_id % 20 = 0 AND l.vec_id < r.vec_id AND {_DUCK['l2']('l.embedding', 'r.embedding')} <= 1.1")
_register("distance_join_whole", lambda spark, d: search.within_self(_embeddings(spark, d), 1.1, "l2", "vec_id", "embedding").select("left_id", "right_id"))


def _centroids(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    means = {r["label"]: list(r["avg"]) for r in aggregates.vector_avg(e.where("label IN (1, 2)"), ["label"], "embedding").collect()}
    return search.exact_topk(e, [a - b for a, b in zip(means[1], means[2], strict=True)], 10, "cosine", "vec_id", "embedding").select("vec_id")


_MEAN = "(SELECT list(v ORDER BY pos) FROM (SELECT pos, avg(x::DOUBLE)::FLOAT AS v FROM (SELECT unnest(embedding) AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings WHERE label = {k}) GROUP BY pos))"
_CP = f"SELECT e.vec_id, e.embedding AS a, q.b FROM embeddings e, (SELECT list_transform(range(1, len(m1) + 1), i -> (m1[i]::DOUBLE - m2[i]::DOUBLE)::FLOAT) AS b FROM (SELECT {_MEAN.format(k=1)} AS m1, {_MEAN.format(k=2)} AS m2)) q"
_register("centroid_difference_topk", _centroids, f"SELECT vec_id FROM ({_CP}) ORDER BY {_DUCK['cosine']('a', 'b')}, vec_id LIMIT 10")


# Fusion
def _rrf(spark: SparkSession, d: str) -> DataFrame:
    p = _paired(spark, d).withColumns({"x": expr("l2_distance(a, b)"), "y": expr("l2_distance(slice(a, 1, 32), slice(b, 1, 32))")})
    fused = hybrid.rrf_fuse([hybrid.ranked(p, c, "vec_id", k=50) for c in ("x", "y")], limit=10)
    return fused.select(F.col("id").alias("vec_id"), F.round("score", 9).alias("score"))


_NAMED = f"SELECT vec_id, {_L2} AS x, {_DUCK['l2']('a[1:32]', 'b[1:32]')} AS y FROM ({_PAIRS})"
_RANKS = " UNION ALL ".join(f"SELECT vec_id, row_number() OVER (ORDER BY {c}, vec_id) - 1 AS r FROM ({_NAMED}) QUALIFY row_number() OVER (ORDER BY {c}, vec_id) <= 50" for c in ("x", "y"))
_register("rrf_named_vectors", _rrf, f"SELECT vec_id, round(s, 9) AS score FROM (SELECT vec_id, sum(1.0::DOUBLE / (60 + r)) AS s FROM ({_RANKS}) GROUP BY vec_id) ORDER BY s DESC, vec_id LIMIT 10")


def _lexical(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    found = hybrid.term_frequency(docs, ["the", "of"])
    return found.orderBy(F.desc("tf"), "doc_id").limit(20).select("doc_id", F.col("tf").cast("long").alias("tf"))


_register("lexical_topk", _lexical, r"SELECT doc_id, tf FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), w -> w IN ('the', 'of')))::BIGINT AS tf FROM documents) WHERE tf > 0 ORDER BY tf DESC, doc_id LIMIT 20")


def _hybrid(spark: SparkSession, d: str) -> DataFrame:
    """Documents by term frequency and their vectors by distance, fused."""
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    lexical = hybrid.ranked(hybrid.term_frequency(docs, ["the", "of"]), "tf", "doc_id", ascending=False, k=50)
    dense = hybrid.ranked(search.exact_topk(_embeddings(spark, d), _first(spark, d), 50, "cosine", "vec_id", "embedding"), "dist", "vec_id", k=50)
    return hybrid.rrf_fuse([lexical, dense], limit=10).select("id", F.round("score", 9).alias("score"))


_LEX = r"SELECT doc_id AS id, row_number() OVER (ORDER BY tf DESC, doc_id) - 1 AS r FROM (SELECT doc_id, len(list_filter(regexp_split_to_array(lower(text), '\s+'), w -> w IN ('the', 'of'))) AS tf FROM documents) WHERE tf > 0 QUALIFY row_number() OVER (ORDER BY tf DESC, doc_id) <= 50"
_DEN = f"SELECT vec_id AS id, row_number() OVER (ORDER BY {_DUCK['cosine']('a', 'b')}, vec_id) - 1 AS r FROM ({_PAIRS}) QUALIFY row_number() OVER (ORDER BY {_DUCK['cosine']('a', 'b')}, vec_id) <= 50"
_register("hybrid_rrf", _hybrid, f"SELECT id, round(s, 9) AS score FROM (SELECT id, sum(1.0::DOUBLE / (60 + r)) AS s FROM (({_LEX}) UNION ALL ({_DEN})) GROUP BY id) ORDER BY s DESC, id LIMIT 10")


def _joined_back(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "lang", "source")
    return hybrid.joined_back(_hybrid(spark, d), docs, "doc_id")


_register("rrf_joined_documents", _joined_back, f"SELECT d.doc_id, lang, source, score FROM ({SQL['hybrid_rrf']}) f JOIN documents d ON d.doc_id = f.id")


def _bm25(spark: SparkSession, d: str) -> DataFrame:
    docs = spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text")
    found = hybrid.bm25(docs, ["the", "of"], "doc_id")
    return found.withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "id").limit(20)


_BM = r"SELECT doc_id, len(w) AS n, len(list_filter(w, x -> x = 'the')) AS t0, len(list_filter(w, x -> x = 'of')) AS t1 FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '\s+'), w -> w <> '') AS w FROM documents)"
_BMS = f"SELECT count(*) AS rows, avg(n) AS mean, count(*) FILTER (t0 > 0) AS d0, count(*) FILTER (t1 > 0) AS d1 FROM ({_BM})"
_BMT = " + ".join(f"ln(1 + (rows - d{i} + 0.5) / (d{i} + 0.5)) * t{i} * 2.2::DOUBLE / (t{i} + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * n / mean))" for i in (0, 1))
_register("bm25_topk", _bm25, f"SELECT id, score FROM (SELECT doc_id AS id, round({_BMT}, 6) AS score FROM ({_BM}), ({_BMS}) WHERE t0 + t1 > 0) ORDER BY score DESC, id LIMIT 20")


def _maxsim_rank(spark: SparkSession, d: str) -> DataFrame:
    docs = _embeddings(spark, d).select("vec_id", F.expr(_tokens("embedding")).alias("tokens"))
    q = _first(spark, d, 5)
    found = hybrid.colbert_search(docs, [q[8 * i : 8 * i + 8] for i in range(8)], 10, id_col="vec_id", exhaustive=True)
    return found.select(F.col("id").alias("vec_id"), F.round("score", 6).alias("score"))


_UNIT = f"list_transform({_DT.format(v='b')}, q -> list_transform(q, x -> (x * (1 / sqrt({_ip('q', 'q')}))::FLOAT)::FLOAT))"
_MS = f"list_sum(list_transform({_UNIT}, q -> list_max(list_transform({_DT.format(v='a')}, d -> {_ip('q', 'd')}))))"
_P5 = _PAIRS.replace("WHERE vec_id = 0", "WHERE vec_id = 5")
_register("colbert_exhaustive", _maxsim_rank, f"SELECT vec_id, round(s, 6) AS score FROM (SELECT vec_id, {_MS} AS s FROM ({_P5})) ORDER BY s DESC, vec_id LIMIT 10")


# Indexes: with every cell probed and every row a candidate, exact re-ranking gives the exact answer
def _indexed(name: str, spec: IndexSpec, change: str | None = None, sql_filter: str = "true") -> None:
    def query(spark: SparkSession, d: str) -> DataFrame:
        e = _embeddings(spark, d)
        start = e.where("vec_id % 5 <> 0") if change == "insert" else e
        index = build_index(start, new_path(spark, name), spec, "vec_id", "embedding")
        if change == "insert":
            index = index.insert(e.where("vec_id % 5 = 0"), "vec_id", "embedding")
        if change == "delete":
            index = index.delete(e.where("vec_id % 5 = 0").select("vec_id"))
        top = index.search(e, _first(spark, d), 10, id_col="vec_id", vector_col="embedding", exhaustive=True)
        return top.select("vec_id", F.expr(_rounded("dist", 9)).alias("dist"))

    dist = _DUCK[spec.metric]("a", "b")
    _register(name, query, f"SELECT vec_id, round({dist}, 9) AS dist FROM ({_PAIRS}) WHERE {sql_filter} ORDER BY {dist}, vec_id LIMIT 10")


_indexed("ann_flat_exact", IndexSpec("flat", "l2"))
_indexed("ann_flat_2bit_exact", IndexSpec("flat", "l1", bit_width=2))
_indexed("ann_ivf_all_probes", IndexSpec("ivf", "cosine", lists=16))
_indexed("ann_ivf_soft_dedup", IndexSpec("ivf", "ip", lists=16, assign_dups=3))
_indexed("ann_graph_exact", IndexSpec("graph", "cosine"))
_indexed("ann_after_insert", IndexSpec("ivf", "l2", lists=16), "insert")
_indexed("ann_after_delete", IndexSpec("flat", "l2"), "delete", "vec_id % 5 <> 0")


def _knn_join(spark: SparkSession, d: str) -> DataFrame:
    e = _embeddings(spark, d)
    near = search.knn(e, _first(spark, d), 20, 4, id_col="vec_id", vector_col="embedding")
    return near.join(e.select(F.col("vec_id").alias("id"), "label"), "id").select("id", "label", "score")


_register("knn_join_back", _knn_join)


#: Indexes at usable settings, whose recall is reported.
RECALL_SPECS = {
    "flat_4": IndexSpec("flat", "cosine"),
    "flat_3": IndexSpec("flat", "cosine", bit_width=3),
    "flat_2": IndexSpec("flat", "cosine", bit_width=2),
    "ivf": IndexSpec("ivf", "cosine", lists=32, assign_dups=2),
    "graph": IndexSpec("graph", "cosine"),
}


def _asked(e: DataFrame) -> DataFrame:
    return e.where("vec_id % 20 = 0").select(F.col("vec_id").alias("qid"), F.col("embedding").alias("query"))


def _recall(spark: SparkSession, d: str) -> DataFrame:
    """Recall of the 10 nearest of every 20th row, itself excluded, by each index at its default settings."""
    e = _embeddings(spark, d)
    truth = search.batch_topk(e, _asked(e), 10, "cosine", "vec_id", "embedding", exclude_self=True).select("qid", "id").cache()
    report = None
    for name, spec in RECALL_SPECS.items():
        index = build_index(e, new_path(spark, f"recall_{name}"), spec, "vec_id", "embedding")
        found = index.batch_search(e, _asked(e), 10, id_col="vec_id", vector_col="embedding", exclude_self=True)
        hits = hybrid.recall_at_k(found, truth)
        one = hits.agg(F.lit(name).alias("index"), F.count("*").alias("queries"), F.avg("recall").alias("recall"), F.percentile("recall", F.lit(0.1)).alias("p10"), F.percentile("recall", F.lit(0.5)).alias("p50"))
        report = one if report is None else report.union(one)
    return report


_register("recall_report", _recall)


def _ndcg(spark: SparkSession, d: str) -> DataFrame:
    """nDCG of the exact order by cosine, where rows of the query's label have gain one, over every 20th row."""
    e = _embeddings(spark, d)
    found = search.batch_topk(e, _asked(e), 10, "cosine", "vec_id", "embedding", exclude_self=True)
    labels = e.select(F.col("vec_id").alias("id"), "label")
    gains = found.join(labels, "id").join(e.select(F.col("vec_id").alias("qid"), F.col("label").alias("own")), "qid")
    gains = gains.select("qid", "id", (F.col("label") == F.col("own")).cast("double").alias("gain"))
    return hybrid.ndcg_at_k(found, gains).select("qid", F.round("ndcg", 9).alias("ndcg"))


_NEAR = f"SELECT q.vec_id AS qid, (e.label = q.label)::INTEGER AS gain, row_number() OVER (PARTITION BY q.vec_id ORDER BY {_COSQ}, e.vec_id) AS r FROM embeddings q JOIN embeddings e ON e.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0 QUALIFY r <= 10"
_register(
    "ndcg_by_label",
    _ndcg,
    f"SELECT qid, round(CASE WHEN sum(gain) = 0 THEN 0 ELSE sum(gain / log2(r + 1)) / sum(CASE WHEN best <= total THEN 1 / log2(best + 1) ELSE 0 END) END, 9) AS ndcg FROM (SELECT *, r AS best, sum(gain) OVER (PARTITION BY qid) AS total FROM ({_NEAR})) GROUP BY qid",
)


def oracle_sql() -> dict[str, str]:
    """The DuckDB statements; lambdas are written with arrows above and spelled out here."""
    return {name: re.sub(r"\b([a-z]) -> ", r"lambda \1: ", sql) for name, sql in SQL.items()}
