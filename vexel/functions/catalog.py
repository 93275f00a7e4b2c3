"""The one definition of every scalar function: a SQL body, registered as a temporary function.

Bodies are inlined by the analyzer, so a call is plain Catalyst expressions over arrays and
structs: filters and projections push through it and nothing leaves the JVM. The same body
serves SQL text and, by :func:`call`, the DataFrame API.

Types: ``vector`` is ``ARRAY<FLOAT>``; ``halfvec`` the same with values rounded to half precision;
``sparsevec`` is ``STRUCT<dim INT, indices ARRAY<INT>, values ARRAY<FLOAT>>`` with 0-based
ascending indices; ``bitvec`` is ``STRUCT<n_bits INT, words ARRAY<BIGINT>>``, 64 bits a word, the
first bit highest, a last word with fewer bits right-aligned.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from vexel import __version__

VECTOR = "ARRAY<FLOAT>"
SPARSE = "STRUCT<dim: INT, indices: ARRAY<INT>, values: ARRAY<FLOAT>>"
BITS = "STRUCT<n_bits: INT, words: ARRAY<BIGINT>>"
MAX_DIM, MAX_SPARSE_DIM, MAX_BITS, MAX_HALF = 16_000, 1_000_000_000, 64_000, 65504


@dataclass(frozen=True)
class Function:
    name: str
    parameters: str
    returns: str
    body: str
    deterministic: bool = True

    def ddl(self) -> str:
        kind = "" if self.deterministic else " NOT DETERMINISTIC"
        return f"CREATE OR REPLACE TEMPORARY FUNCTION {self.name}({self.parameters}) RETURNS {self.returns}{kind} RETURN {self.body}"


FUNCTIONS: dict[str, Function] = {}
_AB = f"a {VECTOR}, b {VECTOR}"


def _add(name: str, parameters: str, returns: str, body: str, deterministic: bool = True) -> None:
    FUNCTIONS[name] = Function(name, parameters, returns, " ".join(body.split()), deterministic)


def _raise(message: str) -> str:
    return f"raise_error({message})"


def _same_dim(body: str, a: str = "size(a)", b: str = "size(b)") -> str:
    return f"CASE WHEN {a} <> {b} THEN {_raise(f'''concat('different dimensions: ', {a}, ' and ', {b})''')} ELSE {body} END"


def _fold(pair: str, a: str = "a", b: str = "b") -> str:
    """Sum of a double expression of ``x`` and ``y`` over two arrays, in the order of the elements."""
    return f"aggregate(zip_with({a}, {b}, (x, y) -> {pair}), 0D, (s, v) -> s + v)"


_DOT, _SQ = "cast(x AS DOUBLE) * cast(y AS DOUBLE)", "(cast(x AS DOUBLE) - cast(y AS DOUBLE)) * (cast(x AS DOUBLE) - cast(y AS DOUBLE))"
_ABS = "abs(cast(x AS DOUBLE) - cast(y AS DOUBLE))"


def _cosine(dot: str, aa: str, bb: str) -> str:
    return f"CASE WHEN {aa} = 0 OR {bb} = 0 THEN double('NaN') ELSE 1 - greatest(-1D, least(1D, {dot} / (sqrt({aa}) * sqrt({bb})))) END"


def _finite(array: str, what: str) -> str:
    """The array itself, if all elements are finite and none is null."""
    return f"CASE WHEN exists({array}, x -> x IS NULL OR isnan(x) OR abs(x) = double('Infinity')) THEN {_raise(f'''concat('{what}: ', 'null or non-finite element')''')} ELSE {array} END"


def _checked_dim(array: str, low: int = 1) -> str:
    return f"CASE WHEN size({array}) < {low} OR size({array}) > {MAX_DIM} THEN {_raise(f'''concat('dimension out of range: ', size({array}))''')} ELSE {array} END"


# Distances
for _p in ("", "halfvec_"):
    _add(f"{_p}l2_distance", _AB, "DOUBLE", _same_dim(f"sqrt({_fold(_SQ)})"))
    _add(f"{_p}l2_squared_distance", _AB, "DOUBLE", _same_dim(_fold(_SQ)))
    _add(f"{_p}inner_product", _AB, "DOUBLE", _same_dim(_fold(_DOT)))
    _add(f"{_p}negative_inner_product", _AB, "DOUBLE", _same_dim(f"-{_fold(_DOT)}"))
    _add(f"{_p}cosine_distance", _AB, "DOUBLE", _same_dim(_cosine(_fold(_DOT), _fold(_DOT, "a", "a"), _fold(_DOT, "b", "b"))))
    _add(f"{_p}l1_distance", _AB, "DOUBLE", _same_dim(_fold(_ABS)))

# Shape and norm
for _n in ("vector_dims", "halfvec_dims"):
    _add(_n, f"v {VECTOR}", "INT", "size(v)")
for _n in ("vector_norm", "halfvec_norm"):
    _add(_n, f"v {VECTOR}", "DOUBLE", f"sqrt({_fold(_DOT, 'v', 'v')})")
_NORM = _fold(_DOT, "v", "v")
# The reciprocal is computed once, not for every element.
for _n in ("vec_normalize", "l2_normalize"):
    _add(
        _n,
        f"v {VECTOR}",
        VECTOR,
        f"aggregate(array({_NORM}), cast(null AS {VECTOR}), (s, n) -> CASE WHEN n = 0 THEN v ELSE zip_with(v, array_repeat(cast(1 / sqrt(n) AS FLOAT), size(v)), (x, r) -> x * r) END)",
    )

# Half precision: round to 11 significant bits, ties to even, by adding and taking away a number
# whose last place is the wanted one. The exponent from log2 is put right where it is one off.
_EXP = "floor(log2(abs(cast(x AS DOUBLE))))"
_ADJ = f"({_EXP} + CASE WHEN pow(2D, {_EXP}) > abs(cast(x AS DOUBLE)) THEN -1 WHEN pow(2D, {_EXP} + 1) <= abs(cast(x AS DOUBLE)) THEN 1 ELSE 0 END)"
#: Half of the least half-precision number: up to here the result is zero, of the number's own sign.
_TINY = "2.98023223876953125E-8D"
_MAGIC = f"(1.5D * pow(2D, greatest(-14, {_ADJ}) + 42))"
_add(
    "to_half",
    "x FLOAT",
    "FLOAT",
    f"CASE WHEN x IS NULL OR isnan(x) OR abs(x) = double('Infinity') THEN {_raise(repr('halfvec: null or non-finite element'))} WHEN abs(cast(x AS DOUBLE)) <= {_TINY} THEN x * cast(0 AS FLOAT) "
    f"WHEN abs(cast(x AS DOUBLE)) >= 65520 THEN {_raise(f'''concat('halfvec: out of range: ', x)''')} ELSE cast((cast(x AS DOUBLE) + {_MAGIC}) - {_MAGIC} AS FLOAT) END",
)
_HALVES = FUNCTIONS["to_half"].body


def _halved(array: str) -> str:
    return f"transform({array}, x -> {_HALVES})"


# Arithmetic
for _n, _o in (("add", "+"), ("sub", "-"), ("mul", "*")):
    _add(f"vec_{_n}", _AB, VECTOR, _same_dim(_finite(f"zip_with(a, b, (x, y) -> x {_o} y)", f"vec_{_n}")))
    _add(f"halfvec_{_n}", _AB, VECTOR, _same_dim(_halved(f"zip_with(a, b, (x, y) -> x {_o} y)")))
for _n in ("vector_concat", "halfvec_concat"):
    _add(_n, _AB, VECTOR, _checked_dim("concat(a, b)"))
_add("halfvec_l2_normalize", f"v {VECTOR}", VECTOR, _halved(FUNCTIONS["vec_normalize"].body))
_add(
    "subvector",
    f"v {VECTOR}, start INT, length INT",
    VECTOR,
    f"CASE WHEN start < 1 OR length < 1 OR start + length - 1 > size(v) THEN {_raise(f'''concat('subvector out of range: ', start, ', ', length)''')} ELSE slice(v, start, length) END",
)
_add("vec_zeros", "dim INT", VECTOR, f"CASE WHEN dim < 1 OR dim > {MAX_DIM} THEN {_raise('''concat('dimension out of range: ', dim)''')} ELSE array_repeat(cast(0 AS FLOAT), dim) END")
_add("vec_check_dim", f"v {VECTOR}, expected INT", VECTOR, f"CASE WHEN size(v) <> expected THEN {_raise('''concat('expected dimension ', expected, ', got ', size(v))''')} ELSE v END")
_add(
    "vec_random_unit",
    "dim INT",
    VECTOR,
    "aggregate(array(transform(sequence(1, dim), i -> cast(2 * rand() - 1 AS FLOAT))), cast(null AS ARRAY<FLOAT>), (s, v) -> " + FUNCTIONS["vec_normalize"].body.replace("(s, n)", "(s2, n)").replace("(s, v)", "(s3, w)").replace("s + v", "s3 + w") + ")",
    deterministic=False,
)

# Conversions
_ARRAY = _checked_dim(_finite("a", "array_to_vec"))
#: What SQL may add to a conversion: a dimension to hold to (0: any), and a flag that changes nothing.
_MORE = "dim INT DEFAULT 0, transpose BOOLEAN DEFAULT false"
_add("float8_array_to_vec", "a ARRAY<DOUBLE>", VECTOR, _checked_dim(_finite("transform(a, v -> cast(v AS FLOAT))", "float8_array_to_vec")))
_add("int4_array_to_vec", "a ARRAY<INT>", VECTOR, _checked_dim(_finite("transform(a, v -> cast(v AS FLOAT))", "int4_array_to_vec")))
_add("vec_to_array", f"v {VECTOR}", VECTOR, "v")


def _with_dim(array: str) -> str:
    return f"CASE WHEN dim <> 0 AND size({array}) <> dim THEN {_raise(f'''concat('expected dimension ', dim, ', got ', size({array}))''')} ELSE {array} END"


_add("vector_to_float4", f"v {VECTOR}, {_MORE}", VECTOR, _with_dim("v"))
for _n in ("array_to_vec", "array_to_vec_dim", "array_to_vector"):
    _add(_n, f"a {VECTOR}, {_MORE}", VECTOR, _with_dim(_ARRAY))
_NUMBER = r"[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
_LIST = rf"^\\s*\\[\\s*{_NUMBER}\\s*(,\\s*{_NUMBER}\\s*)*\\]\\s*$"
_PARSED = r"transform(split(regexp_replace(s, '[\\[\\]\\s]', ''), ','), t -> cast(cast(t AS DOUBLE) AS FLOAT))"
_TEXT = f"CASE WHEN NOT s RLIKE '{_LIST}' THEN {_raise('''concat('not a vector: ', s)''')} ELSE {_checked_dim(_finite(_PARSED, 'vector text'))} END"
for _n in ("to_vec", "to_vector", "to_vec_dim", "to_vector_dim"):
    _add(_n, f"s STRING, {_MORE}", VECTOR, _with_dim(_TEXT))
# Shortest digits without an exponent: digits and exponent of Spark's own form, laid out again.
_DIGITS = "replace(regexp_replace(split(t, 'E')[0], '[.]0$', ''), '.', '')"
_POINT = "cast(split(t, 'E')[1] AS INT)"
_SHORT = (
    "transform(transform({v}, x -> struct(cast(abs(x) AS STRING) AS t, (x < 0 OR cast(x AS STRING) = '-0.0') AS m)), z -> concat(if(z.m, '-', ''), CASE WHEN instr(z.t, 'E') = 0 THEN regexp_replace(z.t, '[.]0$', '') "
    f"WHEN {_POINT} < 0 THEN concat('0.', repeat('0', -{_POINT} - 1), {_DIGITS}) "
    f"WHEN length({_DIGITS}) - 1 <= {_POINT} THEN rpad({_DIGITS}, {_POINT} + 1, '0') "
    f"ELSE concat(substring({_DIGITS}, 1, {_POINT} + 1), '.', substring({_DIGITS}, {_POINT} + 2)) END))"
).replace("(t, 'E')", "(z.t, 'E')")
for _n in ("vec_to_text", "halfvec_to_text"):
    _add(_n, f"v {VECTOR}", "STRING", f"concat('[', concat_ws(', ', {_SHORT.format(v='v')}), ']')")
    FUNCTIONS[_n] = Function(_n, f"v {VECTOR}", "STRING", f"CASE WHEN v IS NULL THEN NULL ELSE {FUNCTIONS[_n].body} END")
_add("vec_to_jsonb", f"v {VECTOR}", "STRING", "to_json(transform(v, x -> cast(x AS DOUBLE)))")
_JSON = r"^\\s*\\[\\s*-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?\\s*(,\\s*-?[0-9]+([.][0-9]+)?([eE][+-]?[0-9]+)?\\s*)*\\]\\s*$"
_add("jsonb_to_vec", "s STRING", VECTOR, f"CASE WHEN NOT s RLIKE '{_JSON}' THEN {_raise('''concat('not a JSON array of numbers: ', s)''')} ELSE {_checked_dim(_finite(_PARSED, 'jsonb_to_vec'))} END")
for _n in ("vector_to_halfvec", "array_to_halfvec"):
    _add(_n, f"a {VECTOR}", VECTOR, _checked_dim(_halved("a")))
for _n in ("halfvec_to_vector", "halfvec_to_array"):
    _add(_n, f"v {VECTOR}", VECTOR, "v")
_add("to_halfvec", "s STRING", VECTOR, _halved(_TEXT))

# Sparse vectors
_SAB = f"a {SPARSE}, b {SPARSE}"


def _at(of: str) -> str:
    """Value of sparse ``of`` at index ``i``, 0 where it has none."""
    return f"coalesce(element_at(map_from_arrays({of}.indices, {of}.values), i), cast(0 AS FLOAT))"


def _union(pair: str) -> str:
    """Sum over the union of the indices, ascending; x and y are the values there."""
    ax = f"transform(u, i -> {_at('a')})"
    by = f"transform(u, i -> {_at('b')})"
    return f"aggregate(array(array_sort(array_union(a.indices, b.indices))), 0D, (t, u) -> {_fold(pair, ax, by)})"


def _sparse(body: str) -> str:
    return _same_dim(body, "a.dim", "b.dim")


_SELF = "aggregate({v}.values, 0D, (s, x) -> s + cast(x AS DOUBLE) * cast(x AS DOUBLE))"
_add("sparsevec_inner_product", _SAB, "DOUBLE", _sparse(_union(_DOT)))
_add("sparsevec_negative_inner_product", _SAB, "DOUBLE", _sparse(f"-{_union(_DOT)}"))
_add("sparsevec_l2_squared_distance", _SAB, "DOUBLE", _sparse(_union(_SQ)))
_add("sparsevec_l2_distance", _SAB, "DOUBLE", _sparse(f"sqrt({_union(_SQ)})"))
_add("sparsevec_l1_distance", _SAB, "DOUBLE", _sparse(_union(_ABS)))
_add("sparsevec_cosine_distance", _SAB, "DOUBLE", _sparse(_cosine(_union(_DOT), _SELF.format(v="a"), _SELF.format(v="b"))))
_add("sparsevec_norm", f"v {SPARSE}", "DOUBLE", f"sqrt({_SELF.format(v='v')})")
_add("sparsevec_dims", f"v {SPARSE}", "INT", "v.dim")
_add("sparsevec_nnz", f"v {SPARSE}", "INT", "size(v.indices)")
_add(
    "vector_to_sparsevec",
    f"v {VECTOR}",
    SPARSE,
    "CASE WHEN v IS NULL THEN NULL ELSE named_struct('dim', size(v), 'indices', transform(filter(transform(v, (x, i) -> struct(x AS x, i AS i)), z -> z.x <> 0), z -> z.i), 'values', filter(v, x -> x <> 0)) END",
)
_add(
    "sparsevec_to_vector",
    f"v {SPARSE}",
    VECTOR,
    f"CASE WHEN v.dim > {MAX_DIM} THEN {_raise('''concat('dimension out of range: ', v.dim)''')} ELSE transform(sequence(0, v.dim - 1), i -> {_at('v')}) END",
)
_ENTRY = r"[0-9]+:[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?"
_IDX = r"transform(regexp_extract_all(s, '([0-9]+):', 1), t -> cast(t AS INT) - 1)"
_VAL = r"transform(regexp_extract_all(s, ':([^,}]+)', 1), t -> cast(cast(t AS DOUBLE) AS FLOAT))"
_SDIM = r"cast(regexp_extract(s, '/([0-9]+)', 1) AS INT)"
_add(
    "to_sparsevec",
    "s STRING",
    SPARSE,
    rf"CASE WHEN NOT s RLIKE '^\\{{({_ENTRY}(,{_ENTRY})*)?\\}}/[0-9]+$' THEN {_raise('''concat('not a sparse vector: ', s)''')} "
    f"WHEN {_SDIM} < 1 OR {_SDIM} > {MAX_SPARSE_DIM} OR exists({_IDX}, i -> i < 0 OR i >= {_SDIM}) OR {_IDX} <> array_sort(array_distinct({_IDX})) THEN {_raise('''concat('indices must ascend within the dimension: ', s)''')} "
    f"ELSE named_struct('dim', {_SDIM}, 'indices', {_IDX}, 'values', {_finite(_VAL, 'sparsevec text')}) END",
)
_add(
    "sparsevec_to_text",
    f"v {SPARSE}",
    "STRING",
    f"concat('{{', concat_ws(',', zip_with(v.indices, {_SHORT.replace('{v}', 'v.values')}, (i, x) -> concat(i + 1, ':', x))), '}}/', v.dim)",
)

# Bit vectors
_BAB = f"a {BITS}, b {BITS}"


def _bits(op: str) -> str:
    return f"aggregate(zip_with(a.words, b.words, (x, y) -> cast(bit_count(x {op} y) AS BIGINT)), 0L, (s, v) -> s + v)"


def _same_bits(body: str) -> str:
    return _same_dim(body, "a.n_bits", "b.n_bits")


_add("hamming_distance", _BAB, "DOUBLE", _same_bits(f"cast({_bits('^')} AS DOUBLE)"))
_add("jaccard_distance", _BAB, "DOUBLE", _same_bits(f"CASE WHEN {_bits('|')} = 0 THEN 0D ELSE 1 - cast({_bits('&')} AS DOUBLE) / {_bits('|')} END"))
_add("bitvec_dims", f"v {BITS}", "INT", "v.n_bits")
_add("bitvec_popcount", f"v {BITS}", "BIGINT", "aggregate(v.words, 0L, (s, x) -> s + bit_count(x))")


def _packed(flags: str, n: str) -> str:
    """Words of an array of booleans."""
    return f"transform(sequence(0, cast(({n} - 1) DIV 64 AS INT)), w -> aggregate(slice({flags}, w * 64 + 1, 64), 0L, (s, x) -> shiftleft(s, 1) | if(x, 1L, 0L)))"


_add("binary_quantize", f"v {VECTOR}", BITS, f"CASE WHEN v IS NULL THEN NULL ELSE named_struct('n_bits', size(v), 'words', {_packed('transform(v, x -> x > 0)', 'size(v)')}) END")
_FLAGS = "transform(split(s, ''), c -> c = '1')"
_add(
    "to_bitvec",
    "s STRING",
    BITS,
    f"CASE WHEN NOT s RLIKE '^[01]+$' OR length(s) > {MAX_BITS} THEN {_raise('''concat('not a bit vector: ', s)''')} ELSE named_struct('n_bits', length(s), 'words', {_packed(_FLAGS, 'length(s)')}) END",
)
_add(
    "bitvec_to_text",
    f"v {BITS}",
    "STRING",
    "concat_ws('', transform(v.words, (x, i) -> substring(lpad(bin(x), 64, '0'), 1 + 64 - least(64, v.n_bits - 64 * i))))",
)
FUNCTIONS["bitvec_to_text"] = Function("bitvec_to_text", f"v {BITS}", "STRING", f"CASE WHEN v IS NULL THEN NULL ELSE {FUNCTIONS['bitvec_to_text'].body} END")

# Late interaction and fusion
_TOKENS = "ARRAY<ARRAY<FLOAT>>"
_UNIFORM = "size(array_distinct(transform(concat(query, doc), t -> size(t)))) > 1"


def _max_sim(pair: str) -> str:
    # NaN never wins a maximum; no finite pair leaves minus infinity.
    best = f"coalesce(array_max(filter(transform(doc, d -> {pair}), z -> NOT isnan(z))), double('-Infinity'))"
    return (
        f"CASE WHEN size(query) = 0 OR size(doc) = 0 THEN 0D WHEN {_UNIFORM} THEN {_raise(repr('token dimensions differ'))} "
        f"ELSE aggregate(transform(query, q -> {best}), 0D, (s, v) -> s + v) END"
    )


_QD = _fold(_DOT, "q", "d")
_add("max_sim", f"query {_TOKENS}, doc {_TOKENS}", "DOUBLE", _max_sim(_QD))
_add("max_sim_cosine", f"query {_TOKENS}, doc {_TOKENS}", "DOUBLE", _max_sim(f"(1 - ({_cosine(_QD, _fold(_DOT, 'q', 'q'), _fold(_DOT, 'd', 'd'))}))"))
_add("rrf_score", "rank INT, k INT DEFAULT 60", "DOUBLE", f"CASE WHEN cast(rank AS BIGINT) + k <= 0 THEN {_raise('''concat('rank + k must be positive: ', cast(rank AS BIGINT) + k)''')} ELSE 1D / (cast(rank AS BIGINT) + k) END")
_add("vexel_version", "", "STRING", f"'{__version__}'")

#: Names of the functions that each session knows, by the session's own id.
_registered: dict[str, set[str]] = {}


def register(spark: SparkSession) -> None:
    """Make every function callable from SQL in this session."""
    ensure_registered(*FUNCTIONS, spark=spark)


def ensure_registered(*names: str, spark: SparkSession | None = None) -> None:
    """Register the named functions in a session (the active one), those that it doesn't know yet."""
    spark = spark or SparkSession.active()
    known = _registered.setdefault(spark._jsparkSession.sessionUUID(), set())
    for n in names:
        if n not in known:
            spark.sql(FUNCTIONS[n].ddl())
            known.add(n)


def expr(text: str) -> Column:
    """``F.expr`` of a text that may name any of :data:`FUNCTIONS`, registering those that it does."""
    ensure_registered(*{n.lower() for n in re.findall(r"\w+(?=\s*\()", text)} & FUNCTIONS.keys())
    return F.expr(text)


def call(name: str, *args: Column | str) -> Column:
    """A function of :data:`FUNCTIONS` applied to columns, registering it if need be."""
    ensure_registered(name)
    return F.call_function(name, *[F.col(a) if isinstance(a, str) else a for a in args])
