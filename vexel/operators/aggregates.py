"""Element-wise aggregates of vector columns, as partial and final sums by position."""

from __future__ import annotations

from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.functions import call


def rollup_sets(keys: list[str]) -> list[list[str]]:
    """The grouping sets of ``ROLLUP``: the keys, without the last, and so on to none."""
    return [keys[:n] for n in range(len(keys), -1, -1)]


def cube_sets(keys: list[str]) -> list[list[str]]:
    """The grouping sets of ``CUBE``: all subsets of the keys."""
    return [list(s) for n in range(len(keys), -1, -1) for s in combinations(keys, n)]


def _reduce(df: DataFrame, keys: list[str], vector: str, out: str, final, sets: list[list[str]] | None = None, distinct: bool = False) -> DataFrame:
    """Sum by key and position, map-side first; then each key's few positions are put in order.

    A key whose vectors differ in dimension raises, a key with only nulls gets null. Grouping
    sets are worked out from the sums by all keys, so the input is read once; a column
    ``grouping_id`` tells them apart as SQL's does. With ``distinct``, equal vectors of a key (of
    each grouping set) count once.
    """
    if sets is not None and distinct:
        parts = [_reduce(df, of, vector, out, final, None, True).withColumns({k: F.lit(None).cast(df.schema[k].dataType) for k in keys if k not in of}) for of in sets]
        parts = [p.select(*keys, F.lit(_grouping_id(keys, of)).alias("grouping_id"), out) for p, of in zip(parts, sets, strict=True)]
        return reduce(DataFrame.union, parts)
    df = df.select(*keys, vector).distinct() if distinct else df
    spread = df.select(*keys, F.posexplode_outer(vector).alias("_pos", "_x"))
    sums = spread.groupBy(*keys, "_pos").agg(F.sum(F.col("_x").cast("double")).alias("_s"), F.count("*").alias("_n"))
    by = list(keys)
    if sets is not None:
        rows = F.explode(F.array(*[F.struct(*[(F.col(k) if k in of else F.lit(None).cast(df.schema[k].dataType)).alias(k) for k in keys], F.lit(_grouping_id(keys, of)).alias("grouping_id")) for of in sets]))
        by = [*keys, "grouping_id"]
        sums = sums.select(rows.alias("_g"), "_pos", "_s", "_n").groupBy(*[F.col("_g")[k].alias(k) for k in by], "_pos").agg(F.sum("_s").alias("_s"), F.sum("_n").alias("_n"))
    gathered = sums.groupBy(*by).agg(F.array_sort(F.collect_list(F.when(F.col("_pos").isNotNull(), F.struct("_pos", "_s", "_n")))).alias("_all"))
    uneven = F.size(F.array_distinct(F.transform("_all", lambda z: z["_n"]))) > 1
    value = F.transform("_all", final)
    checked = F.when(uneven, F.raise_error(F.lit("vectors of one group differ in dimension"))).when(F.size("_all") > 0, value)
    return gathered.select(*by, checked.alias(out))


def _grouping_id(keys: list[str], of: list[str]) -> int:
    """A bit for each key, the first highest: one where the key is summed over."""
    return sum(1 << (len(keys) - 1 - i) for i, k in enumerate(keys) if k not in of)


def vector_sum(df: DataFrame, keys: list[str], vector: str, out: str = "sum", sets: list[list[str]] | None = None, distinct: bool = False) -> DataFrame:
    """``sum(vector)``: double sums narrowed to float; null rows are skipped. ``sets`` and ``distinct`` as in SQL."""
    return _reduce(df, keys, vector, out, lambda z: z["_s"].cast("float"), sets, distinct)


def vector_avg(df: DataFrame, keys: list[str], vector: str, out: str = "avg", sets: list[list[str]] | None = None, distinct: bool = False) -> DataFrame:
    """``avg(vector)``: double sums over the count, narrowed to float; null rows are skipped. ``sets`` and ``distinct`` as in SQL."""
    return _reduce(df, keys, vector, out, lambda z: (z["_s"] / z["_n"]).cast("float"), sets, distinct)


def halfvec_sum(df: DataFrame, keys: list[str], vector: str, out: str = "sum") -> DataFrame:
    """``sum(halfvec)``: as :func:`vector_sum`, rounded to half precision; out of range raises."""
    return _half(vector_sum(df, keys, vector, out), out)


def halfvec_avg(df: DataFrame, keys: list[str], vector: str, out: str = "avg") -> DataFrame:
    """``avg(halfvec)``."""
    return _half(vector_avg(df, keys, vector, out), out)


def _half(df: DataFrame, out: str) -> DataFrame:
    return df.withColumn(out, call("vector_to_halfvec", out))


def sparsevec_sum(df: DataFrame, keys: list[str], vector: str, out: str = "sum") -> DataFrame:
    """``sum(sparsevec)``: stays sparse; entries that cancel are dropped, differing dimensions raise."""
    entries: Column = F.when(F.size(f"{vector}.indices") > 0, F.arrays_zip(F.col(f"{vector}.indices").alias("i"), F.col(f"{vector}.values").alias("x")))
    spread = df.where(F.col(vector).isNotNull()).select(*keys, F.col(f"{vector}.dim").alias("_dim"), F.explode_outer(entries).alias("_e"))
    sums = spread.groupBy(*keys, F.col("_e.i").alias("_i")).agg(F.sum(F.col("_e.x").cast("double")).cast("float").alias("_s"), F.min("_dim").alias("_lo"), F.max("_dim").alias("_hi"))
    kept = F.when(F.col("_i").isNotNull() & (F.col("_s") != 0), F.struct("_i", "_s"))
    found = sums.groupBy(*keys).agg(F.array_sort(F.collect_list(kept)).alias("_all"), F.min("_lo").alias("_lo"), F.max("_hi").alias("_hi"))
    value = F.struct(F.col("_lo").alias("dim"), F.transform("_all", lambda z: z["_i"]).alias("indices"), F.transform("_all", lambda z: z["_s"]).alias("values"))
    return found.select(*keys, F.when(F.col("_lo") != F.col("_hi"), F.raise_error(F.lit("vectors of one group differ in dimension"))).otherwise(value).alias(out))
