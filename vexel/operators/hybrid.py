"""Rank fusion, lexical ranking and late-interaction search."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from vexel.functions import call, vector
from vexel.operators.search import knn_many


def ranked(df: DataFrame, by: str, id_col: str = "id", ascending: bool = True, k: int = 1000) -> DataFrame:
    """The first ``k`` rows of an order as ``(id, rank)``, 0-based; ties by id.

    Limited first, so that the numbering sees ``k`` rows, not the input.
    """
    order = [F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last(), F.col(id_col)]
    top = df.orderBy(*order).limit(k)
    return top.select(F.col(id_col).alias("id"), (F.row_number().over(Window.orderBy(*order)) - 1).alias("rank"))


def rrf_fuse(rankings: Sequence[DataFrame], k: int = 60, limit: int = 10) -> DataFrame:
    """Reciprocal-rank fusion of rankings ``(id, rank)``: ``(id, score)``, best first, ties by id."""
    all_ranks = rankings[0]
    for r in rankings[1:]:
        all_ranks = all_ranks.unionByName(r)
    fused = all_ranks.groupBy("id").agg(F.sum(call("rrf_score", F.col("rank"), F.lit(k))).alias("score"))
    return fused.orderBy(F.desc("score"), "id").limit(limit)


def bm25(df: DataFrame, terms: Sequence[str], id_col: str = "id", text_col: str = "text", k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """``(id, score)`` of the rows that hold any of the terms, weighted by rarity and length (BM25).

    Words are those of white space in lower case; rarity and mean length are over all rows of
    ``df``, in one small aggregate. Rows without text hold no term; an empty input gives no rows.
    """
    wanted = list(dict.fromkeys(t.lower() for t in terms))
    words = F.filter(F.split(F.lower(text_col), r"\s+"), lambda w: w != "")

    def times(t: str):
        return F.size(F.filter("w", lambda x: x == t))

    counts = df.select(F.col(id_col).alias("id"), F.coalesce(words, F.array().cast("array<string>")).alias("w"))
    counts = counts.select("id", F.size("w").alias("n"), *[times(t).alias(f"t{i}") for i, t in enumerate(wanted)])
    n, held = F.col("n"), [F.col(f"t{i}") for i in range(len(wanted))]
    stats = counts.agg(F.count("*").alias("rows"), F.avg(n).alias("mean"), *[F.coalesce(F.sum((h > 0).cast("long")), F.lit(0)).alias(f"d{i}") for i, h in enumerate(held)])
    scored = counts.where(sum(held, F.lit(0)) > 0).crossJoin(F.broadcast(stats))  # one row
    score = F.lit(0.0)
    for i, h in enumerate(held):
        rarity = F.log1p((F.col("rows") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        score = score + rarity * h * (k1 + 1) / (h + k1 * (1 - b + b * n / F.col("mean")))
    return scored.select("id", score.alias("score"))


def joined_back(fused: DataFrame, base: DataFrame, id_col: str = "id") -> DataFrame:
    """A fused or searched result ``(id, score)`` with the columns of ``base`` beside it, best first, ties by id.

    The result is a few rows, so it is broadcast; ids that ``base`` lacks are left out.
    """
    small = F.broadcast(fused.select(F.col("id").alias("_id"), F.col("score").alias("_score")))
    rows = base.join(small, F.col(id_col) == F.col("_id"))
    names = [F.col(f"`{c}`") for c in base.columns if c.lower() != "score"]
    return rows.select(*names, F.col("_score").alias("score")).orderBy(F.desc("score"), id_col)


def term_frequency(df: DataFrame, terms: Sequence[str], text_col: str = "text", out: str = "tf") -> DataFrame:
    """Rows that hold any of the terms, with how often they do (white-space words in lower case)."""
    words = F.split(F.lower(text_col), r"\s+")
    return df.withColumn(out, F.size(F.filter(words, lambda w: w.isin(*[t.lower() for t in terms])))).where(F.col(out) > 0)


def colbert_search(df: DataFrame, query: Sequence[Sequence[float]], k: int, per_token_k: int = 64, candidate_n: int = 256, bit_width: int = 4, id_col: str = "id", token_col: str = "tokens", exhaustive: bool = False) -> DataFrame:
    """Two-stage late-interaction search: ``(id, score)``, best first, ties by id.

    If ``exhaustive``, every document is a candidate. Stage 1 finds, in one scan, for every query token, the documents of the nearest quantised tokens and keeps
    the ``candidate_n`` with the best single token. Stage 2 ranks these by the exact sum of
    maximum inner products: query tokens are normalised, document tokens taken as they are, and
    pairs without a finite product are skipped. A document with a token of another dimension or a
    non-finite element is left out; an empty query finds nothing.
    """
    if k < 1:
        raise ValueError("k must be positive")
    if not len(query):
        return df.select(F.col(id_col).cast("long").alias("id"), F.lit(0.0).alias("score")).limit(0)
    dim = len(query[0])
    sound = F.forall(token_col, lambda t: t.isNotNull() & (F.size(t) == dim) & F.forall(t, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))
    docs = df.where(F.col(id_col).isNotNull() & F.col(token_col).isNotNull() & sound).select(F.col(id_col).cast("long").alias("id"), F.col(token_col).alias("tokens"))
    tokens = docs.select("id", F.explode("tokens").alias("vector"))
    if exhaustive:
        return rank_by_max_sim(docs, query, k)
    found = knn_many(tokens, query, per_token_k, bit_width)
    order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
    stage = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= per_token_k)
    chosen = stage.groupBy("id").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "id").limit(candidate_n)
    # At most candidate_n rows.
    return rank_by_max_sim(docs.join(F.broadcast(chosen.select("id")), "id"), query, k)


def unit(query: Sequence[Sequence[float]]) -> list[list[float]]:
    out = []
    for q in np.asarray(query, dtype=np.float32):
        norm = np.sqrt((q.astype(float) ** 2).sum())
        out.append([float(x) for x in (q * np.float32(1 / norm) if norm > 0 else q)])
    return out


def rank_by_max_sim(docs: DataFrame, query: Sequence[Sequence[float]], k: int, tokens: str = "tokens") -> DataFrame:
    """Exact late-interaction ranking of ``(id, tokens)``."""
    asked = F.array(*[vector(q) for q in unit(query)])
    return docs.select("id", call("max_sim", asked, F.col(tokens)).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def recall_at_k(found: DataFrame, truth: DataFrame, query_id: str = "qid", id_col: str = "id") -> DataFrame:
    """``(qid, recall)``: the share of each query's true neighbours that were found."""
    hits = truth.join(found.select(query_id, id_col).distinct().withColumn("hit", F.lit(1)), [query_id, id_col], "left")
    return hits.groupBy(query_id).agg(F.avg(F.coalesce("hit", F.lit(0)).cast("double")).alias("recall"))


def ndcg_at_k(found: DataFrame, gains: DataFrame, k: int = 10) -> DataFrame:
    """``(qid, ndcg)`` of results ``(qid, id, rank)`` (1-based) against graded ``(qid, id, gain)``."""
    discount = 1 / F.log2(F.col("rank") + 1)
    got = found.where(F.col("rank") <= k).join(gains, ["qid", "id"]).groupBy("qid").agg(F.sum(F.col("gain") * discount).alias("dcg"))
    best = gains.withColumn("rank", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("gain"), "id"))).where(F.col("rank") <= k)
    ideal = best.groupBy("qid").agg(F.sum(F.col("gain") * discount).alias("ideal"))
    return ideal.join(got, "qid", "left").select("qid", F.when(F.col("ideal") > 0, F.coalesce("dcg", F.lit(0.0)) / F.col("ideal")).otherwise(0.0).alias("ndcg"))
