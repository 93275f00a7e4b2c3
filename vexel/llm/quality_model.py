"""Quality classifier: a document's own evidence under hierarchical empirical-Bayes site priors.

A logistic classifier over text statistics gives each document its own evidence. Grouped
aggregation turns the documents' probabilities into a posterior for every host, shrunk towards
the global mean, and for every path of a host, shrunk towards that host; how strongly, is
estimated from the spread between the groups themselves, so sparse sites stay near their prior
and large ones speak for themselves. A document's final log-odds are its own plus what its path
adds over the global mean.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.quality_rules import histograms, repeated_words
from vexel.llm.scratch import written

#: Labelled documents used to fit the classifier at most.
MAX_LABELLED = 6000
#: Least probability of a kept document.
THRESHOLD = 0.5
#: Site rows joined by broadcast at most; more are joined by a shuffle.
BROADCAST_SITES = 1_000_000
FEATURES = ["long", "upper", "digit", "symbol", "mark", "rest", "common", "repeat"]
_EDGE = 1e-4


def features(df: DataFrame, text: str, lang: str) -> DataFrame:
    """Add ``_x``: the features of :data:`FEATURES`, shares of characters or words but for the log length."""
    h = histograms(df, text, lang)
    for name, step in repeated_words("_words", "_n").items():
        h = h.withColumn(name, step)
    chars = F.greatest(F.col("_word_chars"), F.lit(1)).cast("double")
    words = F.greatest(F.col("_n"), F.lit(1)).cast("double")
    shares = [F.col("_chars")[k] / chars for k in range(1, 6)]
    common = 1 - F.element_at("_common", -1) / words
    x = F.array(F.log1p(F.col("_n").cast("double")) / 10, *shares, common, F.col("_repeated") / words)
    return h.withColumn("_x", x)


def fit(rows: np.ndarray, label: np.ndarray, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a logistic regression, the bias last; a bias alone if there is one label only."""
    x = np.concatenate([rows, np.ones((len(rows), 1))], axis=1)
    w = np.zeros(x.shape[1])
    share = float(np.clip(label.mean() if len(label) else 0.5, 0.01, 0.99))
    w[-1] = np.log(share / (1 - share))
    if not len(label) or label.all() or not label.any():
        return w
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (label - p) / len(x) - ridge * np.append(w[:-1], 0)
        hess = (x * (p * (1 - p))[:, None]).T @ x / len(x) + ridge * np.eye(len(w))
        step = np.linalg.solve(hess, grad)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w


def _logit(p: Column) -> Column:
    q = F.greatest(F.lit(_EDGE), F.least(F.lit(1 - _EDGE), p))
    return F.ln(q / (1 - q))


def _strength(sites: DataFrame, of: str, n: str, prior: str) -> float:
    """Prior strength in documents, by the moments of the groups' means about their prior.

    The spread of means beyond what documents of one group explain, over groups weighted by
    size; groups that don't differ give a great strength, a single group a moderate one.
    """
    mean, mu = F.col(of) / F.col(n), F.col(prior)
    within = mu * (1 - mu)
    row = sites.agg(
        F.sum(n).alias("n"),
        F.count("*").alias("g"),
        F.sum(F.col(n) * (mean - mu) * (mean - mu)).alias("between"),
        F.sum(within).alias("noise"),
        F.avg(within).alias("within"),
    ).first()
    if not row["g"] or row["g"] < 2 or not row["within"]:
        return 50.0
    variance = max((row["between"] - row["noise"]) / row["n"], row["within"] / 1e4)
    return float(min(max(row["within"] / variance - 1, 1.0), 1e4))


def score(df: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", lang: str = "lang", host: str = "source", path: str = "lang") -> DataFrame:
    """``doc_id``, ``doc_score``, ``host_posterior``, ``path_posterior``, ``score`` and ``kept`` of every document.

    ``score`` is the probability of good quality, by the document's own evidence and its path's
    posterior without it (its host's, to which that one is shrunk, has it in); documents of at least :data:`THRESHOLD` are
    kept. A null host or path is a group of its own. Null and empty texts are judged by their
    features, all zero. Documents with several labels are good if one is. Repeated rows and null
    ids have a row each. Without labels every document scores even and is kept. An empty input
    gives no rows.
    """
    base = df.select(
        F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.col(f"`{lang}`").alias("tongue"),
        F.coalesce(F.col(f"`{host}`").cast("string"), F.lit("\x00")).alias("host"), F.coalesce(F.col(f"`{path}`").cast("string"), F.lit("\x00")).alias("path"),
    )
    rows = written(features(base, "text", "tongue").select("doc_id", "host", "path", "_x"), "features")

    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    few = known.orderBy(F.crc32(F.col("doc_id").cast("string")), "doc_id").limit(MAX_LABELLED)
    sample = rows.join(F.broadcast(few), "doc_id").groupBy("doc_id").agg(F.max("_x").alias("x"), F.max("quality").alias("y")).orderBy("doc_id").collect()
    w = fit(np.asarray([r["x"] for r in sample]).reshape(-1, len(FEATURES)), np.asarray([r["y"] > 0 for r in sample], dtype=bool))

    own = F.aggregate(F.zip_with("_x", F.array(*map(F.lit, w[:-1].tolist())), lambda a, b: a * b), F.lit(float(w[-1])), lambda a, x: a + x)
    rows = rows.select("doc_id", "host", "path", own.alias("_own")).withColumn("_p", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), "_own")))))
    paths = written(rows.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("_p").alias("s")), "paths")
    total = paths.agg(F.sum("s").alias("s"), F.sum("n").alias("n")).first()
    mu = float(total["s"] / total["n"]) if total["n"] else 0.5
    hosts = paths.groupBy("host").agg(F.sum("n").alias("hn"), F.sum("s").alias("hs")).withColumn("mu", F.lit(mu))
    k = _strength(hosts, "hs", "hn", "mu")
    hosts = hosts.select("host", ((F.col("hs") + k * mu) / (F.col("hn") + k)).alias("host_posterior"))
    sites = paths.join(hosts, "host")
    k = _strength(sites, "s", "n", "host_posterior")
    sites = written(sites.select("host", "path", "host_posterior", "s", "n", ((F.col("s") + k * F.col("host_posterior")) / (F.col("n") + k)).alias("path_posterior")), "sites")
    if sites.count() <= BROADCAST_SITES:
        sites = F.broadcast(sites)
    # A document's own evidence counts once: its path speaks for the others there.
    others = (F.col("s") - F.col("_p") + k * F.col("host_posterior")) / (F.col("n") - 1 + k)
    final = F.col("_own") + _logit(others) - _logit(F.lit(mu))
    out = rows.join(sites, ["host", "path"]).withColumn("score", 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), final)))))
    return out.select("doc_id", F.col("_p").alias("doc_score"), "host_posterior", "path_posterior", "score", (F.col("score") >= THRESHOLD).alias("kept"))
