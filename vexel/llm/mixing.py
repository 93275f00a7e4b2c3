"""Soft-membership mixing of documents to target weights of domains, in DataFrame functions only.

A naive Bayes classifier over a few telling words, fitted on the documents that the label table
covers, gives each document a posterior over the domains. Rates of repetition, one for each
document, at least one and without a cap, are then fitted by Newton steps so that the expected
tokens of each domain, the sum of rate x tokens x posterior, are in proportion to the targets.
Every step needs from the data only a few sums over pairs of domains. A document's rate depends on
its posterior and on one number for each domain, so no state is kept.
"""

from __future__ import annotations

import warnings
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vexel.llm.quality_rules import words_of
from vexel.llm.scratch import written

DOMAINS = ("en", "de", "fr", "es")
#: Production targets: shares of the domains' tokens.
TARGETS = {"en": 0.50, "de": 0.18, "fr": 0.18, "es": 0.14}
#: Labelled documents used to fit the classifier at most, and its words for each domain.
MAX_LABELLED, WORDS_PER_DOMAIN = 3000, 12
#: Words of evidence that a text counts for at most, however long: keeps memberships soft.
EVIDENCE_WORDS = 40
TOLERANCE = 1e-4
#: Of :func:`fit_repeats`: weight that keeps its steps finite where targets can't be reached, and
#: steps after which it reports so; some 5 to 15 do where they can.
DAMPING, MAX_NEWTON = 1e-7, 100


@dataclass
class Classifier:
    """``logs[d][k]``: log-probability in domain ``d`` of word ``k``, the last for all other words."""

    domains: tuple[str, ...]
    words: list[str]
    logs: list[list[float]]
    priors: list[float]


def fit_classifier(docs: DataFrame, labels: DataFrame, domain: str = "lang", text: str = "text", doc_id: str = "doc_id", domains: tuple[str, ...] = DOMAINS) -> Classifier:
    """Fit on the labelled documents with the least CRC-32 of their id, :data:`MAX_LABELLED` at most.

    Without any labelled document of a known domain all posteriors are even.
    """
    ids = labels.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("_id")).distinct()
    few = ids.orderBy(F.crc32(F.col("_id").cast("string")), "_id").limit(MAX_LABELLED)
    rows = docs.where(F.col(domain).isin(*domains)).select(F.col(doc_id).cast("long").alias("_id"), F.col(domain).alias("_d"), F.lower(text).alias("_t"))
    rows = written(rows.join(F.broadcast(few), "_id").select("_d", words_of(F.col("_t")).alias("_w")), "labelled")
    counts = rows.select("_d", F.explode("_w").alias("w")).groupBy("w").agg(*[F.sum((F.col("_d") == d).cast("long")).alias(f"n{k}") for k, d in enumerate(domains)])
    counts = written(counts, "word_counts")
    n = [F.col(f"n{k}") for k in range(len(domains))]
    totals = counts.agg(*[F.coalesce(F.sum(x), F.lit(0)) for x in n]).first()
    share = {r["_d"]: r["count"] for r in rows.groupBy("_d").count().collect()}
    chosen: dict[str, list[int]] = {}
    for k in range(len(domains)):
        rest = sum((n[j] / (totals[j] + 1) for j in range(len(domains)) if j != k), F.lit(0.0))
        telling = n[k] * F.ln((n[k] / (totals[k] + 1) + 1e-6) / (rest / max(1, len(domains) - 1) + 1e-6))
        for r in counts.where(n[k] > 1).orderBy(telling.desc(), "w").limit(WORDS_PER_DOMAIN).collect():
            chosen[r["w"]] = [r[f"n{j}"] for j in range(len(domains))]
    words = sorted(chosen)
    logs = []
    for k in range(len(domains)):
        p = np.asarray([chosen[w][k] + 0.5 for w in words] + [totals[k] - sum(chosen[w][k] for w in words) + 0.5])
        logs.append([float(x) for x in np.log(p / p.sum())])
    prior = np.asarray([share.get(d, 0) + 1.0 for d in domains])
    return Classifier(tuple(domains), words, logs, [float(x) for x in np.log(prior / prior.sum())])


def posteriors(df: DataFrame, model: Classifier, text: str = "text") -> DataFrame:
    """Add ``_tokens`` (words, long) and ``_p`` (array: the posterior of each domain in order)."""
    df = df.withColumn("_w", words_of(F.lower(F.col(text))))
    df = df.withColumns({"_tokens": F.size("_w").cast("long"), "_w": F.filter("_w", lambda w: w.isin(model.words)) if model.words else F.array().cast("array<string>")})
    known = F.array(*map(F.lit, model.words)) if model.words else F.array().cast("array<string>")
    df = df.withColumn("_c", F.transform(known, lambda w: F.size(F.filter("_w", lambda h: h == w)).cast("double")))
    df = df.withColumn("_c", F.concat("_c", F.array((F.col("_tokens") - F.size("_w")).cast("double"))))
    scale = F.lit(1.0) / F.greatest(F.lit(1.0), F.col("_tokens") / F.lit(float(EVIDENCE_WORDS)))

    def evidence(k: int) -> Column:
        logs = F.array(*map(F.lit, model.logs[k]))
        return F.aggregate(F.zip_with("_c", logs, lambda c, x: c * x), F.lit(0.0), lambda a, x: a + x)

    df = df.withColumn("_e", F.array(*[F.lit(model.priors[k]) + scale * evidence(k) for k in range(len(model.domains))]))
    df = df.withColumn("_e", F.transform("_e", lambda x: F.exp(x - F.array_max("_e"))))
    total = F.aggregate("_e", F.lit(0.0), lambda a, x: a + x)
    return df.withColumn("_s", total).withColumn("_p", F.transform("_e", lambda x: x / F.col("_s"))).drop("_w", "_c", "_e", "_s")


@dataclass
class Repeats:
    """Fitted rates: a document's is ``1 + max(0, sum of posterior x pull)``; ``reached`` are the domains' tokens."""

    pulls: list[float]
    targets: list[float] = field(default_factory=list)
    reached: list[float] = field(default_factory=list)

    def of(self, p: str = "_p") -> Column:
        return F.lit(1.0) + self.more(p)

    def more(self, p: str = "_p") -> Column:
        pull = F.aggregate(F.zip_with(p, F.array(*map(F.lit, self.pulls)), lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x)
        return F.greatest(F.lit(0.0), pull)

    @property
    def missed(self) -> float:
        """Greatest distance of a domain's tokens from its target, as a share of the target."""
        return max((abs(r - t) / t if t > 0 else float(r > 0) for r, t in zip(self.reached, self.targets, strict=True)), default=0.0)


def _solve(sums, share: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pulls and totals; ``sums`` gives totals, sums over pairs of domains and half the squares for pulls."""
    pulls = np.zeros(len(share))
    start = now = sums(pulls)[0]
    use = [k for k in range(len(share)) if share[k] > 0 and start[k] > 0]
    if len(use) < 2:
        return pulls, now
    # The pull of the domain that there is most of follows from the others': pulls x shares add up to zero.
    most = max(use, key=lambda k: start[k] / share[k])
    free = [k for k in use if k != most]
    basis = np.zeros((len(share), len(free)))
    for i, k in enumerate(free):
        basis[k, i], basis[most, i] = 1.0, -share[k] / share[most]
    damping = DAMPING * np.diag(start)

    def state(z: np.ndarray):
        v = basis @ z
        total, square, squares = sums(v)
        return squares + start @ v + v @ damping @ v / 2, basis.T @ (total + damping @ v), basis.T @ (square + damping) @ basis, total

    at = np.asarray([start[most] / share[most] * share[k] / start[k] - 1.0 for k in free])
    (value, slope, bend, now), caution = state(at), 1e-3
    for _ in range(MAX_NEWTON):
        budget = now[use].sum() / share[use].sum()
        if (np.abs(now - share * budget)[use] <= TOLERANCE * share[use] * budget).all():
            break
        # Nearer to plain descent where few rows are repeated so far, as a whole Newton step goes astray there.
        step = -np.linalg.lstsq(bend + caution * basis.T @ np.diag(start) @ basis, slope)[0]
        tried = state(at + step)
        if tried[0] > value + 1e-4 * (slope @ step):
            caution *= 8
            if caution > 1e6:
                break
            continue
        gain = value - tried[0]
        at, (value, slope, bend, now), caution = at + step, tried, caution / 8
        if gain <= 1e-12 * abs(value):
            break
    return basis @ at, now


def fit_repeats(mass: DataFrame, weights: list[float]) -> Repeats:
    """Rates of at least one over rows ``(_tokens, _p)``, so that the domains' tokens are as their ``weights``.

    Of all such rates those with the least sum of tokens x (rate - 1)^2, whatever total that takes.
    The multipliers of the domains solve a convex problem in as many unknowns as there are domains,
    less one; Newton steps with halving stop when each domain is within :data:`TOLERANCE` of its
    target. Where no rates reach the targets (posteriors too soft, a domain without tokens or with
    a weight of zero), the nearest found are returned with a warning that says what is reached.
    """
    d = len(weights)
    share = np.asarray(weights, dtype=float) / sum(weights)

    def sums(pulls: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
        """Totals of the domains, of pairs of domains over what is repeated, and half the squares."""
        x, n, p = F.col("_x"), F.col("_tokens"), [F.col("_p")[k] for k in range(d)]
        pairs = [(j, k) for j in range(d) for k in range(j, d)]
        wanted = [F.sum((1.0 + x) * n * p[k]) for k in range(d)] + [F.sum(F.when(x > 0, n * p[j] * p[k])) for j, k in pairs] + [F.sum(n * x * x) / 2]
        row = mass.withColumn("_x", Repeats([float(v) for v in pulls]).more()).agg(*[F.coalesce(v, F.lit(0.0)).alias(f"s{i}") for i, v in enumerate(wanted)]).first()
        square = np.zeros((d, d))
        for (j, k), v in zip(pairs, row[d:-1], strict=True):
            square[j, k] = square[k, j] = v
        return np.asarray(row[:d], dtype=float), square, float(row[-1])

    pulls, now = _solve(sums, share)
    found = Repeats([float(x) for x in pulls], [float(x) for x in share * now.sum()], [float(x) for x in now])
    if now.sum() > 0 and found.missed > 10 * TOLERANCE:
        shares = ", ".join(f"{r / now.sum():.4f} of {t:.4f}" for r, t in zip(now, share, strict=True))
        warnings.warn(f"mixing doesn't reach its targets; the domains' shares of tokens: {shares}", stacklevel=2)
    return found


def copies(rate: Column, *key: Column) -> Column:
    """Whole copies for a rate: its floor, and one more for the share of keys that its fraction gives.

    Rows of one key, so of one id and text here, are rounded alike.
    """
    draw = F.pmod(F.xxhash64(*key), F.lit(1 << 20)) / F.lit(float(1 << 20))
    return (F.floor(rate) + (draw < rate - F.floor(rate)).cast("long")).cast("int")


def mix(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """``doc_id``, ``tokens``, ``p_<domain>``, ``rate`` and ``copies`` of every document.

    Null and empty texts have no tokens and the prior as posterior. Repeated rows and null ids
    have a row each. If no document has tokens, all rates are one. An empty input gives no rows.
    """
    targets = targets or TARGETS
    domains = tuple(targets)
    model = fit_classifier(docs, labels, domains=domains)
    rows = posteriors(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), model)
    mass = written(rows.select("doc_id", F.xxhash64("doc_id", "text").alias("_key"), "_tokens", "_p"), "memberships")
    rates = fit_repeats(mass, [targets[d] for d in domains])
    return mass.withColumn("rate", rates.of()).select(
        "doc_id",
        F.col("_tokens").alias("tokens"),
        *[F.col("_p")[k].alias(f"p_{d}") for k, d in enumerate(domains)],
        "rate",
        copies(F.col("rate"), F.col("_key")).alias("copies"),
    )


def resample(docs: DataFrame, labels: DataFrame, targets: dict[str, float] | None = None) -> DataFrame:
    """The input's rows, each as often as :func:`mix` says: rates are one or more, so every row stays.

    Posteriors are worked out twice, as rates are known only after all of them: that costs less
    than keeping the texts beside them in between.
    """
    targets = targets or TARGETS
    domains = tuple(targets)
    model = fit_classifier(docs, labels, domains=domains)
    mass = written(posteriors(docs.select("text"), model).select("_tokens", "_p"), "memberships")
    rates = fit_repeats(mass, [targets[d] for d in domains])
    names = docs.columns
    inner = docs.toDF(*[f"c{k}" for k in range(len(names))])
    rated = posteriors(inner, model, f"c{names.index('text')}").withColumn("_rate", rates.of())
    times = copies(F.col("_rate"), F.xxhash64(F.col(f"c{names.index('doc_id')}").cast("long"), F.col(f"c{names.index('text')}")))
    rows = rated.withColumn("_copy", F.explode(F.sequence(F.lit(1), times)))
    return rows.select(*[F.col(f"c{k}").alias(c) for k, c in enumerate(names)])
