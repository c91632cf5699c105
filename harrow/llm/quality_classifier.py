"""Quality classifier learned from trusted positives and unlabelled text alone."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harrow.llm.measures import CLASSES, SPACES, class_counts, measure

#: Every ``FOLDS``-th fold is held out; rows learned from at most, of each kind.
FOLDS, POSITIVES, UNLABELLED = 5, 8_000, 16_000
#: A document is accepted from this score on.
ACCEPT = 0.3


def features(text: str | None) -> list[float]:
    """Sizes, shares of character classes and repetition; all 0 for an empty text."""
    text = text or ""
    m = measure(text)
    shares = class_counts(text) / max(1, len(text))
    words = max(1, m.n_words)
    return [
        np.log1p(m.n_words),
        np.log1p(m.n_lines),
        *shares.tolist(),
        m.word_chars / words,
        m.n_symbols / words,
        m.n_dup_lines / max(1, m.n_lines),
        m.n_repeat_words / words,
        len(set(m.words)) / words,
        sum(map(text.count, SPACES)) / words,
    ]


N_FEATURES = len(CLASSES) + 8


@dataclass
class Model:
    """A network of one hidden layer; without positives to learn from it gives every text 0.5."""

    prior: float
    mean: np.ndarray
    spread: np.ndarray
    weights: list[np.ndarray]

    def logits(self, x: np.ndarray) -> np.ndarray:
        if not self.weights:
            return np.zeros(len(x))
        a, b, c, d = self.weights
        return np.tanh((x - self.mean) / self.spread @ a + b) @ c + d[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x), -30, 30)))


def held_out(id_column: Column) -> Column:
    return F.crc32(F.coalesce(id_column.cast("string"), F.lit("")).cast("binary")) % FOLDS == 0


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray, delta: float = 0.1) -> float:
    """The share of positives among the unlabelled, from scores of rows that were not learned from.

    Above any threshold the unlabelled hold at least the positives' share of their own;
    the least ratio over thresholds, with a margin for small counts, bounds the prior.
    """
    cuts = np.unique(np.concatenate([positive, unlabelled]))
    p = 1 - np.searchsorted(np.sort(positive), cuts) / len(positive)
    u = 1 - np.searchsorted(np.sort(unlabelled), cuts) / len(unlabelled)
    margin = np.sqrt(np.log(4 / delta) / 2) * (1 / np.sqrt(len(positive)) + 1 / np.sqrt(len(unlabelled)))
    able = p > 2 * margin
    if not able.any():
        return 0.5
    best = int(np.argmin(np.where(able, (u + margin) / np.where(p > 0, p, 1), np.inf)))
    return float(np.clip(u[best] / p[best], 0.05, 0.95))


def minimise(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, hidden: int = 24, rounds: int = 400, rate: float = 0.01, decay: float = 1e-4, seed: int = 5) -> list[np.ndarray]:
    """Weights that minimise the non-negative unbiased risk (log loss), by Adam over all rows.

    The risk of calling a text bad is that over the unlabelled less the positives' part
    in it. Where this difference falls under 0 the positives have been learned by heart:
    the step is then taken against it. Without a prior the plain risk of telling
    positives from unlabelled is minimised, which the prior is estimated from.
    """
    rng = np.random.default_rng(seed)
    n = positive.shape[1]
    weights = [rng.normal(0, 1 / np.sqrt(n), (n, hidden)), np.zeros(hidden), rng.normal(0, 1 / np.sqrt(hidden), hidden), np.zeros(1)]
    first, second = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    x = np.concatenate([positive, unlabelled])
    is_positive = np.arange(len(x)) < len(positive)
    each = np.where(is_positive, 1 / len(positive), 1 / len(unlabelled))
    for step in range(1, rounds + 1):
        a, b, c, d = weights
        h = np.tanh(x @ a + b)
        g = h @ c + d[0]
        s = 1 / (1 + np.exp(-np.clip(g, -30, 30)))
        as_good, as_bad = s - 1, s  # slopes of the losses for good and for bad
        if prior is None:
            slope = each * np.where(is_positive, as_good, as_bad)
        else:
            loss_bad = np.logaddexp(0, g)
            bad = (each * loss_bad)[~is_positive].sum() - prior * (each * loss_bad)[is_positive].sum()
            bad_slope = each * np.where(is_positive, -prior * as_bad, as_bad)
            slope = -bad_slope if bad < 0 else bad_slope + each * np.where(is_positive, prior * as_good, 0)
        through = np.outer(slope, c) * (1 - h * h)
        slopes = [x.T @ through + decay * a, through.sum(0), h.T @ slope + decay * c, np.array([slope.sum()])]
        for i, v in enumerate(slopes):
            first[i] = 0.9 * first[i] + 0.1 * v
            second[i] = 0.999 * second[i] + 0.001 * v * v
            weights[i] = weights[i] - rate * (first[i] / (1 - 0.9**step)) / (np.sqrt(second[i] / (1 - 0.999**step)) + 1e-8)
    return weights


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text", label_column: str = "quality",
    positives: int = POSITIVES, unlabelled: int = UNLABELLED,
) -> Model:
    """A model from documents labelled 1 as trusted positives and documents at large as unlabelled.

    Labels 0 are never read, nor are labels of held-out ids. Both kinds are bounded
    samples, the rows with the smallest hashes of their ids, so a rerun learns the same;
    their features, not their texts, come to the driver. Half of them tell positives from
    unlabelled, and the other half's scores give the prior; then all are learned from.
    Ids with labels both 0 and 1 are not trusted. Without positives the model is neutral.
    """
    learned = ~held_out(F.col("id"))
    trusted = labels.select(F.col(id_column).alias("id"), F.col(label_column).alias("q")).where(F.col("id").isNotNull())
    trusted = trusted.groupBy("id").agg(F.min("q").alias("q")).where((F.col("q") == 1) & learned).select("id")
    everyone = docs.select(F.col(id_column).alias("id")).where(F.col("id").isNotNull() & learned).distinct()
    order = (F.xxhash64("id"), F.col("id"))
    sample = trusted.join(everyone, "id").orderBy(*order).limit(positives).withColumn("trusted", F.lit(True)).union(
        everyone.orderBy(*order).limit(unlabelled).withColumn("trusted", F.lit(False))
    )
    kinds = sample.groupBy("id").agg(F.max("trusted").alias("p"), (F.min("trusted") == F.lit(False)).alias("u"))

    @F.pandas_udf("array<double>")
    def seen(texts: pd.Series) -> pd.Series:
        return pd.Series([features(t) for t in texts])

    texts = docs.select(F.col(id_column).alias("id"), F.col(text_column).alias("text"))
    drawn = texts.join(F.broadcast(kinds), "id")  # at most the two bounds' rows
    drawn = drawn.select("id", "p", "u", seen("text").alias("x")).dropDuplicates(["id"])
    rows = sorted(drawn.collect(), key=lambda r: r["id"])
    neutral = Model(0.5, np.zeros(N_FEATURES), np.ones(N_FEATURES), [])
    positive = np.array([r["x"] for r in rows if r["p"]])
    rest = np.array([r["x"] for r in rows if r["u"]])
    if len(positive) < 10 or len(rest) < 10:
        return neutral
    mean, spread = rest.mean(0), rest.std(0) + 1e-6
    positive, rest = (positive - mean) / spread, (rest - mean) / spread
    plain = Model(0.5, np.zeros(N_FEATURES), np.ones(N_FEATURES), minimise(positive[::2], rest[::2], None))
    prior = estimated_prior(plain.logits(positive[1::2]), plain.logits(rest[1::2]))
    return Model(prior, mean, spread, minimise(positive, rest, prior))


def with_score(docs: DataFrame, model: Model, text_column: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with each whole text's score, 0 to 1, in column ``out`` (replaced if there is one).

    Null texts score as empty ones. Every row stays.
    """

    @F.pandas_udf("double")
    def score(texts: pd.Series) -> pd.Series:
        x = np.array([features(t) for t in texts], float).reshape(-1, N_FEATURES)
        return pd.Series(model.scores(x))

    return docs.withColumn(out, score(F.col(text_column)))


def accepted(docs: DataFrame, labels: DataFrame, threshold: float = ACCEPT, **columns) -> DataFrame:
    """The documents that score at least ``threshold``, in the columns of ``docs``."""
    model = fit(docs, labels, **columns)
    scored = with_score(docs, model, columns.get("text_column", "text"), "__quality_score")
    return scored.where(F.col("__quality_score") >= threshold).select(*docs.columns)
