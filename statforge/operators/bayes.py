"""Naive Bayes by grouped sums, and online logistic regression by followed leaders.

A fit is one aggregate that leaves one row a class; scores are column
expressions.  Every fit can go on from an earlier model with a new batch.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, field, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import NotEnoughSamples, require
from ..functions import vec
from .moments import summed


#: Up to so many terms are unrolled into generated code; more go through array functions.
UNROLLED = 256


@dataclass(frozen=True)
class NaiveBayes:
    """Scoring that the three kinds share: the class of the greatest joint log likelihood."""

    features: tuple[str, ...]
    counts: dict = field(default_factory=dict)

    @property
    def classes(self) -> list:
        return sorted(self.counts)

    def prior(self, c: object) -> float:
        return self.counts[c] / sum(self.counts.values())

    def joint(self) -> list[Column]:
        raise NotImplementedError

    def joint_array(self) -> Column:
        """The same as one array, in the order of the classes."""
        return F.array(*self.joint())

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        if len(self.features) * len(self.classes) <= UNROLLED:
            return df.withColumn(name, vec.argmax(self.joint(), self.classes))
        joint = df.withColumn("_joint", self.joint_array())
        best = F.array_position("_joint", F.array_max("_joint")).cast("int")
        return joint.withColumn(name, F.element_at(F.array(*[F.lit(c) for c in self.classes]), best)).drop("_joint")

    def predict_log_proba(self, df: DataFrame, name: str = "log_proba") -> DataFrame:
        """An array in the order of the sorted classes; shifted sums, so that nothing underflows."""
        shifted = F.transform(F.array(self.joint_array()), lambda js: F.transform(js, lambda j: j - vec.log_sum_exp(js)))  # the joint array is computed once
        return df.withColumn(name, shifted[0])

    def predict_proba(self, df: DataFrame, name: str = "proba") -> DataFrame:
        return df.withColumn(name, F.transform(F.array(self.joint_array()), vec.softmax)[0])


@dataclass(frozen=True)
class GaussianNB(NaiveBayes):
    means: dict = field(default_factory=dict)
    variances: dict = field(default_factory=dict)

    def joint_array(self) -> Column:
        if len(self.features) * len(self.classes) <= UNROLLED:
            return super().joint_array()
        x = F.array(*vec.columns(self.features))

        def numbers(rows: list) -> Column:
            return F.array(*[F.array(*[F.lit(float(v)) for v in row]) for row in rows])

        means, halves = numbers([self.means[c] for c in self.classes]), numbers([2 * self.variances[c] for c in self.classes])
        const = F.array(*[F.lit(math.log(self.prior(c)) - 0.5 * float(np.log(2 * math.pi * self.variances[c]).sum())) for c in self.classes])
        far = F.transform(F.arrays_zip(means.alias("m"), halves.alias("h")), lambda p: F.zip_with(F.zip_with(x, p["m"], lambda a, b: a - b), p["h"], lambda d, h: d * d / h))
        return F.zip_with(const, far, lambda c, d: c - F.aggregate(d, F.lit(0.0), lambda s, v: s + v))

    def joint(self) -> list[Column]:
        x = vec.columns(self.features)
        out = []
        for c in self.classes:
            mu, var = self.means[c], self.variances[c]
            const = math.log(self.prior(c)) - 0.5 * float(np.log(2 * math.pi * var).sum())
            out.append(const - vec.total([(v - float(m)) * (v - float(m)) / float(2 * s) for v, m, s in zip(x, mu, var)]))
        return out


def gaussian_nb(df: DataFrame, features: Sequence[str], target: str, smoothing: float = 1e-9, model: GaussianNB | None = None) -> GaussianNB:
    """Means and population variances of each class, pooled with those of an earlier model.

    The smoothing is relative to the greatest variance of this batch; it is
    also what is taken off the earlier variances, as in the original.
    """
    require(smoothing >= 0, "smoothing is not negative")
    cols = vec.columns(features)
    label = F.col(f"`{target}`")
    rows = df.filter(label.isNotNull()).groupBy(label.alias("label")).agg(F.count(F.lit(1)), *[F.avg(c) for c in cols], *[F.var_pop(c) for c in cols]).collect()
    require(bool(rows), "no rows", NotEnoughSamples)
    d = len(features)
    n = np.array([r[1] for r in rows], float)
    mu = np.array([r[2 : 2 + d] for r in rows], float)
    var = np.array([r[2 + d :] for r in rows], float)
    whole = n @ mu / n.sum()
    spread = (n @ (var + (mu - whole) ** 2)) / n.sum()
    eps = smoothing * float(spread.max())
    counts = dict(model.counts) if model else {}
    means = dict(model.means) if model else {}
    variances = {c: v - eps for c, v in model.variances.items()} if model else {}
    for r, m, v in zip(rows, mu, var):
        c, new = r[0], r[1]
        old = counts.get(c, 0)
        if old:
            total = old + new
            ssd = variances[c] * old + v * new + (means[c] - m) ** 2 * (new * old / total)
            m, v = (m * new + means[c] * old) / total, ssd / total
        counts[c], means[c], variances[c] = old + new, m, v
    return GaussianNB(tuple(features), counts, means, {c: v + eps for c, v in variances.items()})


@dataclass(frozen=True)
class MultinomialNB(NaiveBayes):
    sums: dict = field(default_factory=dict)
    alpha: float = 1.0

    def log_prob(self, c: object) -> np.ndarray:
        smooth = self.sums[c] + self.alpha
        return np.log(smooth) - math.log(smooth.sum())

    def joint(self) -> list[Column]:
        x = vec.columns(self.features)
        return [vec.affine(x, self.log_prob(c), math.log(self.prior(c))) for c in self.classes]


def _class_sums(df: DataFrame, cols: Sequence[Column], target: str) -> list:
    label = F.col(f"`{target}`")
    rows = df.filter(label.isNotNull()).groupBy(label.alias("label")).agg(F.count(F.lit(1)), *[F.sum(c) for c in cols]).collect()
    require(bool(rows), "no rows", NotEnoughSamples)
    return rows


def multinomial_nb(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, model: MultinomialNB | None = None) -> MultinomialNB:
    """log((count + alpha) / (all counts + alpha each)); priors aren't smoothed."""
    require(alpha >= 0, "alpha is not negative")
    counts, sums = (dict(model.counts), dict(model.sums)) if model else ({}, {})
    for r in _class_sums(df, vec.columns(features), target):
        counts[r[0]] = counts.get(r[0], 0) + r[1]
        sums[r[0]] = sums.get(r[0], 0) + np.array(r[2:], float)
    return MultinomialNB(tuple(features), counts, sums, alpha)


@dataclass(frozen=True)
class BernoulliNB(NaiveBayes):
    sums: dict = field(default_factory=dict)
    alpha: float = 1.0
    threshold: float | None = 0.0
    batch: dict = field(default_factory=dict)

    def log_odds(self, c: object) -> tuple[np.ndarray, np.ndarray]:
        p = (self.sums[c] + self.alpha) / (self.batch[c] + 2 * self.alpha)
        return np.log(p), np.log(1 - p)

    def joint(self) -> list[Column]:
        x = _binary(vec.columns(self.features), self.threshold)
        out = []
        for c in self.classes:
            yes, no = self.log_odds(c)
            out.append(vec.affine(x, yes - no, float(no.sum()) + math.log(self.prior(c))))
        return out


def _binary(cols: Sequence[Column], threshold: float | None) -> list[Column]:
    return list(cols) if threshold is None else [(c > threshold).cast("double") for c in cols]


def bernoulli_nb(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, threshold: float | None = 0.0, model: BernoulliNB | None = None) -> BernoulliNB:
    """Features count as present above the threshold.

    When a fit goes on, a class's denominator has the rows of the new batch
    only, as in the original.
    """
    require(alpha >= 0, "alpha is not negative")
    counts, sums, batch = (dict(model.counts), dict(model.sums), dict(model.batch)) if model else ({}, {}, {})
    for r in _class_sums(df, _binary(vec.columns(features), threshold), target):
        counts[r[0]] = counts.get(r[0], 0) + r[1]
        sums[r[0]] = sums.get(r[0], 0) + np.array(r[2:], float)
        batch[r[0]] = r[1]
    return BernoulliNB(tuple(features), counts, sums, alpha, threshold, batch)


# Followed regularised leader


@dataclass(frozen=True)
class Ftrl:
    """Online logistic regression; each batch is one step by its summed gradient."""

    features: tuple[str, ...]
    z: np.ndarray
    n: np.ndarray
    alpha: float = 0.005
    beta: float = 0.0
    l1: float = 0.5
    l2: float = 0.5

    def weights(self) -> np.ndarray:
        """A feature without a penalty that has seen no gradient has weight 0."""
        slow = (self.beta + np.sqrt(self.n)) / self.alpha + self.l2
        shrunk = -(self.z - np.sign(self.z) * self.l1) / np.where(slow > 0, slow, 1.0)
        return np.where((np.abs(self.z) <= self.l1) | (slow <= 0), 0.0, shrunk)

    def probability(self) -> Column:
        e = vec.affine(vec.columns(self.features), self.weights())
        return vec.sigmoid(F.least(F.greatest(e, F.lit(-35.0)), F.lit(35.0)))

    def predict(self, df: DataFrame, name: str = "probability") -> DataFrame:
        return df.withColumn(name, self.probability())

    def update(self, df: DataFrame, target: str) -> Ftrl:
        """The model after one more batch."""
        w, d = self.weights(), len(self.features)

        def part(block: np.ndarray) -> np.ndarray:
            x, y = block[:, :d], block[:, d]
            p = 1 / (1 + np.exp(-np.clip(x @ w, -35, 35)))
            return (p - y) @ x

        g = summed(df.withColumn("_y", F.col(f"`{target}`").cast("boolean").cast("double")), [*self.features, "_y"], part, d)
        sigma = (np.sqrt(self.n + g * g) - np.sqrt(self.n)) / self.alpha
        return replace(self, z=self.z + g - sigma * w, n=self.n + g * g)


def ftrl(df: DataFrame, features: Sequence[str], target: str, alpha: float = 0.005, beta: float = 0.0, l1: float = 0.5, l2: float = 0.5, seed: int = 42, model: Ftrl | None = None) -> Ftrl:
    """One step on ``df``, from an earlier model or from a seeded random start in (0, 1)."""
    require(alpha > 0, "alpha is positive")
    require(beta >= 0, "beta is not negative")
    require(0 <= l1 <= 1 and 0 <= l2 <= 1, "l1 and l2 are between 0 and 1")
    if model is None:
        d = len(features)
        model = Ftrl(tuple(features), np.random.default_rng(seed).random(d), np.zeros(d), alpha, beta, l1, l2)
    return model.update(df, target)
