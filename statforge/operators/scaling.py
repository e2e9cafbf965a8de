"""Scaling and whitening of features."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import NotEnoughSamples, require
from ..functions import vec
from .moments import moments


@dataclass(frozen=True)
class LinearScaler:
    """A fitted scaler: each feature becomes (x - offset) * scale + shift."""

    features: tuple[str, ...]
    offset: tuple[float, ...]
    scale: tuple[float, ...]
    shift: tuple[float, ...]

    def transform(self, df: DataFrame) -> DataFrame:
        """``df`` with its features replaced; all else stays as it is."""
        new = {f: (F.col(f"`{f}`").cast("double") - o) * s + t for f, o, s, t in zip(self.features, self.offset, self.scale, self.shift)}
        return df.withColumns(new)


def _stats(df: DataFrame, features: Sequence[str], *kinds) -> list[list[float]]:
    row = df.agg(F.count(F.lit(1)), *[k(F.col(f"`{f}`").cast("double")) for k in kinds for f in features]).first()
    require(row[0] > 0, "a scaler needs rows", NotEnoughSamples)
    values = [float(v) for v in row[1:]]
    return [values[i * len(features) : (i + 1) * len(features)] for i in range(len(kinds))]


def _inverse(x: float) -> float:
    return 1.0 if abs(x) < 1e-12 else 1.0 / x


def standard_scaler(df: DataFrame, features: Sequence[str], with_mean: bool = True, with_std: bool = True) -> LinearScaler:
    """(x - mean) / population deviation; a constant feature is only centred.

    Without ``with_mean`` the mean is added back after scaling, as in the
    original; without ``with_std`` features are only centred.
    """
    mean, dev = _stats(df, features, F.avg, F.stddev_pop)
    zero = [0.0] * len(mean)
    scale = [_inverse(d) for d in dev] if with_std else [1.0] * len(mean)
    return LinearScaler(tuple(features), tuple(mean), tuple(scale), tuple(zero if with_mean else mean))


def min_max_scaler(df: DataFrame, features: Sequence[str], low: float = 0.0, high: float = 1.0) -> LinearScaler:
    """Into [low, high]; a constant feature becomes ``low``."""
    require(low <= high, "the range is upside down")
    least, most = _stats(df, features, F.min, F.max)
    scale = [_inverse(b - a) * (high - low) for a, b in zip(least, most)]
    return LinearScaler(tuple(features), tuple(least), tuple(scale), (float(low),) * len(features))


def max_abs_scaler(df: DataFrame, features: Sequence[str]) -> LinearScaler:
    """x / max|x|; a feature of zeros stays as it is."""
    (most,) = _stats(df, features, lambda c: F.max(F.abs(c)))
    zero = (0.0,) * len(features)
    return LinearScaler(tuple(features), zero, tuple(_inverse(m) for m in most), zero)


def norm_scaled(df: DataFrame, features: Sequence[str], kind: str = "l2") -> DataFrame:
    """Each row divided by its l1, l2 or max norm; a row of zeros becomes NaN."""
    cols = vec.columns(features)
    n = vec.norm(cols, kind)
    return df.withColumns({f: F.when(n == 0, F.lit(float("nan"))).otherwise(c / n) for f, c in zip(features, cols)})


@dataclass(frozen=True)
class Whitener:
    """Fitted: a row x becomes matrix @ (x - mean)."""

    features: tuple[str, ...]
    mean: np.ndarray
    matrix: np.ndarray

    def transform(self, df: DataFrame) -> DataFrame:
        cols = [c - float(m) for c, m in zip(vec.columns(self.features), self.mean)]
        return df.withColumns({f: vec.affine(cols, row) for f, row in zip(self.features, self.matrix)})


def whitener(df: DataFrame, features: Sequence[str], method: str = "pca") -> Whitener:
    """Decorrelate to unit variance by ``pca``, ``zca`` or ``cholesky``.

    The covariance comes from one pass; only features x features numbers reach
    the driver.
    """
    require(method in ("pca", "zca", "cholesky"), f"no such whitening: {method}")
    m = moments(df, features)
    require(m.n > 1, "whitening needs two rows", NotEnoughSamples)
    cov = m.scatter / (m.n - 1)
    if method == "cholesky":
        matrix = np.linalg.cholesky(np.linalg.inv(cov)).T
    else:
        values, vectors = np.linalg.eigh(cov)
        order = np.argsort(-values)
        values, vectors = np.maximum(values[order], 0), vectors[:, order]
        if method == "pca":
            singular = np.maximum(np.sqrt(values * (m.n - 1)), 1e-8)
            matrix = (vectors * np.sqrt(m.n - 1) / singular).T * flip_signs(vectors)[:, None]
        else:
            with np.errstate(divide="ignore"):
                matrix = (vectors * np.maximum(1 / np.sqrt(values), 1e-8)) @ vectors.T
    return Whitener(tuple(features), m.mean, matrix)


def flip_signs(vectors: np.ndarray) -> np.ndarray:
    """For each column the sign that makes its largest entry positive."""
    return np.where(vectors[np.abs(vectors).argmax(axis=0), np.arange(vectors.shape[1])] < 0, -1.0, 1.0)
