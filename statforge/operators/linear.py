"""Linear models.

The least-squares family needs only sufficient statistics: one pass over the
rows, and numbers of features x features on the driver.  Generalised and
logistic models take Newton steps, each one pass that sums a gradient and a
Hessian over all rows.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import InvalidLabels, InvalidParameter, NotConverged, NotEnoughSamples, require
from ..functions import vec
from .moments import Moments, moments, summed
from .rows import indexed


@dataclass(frozen=True)
class LinearModel:
    """prediction = link(x . weights + intercept)."""

    features: tuple[str, ...]
    weights: np.ndarray
    intercept: float = 0.0

    def score(self) -> Column:
        return vec.affine(vec.columns(self.features), self.weights, self.intercept)

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, self.score())


def ols(df: DataFrame, features: Sequence[str], target: str, intercept: bool = True) -> LinearModel:
    """Ordinary least squares."""
    m = moments(df, [*features, target])
    if intercept:
        a, b = m.centred(features, features), m.centred(features, [target])[:, 0]
    else:
        a, b = m.raw(features, features), m.raw(features, [target])[:, 0]
    scale = np.sqrt(np.maximum(np.diag(a), 1e-300))
    w = np.linalg.lstsq(a / np.outer(scale, scale), b / scale, rcond=None)[0] / scale
    i = m.at(features)
    return LinearModel(tuple(features), w, float(m.mean[m.at([target])[0]] - m.mean[i] @ w) if intercept else 0.0)


# Elastic net


@dataclass(frozen=True)
class ElasticNet(LinearModel):
    duality_gap: float = 0.0
    n_steps: int = 0
    variance: np.ndarray | None = None

    def z_score(self) -> np.ndarray:
        return self.weights / np.sqrt(self._variance())

    def confidence_95th(self) -> np.ndarray:
        """Rows (low, high), 1.645 deviations either way."""
        reach = 1.645 * np.sqrt(self._variance())
        return np.stack([self.weights - reach, self.weights + reach], axis=1)

    def _variance(self) -> np.ndarray:
        require(self.variance is not None, "too few rows, or features that depend on each other", NotEnoughSamples)
        return self.variance


@dataclass(frozen=True)
class MultiTaskElasticNet:
    """One column of weights for each target."""

    features: tuple[str, ...]
    targets: tuple[str, ...]
    weights: np.ndarray
    intercepts: np.ndarray
    duality_gap: float
    n_steps: int
    variance: np.ndarray | None

    def predict(self, df: DataFrame, prefix: str = "prediction_") -> DataFrame:
        x = vec.columns(self.features)
        return df.withColumns({f"{prefix}{t}": vec.affine(x, self.weights[:, j], self.intercepts[j]) for j, t in enumerate(self.targets)})

    def z_score(self) -> np.ndarray:
        require(self.variance is not None, "too few rows, or features that depend on each other", NotEnoughSamples)
        return self.weights / np.sqrt(self.variance)[:, None]

    def confidence_95th(self) -> np.ndarray:
        require(self.variance is not None, "too few rows, or features that depend on each other", NotEnoughSamples)
        reach = 1.645 * np.sqrt(self.variance)[:, None]
        return np.stack([self.weights - reach, self.weights + reach], axis=-1)


def _check_net(penalty: float, l1_ratio: float, tolerance: float) -> None:
    require(penalty >= 0, "a penalty is not negative")
    require(0 <= l1_ratio <= 1, "the l1 ratio is between 0 and 1")
    require(tolerance >= 0, "a tolerance is not negative")


def _descend(g: np.ndarray, xty: np.ndarray, yty: np.ndarray, n: float, penalty: float, l1_ratio: float, tolerance: float, iterations: int) -> tuple[np.ndarray, float, int]:
    """Block coordinate descent on the Gram matrix; with one target it is the plain one."""
    l1, l2 = n * l1_ratio * penalty, n * (1 - l1_ratio) * penalty
    w = np.zeros_like(xty)
    rest = xty.copy()  # X'R for the residual R
    total = float(np.trace(yty))
    gap, steps = 1.0 + tolerance, 0

    def gap_now() -> float:
        r2 = total - 2 * float((w * xty).sum()) + float((w * (g @ w)).sum())
        ry = total - float((w * xty).sum())
        most = float(np.sqrt(((rest - l2 * w) ** 2).sum(axis=1)).max(initial=0.0))
        c = l1 / most if most > l1 else 1.0
        first = 0.5 * (r2 + r2 * c * c) if most > l1 else r2
        return first + l1 * float(np.sqrt((w * w).sum(axis=1)).sum()) - c * ry + 0.5 * l2 * (1 + c * c) * float((w * w).sum())

    while steps < iterations:
        most_w = most_d = 0.0
        for j in range(len(g)):
            if g[j, j] <= 0:
                continue
            old = w[j].copy()
            pull = rest[j] + g[j, j] * old
            size = float(np.sqrt(pull @ pull))
            w[j] = 0.0 if size <= l1 else pull * (1 - l1 / size) / (g[j, j] + l2)
            step = w[j] - old
            if step.any():
                rest -= np.outer(g[:, j], step)
            before, after = float(np.sqrt(old @ old)), float(np.sqrt(w[j] @ w[j]))
            most_d = max(most_d, abs(float(step[0])) if len(step) == 1 else abs(after - before))
            most_w = max(most_w, after)
        steps += 1
        if steps == iterations - 1 or most_w == 0 or most_d / most_w < tolerance:
            gap = gap_now()
            if gap < tolerance * total:
                break
    return w, gap, steps


def _net(df: DataFrame, features: Sequence[str], targets: Sequence[str], penalty: float, l1_ratio: float, intercept: bool, tolerance: float, iterations: int):
    _check_net(penalty, l1_ratio, tolerance)
    m = moments(df, [*features, *targets])
    mean = m.mean[m.at(targets)] if intercept else np.zeros(len(targets))
    g = m.raw(features, features)
    sums = m.n * m.mean[m.at(features)]
    # only the targets are centred, as in the original
    xty = m.raw(features, targets) - np.outer(sums, mean)
    yty = m.raw(targets, targets) - m.n * (np.outer(m.mean[m.at(targets)], mean) + np.outer(mean, m.mean[m.at(targets)]) - np.outer(mean, mean))
    w, gap, steps = _descend(g, xty, yty, m.n, penalty, l1_ratio, tolerance, iterations)
    variance = None
    if m.n > len(features) and np.linalg.matrix_rank(g) == len(features):
        r2 = float(np.trace(yty) - 2 * (w * xty).sum() + (w * (g @ w)).sum())
        variance = r2 / (len(targets) * (m.n - len(features))) * np.diag(np.linalg.inv(g))
    return w, mean, gap, steps, variance


def elastic_net(df: DataFrame, features: Sequence[str], target: str, penalty: float = 1.0, l1_ratio: float = 0.5, intercept: bool = True, tolerance: float = 1e-4, iterations: int = 1000) -> ElasticNet:
    """Coordinate descent; the intercept is the target's mean and features aren't centred."""
    w, mean, gap, steps, variance = _net(df, features, [target], penalty, l1_ratio, intercept, tolerance, iterations)
    return ElasticNet(tuple(features), w[:, 0], float(mean[0]), gap, steps, variance)


def ridge(df: DataFrame, features: Sequence[str], target: str, penalty: float = 1.0, **kw) -> ElasticNet:
    return elastic_net(df, features, target, penalty, 0.0, **kw)


def lasso(df: DataFrame, features: Sequence[str], target: str, penalty: float = 1.0, **kw) -> ElasticNet:
    return elastic_net(df, features, target, penalty, 1.0, **kw)


def multi_task_elastic_net(df: DataFrame, features: Sequence[str], targets: Sequence[str], penalty: float = 1.0, l1_ratio: float = 0.5, intercept: bool = True, tolerance: float = 1e-4, iterations: int = 1000) -> MultiTaskElasticNet:
    """Rows of weights shrink together over all targets."""
    return MultiTaskElasticNet(tuple(features), tuple(targets), *_net(df, features, targets, penalty, l1_ratio, intercept, tolerance, iterations))


# Least angle regression


@dataclass(frozen=True)
class Lars(LinearModel):
    alphas: tuple[float, ...] = ()
    path: np.ndarray | None = None
    active: tuple[int, ...] = ()
    n_iter: int = 0


def lars(df: DataFrame, features: Sequence[str], target: str, intercept: bool = True, n_nonzero: int = 500, eps: float = np.finfo(float).eps) -> Lars:
    """The path of coefficients from the Gram matrix.

    Features aren't centred.  A step that would carry a coefficient through
    zero flips its sign and lets the next step add no feature, as in the
    original.
    """
    require(n_nonzero > 0, "at least one coefficient")
    require(eps >= 0, "eps is not negative")
    m = moments(df, [*features, target])
    mean = float(m.mean[m.at([target])[0]]) if intercept else 0.0
    gram = m.raw(features, features)
    cov = m.raw(features, [target])[:, 0] - mean * m.n * m.mean[m.at(features)]
    d, tiny = len(features), np.finfo(float).tiny
    active: list[int] = []
    signs: list[float] = []
    barred: set[int] = set()
    coef, path, alphas = np.zeros(d), [np.zeros(d)], []
    flipped = False
    while True:
        free = [j for j in range(d) if j not in active]
        open_ = [j for j in free if j not in barred]
        top = max(open_, key=lambda j: abs(cov[j])) if open_ else None
        c = abs(cov[top]) if top is not None else 0.0
        alphas.append(c / m.n)
        if alphas[-1] <= np.finfo(float).eps or len(path) > min(n_nonzero, d) and len(active) >= d or len(path) - 1 >= n_nonzero or len(active) >= d:
            break
        if not flipped:
            trial = [*active, top]
            a = gram[np.ix_(active, active)]
            v = gram[active, top]
            left = gram[top, top] - (v @ np.linalg.solve(a, v) if active else 0.0)
            if math.sqrt(abs(left)) < 1e-7:
                barred.add(top)  # it depends on the active ones
                cov[top] = 0.0
                alphas.pop()
                if len(barred) == len(free):
                    alphas.append(0.0)
                    break
                continue
            active = trial
            signs.append(float(np.sign(cov[top])))
        s = np.array(signs)
        g = gram[np.ix_(active, active)]
        direction = np.linalg.solve(g + eps * np.eye(len(active)), s)
        scale = 1 / math.sqrt(max(float(direction @ s), eps))
        direction = direction * scale
        rest = [j for j in range(d) if j not in active]
        move = gram[np.ix_(rest, active)] @ direction
        options = [c / scale]
        for j, u in zip(rest, move):
            if j in barred:
                continue
            for up, down in ((c - cov[j], scale - u + tiny), (c + cov[j], scale + u + tiny)):
                if down and up / down > 0:
                    options.append(up / down)
        gamma = min(options)
        cross = -coef[active] / (direction + tiny)
        flipped = False
        if (cross > 0).any() and cross[cross > 0].min() < gamma:
            for k in np.flatnonzero(cross == cross[cross > 0].min()):
                signs[k] = -signs[k]
            flipped = True
        coef = coef.copy()
        coef[active] += gamma * direction
        path.append(coef)
        cov = cov - gamma * (gram[:, active] @ direction)
    return Lars(tuple(features), coef, mean, tuple(alphas), np.array(path).T, tuple(active), len(path) - 1)


# Isotonic regression


@dataclass(frozen=True)
class Isotonic:
    """Knots (x ascending or descending with the direction, y) between which predictions are linear."""

    feature: str
    x: np.ndarray
    y: np.ndarray

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        from .moments import with_numbers

        order = np.argsort(self.x, kind="stable")
        x, y = self.x[order], self.y[order]
        return with_numbers(df, [self.feature], lambda v: np.interp(v[:, 0], x, y), [name])


def isotonic(df: DataFrame, feature: str, target: str, weight: str | None = None) -> Isotonic:
    """Weighted pooling of adjacent violators, rising or falling with the sign of the correlation.

    Equal feature values are pooled first, by an aggregate; ranges of the
    feature are then pooled in parallel, and only the blocks that are left meet
    on the driver.  A block's knot is the greatest feature value in it.
    """
    x, y = F.col(f"`{feature}`").cast("double"), F.col(f"`{target}`").cast("double")
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(1.0)
    rows = df.select(x.alias("x"), y.alias("y"), w.alias("w")).filter("x is not null and y is not null")
    rho, n = rows.agg(F.corr("x", "y"), F.count("x")).first()
    require(n > 0, "no rows", NotEnoughSamples)
    rising = rho is None or math.isnan(rho) or rho >= 0
    means = rows.groupBy("x").agg(F.sum("w").alias("w"), (F.sum(F.col("w") * F.col("y")) / F.sum("w")).alias("y"))
    sign = 1.0 if rising else -1.0
    ordered = means.withColumn("key", F.col("x") * sign)
    parts = indexed(ordered, ["key"], "at").withColumn("part", F.floor(F.col("at") / 50_000))

    def pool(pdf):
        import pandas as pd

        pdf = pdf.sort_values("key")
        bx, by, bw = pooled(pdf["x"].to_numpy(), pdf["y"].to_numpy() * 1.0, pdf["w"].to_numpy())
        return pd.DataFrame({"part": pdf["part"].iloc[0], "x": bx, "y": by, "w": bw})

    blocks = parts.groupBy("part").applyInPandas(pool, "part bigint, x double, y double, w double").toPandas()
    blocks = blocks.iloc[np.lexsort((blocks["x"] * sign, blocks["part"]))]
    bx, by, _ = pooled(blocks["x"].to_numpy(), blocks["y"].to_numpy(), blocks["w"].to_numpy())
    return Isotonic(feature, bx, by)


def pooled(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Blocks of rising means over ordered rows: (greatest x, mean, weight)."""
    tops: list[float] = []
    means: list[float] = []
    weights: list[float] = []
    for a, b, c in zip(x.tolist(), y.tolist(), w.tolist()):
        while means and means[-1] >= b:
            b = (means[-1] * weights[-1] + b * c) / (weights[-1] + c)
            c += weights[-1]
            a = max(a, tops[-1])
            tops.pop(), means.pop(), weights.pop()
        tops.append(a), means.append(b), weights.append(c)
    return np.array(tops), np.array(means), np.array(weights)


# Newton steps over all rows


def newton(pass_: Callable[[np.ndarray], tuple[float, np.ndarray, np.ndarray]], start: np.ndarray, tolerance: float, iterations: int) -> tuple[np.ndarray, int]:
    """Minimise by Newton steps with halving; each call of ``pass_`` is one scan (value, gradient, Hessian)."""
    at = start
    value, grad, hess = pass_(at)
    for i in range(iterations):
        if np.sqrt(grad @ grad) < tolerance:
            return at, i
        ridge_ = 1e-10 * max(1.0, float(np.abs(np.diag(hess)).max()))
        step = np.linalg.lstsq(hess + ridge_ * np.eye(len(at)), grad, rcond=None)[0]
        scale = 1.0
        while True:
            trial = at - scale * step
            new = pass_(trial)
            if np.isfinite(new[0]) and new[0] <= value + 1e-12 * abs(value):
                break
            scale /= 2
            if scale < 1e-10:
                return at, i  # no descent left within the precision of the sums
        moved = abs(value - new[0])
        at, (value, grad, hess) = trial, new
        if moved <= 1e-15 * max(1.0, abs(value)):
            return at, i + 1
    return at, iterations


# Generalised linear models


LINKS: dict[str, tuple[Callable, Callable]] = {
    # inverse and its derivative
    "identity": (lambda e: e, lambda e: np.ones_like(e)),
    "log": (lambda e: np.exp(np.minimum(e, 700)), lambda e: np.exp(np.minimum(e, 700))),
    "logit": (lambda e: 1 / (1 + np.exp(-np.clip(e, -700, 700))), lambda e: 1 / (2 + np.exp(-np.clip(e, -350, 350)) + np.exp(np.clip(e, -350, 350)))),
}


def _second(link: str, e: np.ndarray) -> np.ndarray:
    if link == "identity":
        return np.zeros_like(e)
    if link == "log":
        return np.exp(np.minimum(e, 700))
    p = LINKS["logit"][0](e)
    return p * (1 - p) * (1 - 2 * p)


def _linked(link: str, mean: float) -> float:
    return {"identity": lambda m: m, "log": math.log, "logit": lambda m: math.log(m / (1 - m))}[link](mean)


def deviance(y: np.ndarray, mu: np.ndarray, power: float) -> np.ndarray:
    """Unit deviances of the Tweedie family."""
    if power == 0:
        return (y - mu) ** 2
    if abs(power - 1) < 1e-6:
        with np.errstate(divide="ignore", invalid="ignore"):
            return 2 * np.where(y == 0, 0.0, y * np.log(y / mu)) - 2 * y + 2 * mu
    if abs(power - 2) < 1e-6:
        return 2 * (np.log(mu / y) + y / mu - 1)
    first = (np.maximum(y, 0) if power < 0 else y) ** (2 - power) / ((1 - power) * (2 - power))
    return 2 * (first - y * mu ** (1 - power) / (1 - power) + mu ** (2 - power) / (2 - power))


@dataclass(frozen=True)
class Tweedie(LinearModel):
    link: str = "log"
    n_iter: int = 0

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        e = self.score()
        out = {"identity": e, "log": F.exp(e), "logit": vec.sigmoid(e)}[self.link]
        return df.withColumn(name, out)


def tweedie(df: DataFrame, features: Sequence[str], target: str, power: float = 1.0, alpha: float = 1.0, link: str | None = None, intercept: bool = True, tolerance: float = 1e-4, iterations: int = 100) -> Tweedie:
    """Minimise half of (summed deviance + alpha |w|^2); the intercept isn't penalised.

    The deviance of power 1 is the full Poisson one; the original leaves a
    factor of 2 off two of its terms in the value but not in the gradient,
    so both have the same minimum.
    """
    require(not 0 < power < 1, f"no distribution has power {power}")
    require(alpha >= 0, "alpha is not negative")
    link = link or ("identity" if power <= 0 else "log")
    require(link in LINKS, f"no such link: {link}")
    y = F.col(f"`{target}`").cast("double")
    n, mean, least = df.agg(F.count(y), F.avg(y), F.min(y)).first()
    require(n > 0, "no rows", NotEnoughSamples)
    if power >= 1:
        require(least >= 0 if power < 2 else least > 0, f"targets out of the range of power {power}", InvalidLabels)
    d, one = len(features), int(intercept)
    inverse, derivative = LINKS[link]

    def pass_(p: np.ndarray):
        def part(rows: np.ndarray) -> np.ndarray:
            x = np.column_stack([np.ones(len(rows)), rows[:, :d]]) if one else rows[:, :d]
            t = rows[:, d]
            e = x @ p
            with np.errstate(all="ignore"):
                mu = inverse(e)
                dev = deviance(t, mu, power)
                if power != 0 and (mu <= 0).any():
                    dev = np.where(mu > 0, dev, np.inf)
                slope, bend = derivative(e), _second(link, e)
                dd = -2 * (t - mu) / mu**power  # derivative of the deviance by the mean
                d2 = 2 * mu**-power + 2 * power * (t - mu) * mu ** (-power - 1)
                first, second = dd * slope, d2 * slope**2 + dd * bend
                expected = 2 * mu**-power * slope**2
            second = np.where(second > 0, second, expected)  # keeps the steps downhill
            h = (x * second[:, None]).T @ x
            return np.concatenate([[dev.sum()], first @ x, h.ravel()])

        size = d + one
        total = summed(df, [*features, target], part, 1 + size + size * size)
        pen = np.concatenate([np.zeros(one), np.full(d, alpha)])
        value = 0.5 * (total[0] + (pen * p * p).sum())
        return value, 0.5 * total[1 : 1 + size] + pen * p, 0.5 * total[1 + size :].reshape(size, size) + np.diag(pen)

    start = np.zeros(d + one)
    if one:
        start[0] = _linked(link, mean)
    p, steps = newton(pass_, start, tolerance, iterations)
    return Tweedie(tuple(features), p[one:], float(p[0]) if one else 0.0, link, steps)


# Logistic regression


@dataclass(frozen=True)
class Logistic(LinearModel):
    classes: tuple = (False, True)
    threshold: float = 0.5

    def probability(self) -> Column:
        """Of the second class."""
        return vec.sigmoid(self.score())

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, F.when(self.probability() >= self.threshold, F.lit(self.classes[1])).otherwise(F.lit(self.classes[0])))

    def predict_probabilities(self, df: DataFrame, name: str = "probability") -> DataFrame:
        return df.withColumn(name, self.probability())


def _classes(df: DataFrame, features: Sequence[str], target: str, alpha: float, tolerance: float) -> list:
    require(alpha >= 0, "alpha is not negative")
    require(tolerance > 0, "the tolerance is positive")
    bad = None
    for c in vec.columns(features):
        b = F.isnan(c) | (F.abs(c) == float("inf"))
        bad = b if bad is None else bad | b
    row = df.agg(F.collect_set(F.col(f"`{target}`")), F.count_if(bad)).first()
    require(row[1] == 0, "features hold values that aren't finite", InvalidLabels)
    return sorted(row[0])


def logistic(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, intercept: bool = True, tolerance: float = 1e-4, iterations: int = 100, threshold: float = 0.5) -> Logistic:
    """Minimise the summed log loss + alpha/2 |w|^2; the greater class is the positive one."""
    classes = _classes(df, features, target, alpha, tolerance)
    require(len(classes) == 2, f"{len(classes)} classes where there must be two", InvalidLabels)
    rows = df.withColumn("_y", (F.col(f"`{target}`") == F.lit(classes[1])).cast("double"))
    d, one = len(features), int(intercept)
    size = d + one

    def pass_(p: np.ndarray):
        def part(block: np.ndarray) -> np.ndarray:
            x = np.column_stack([np.ones(len(block)), block[:, :d]]) if one else block[:, :d]
            e = x @ p
            q = 1 / (1 + np.exp(-np.clip(e, -500, 500)))
            loss = np.logaddexp(0, e) - block[:, d] * e
            return np.concatenate([[loss.sum()], (q - block[:, d]) @ x, ((x * (q * (1 - q))[:, None]).T @ x).ravel()])

        total = summed(rows, [*features, "_y"], part, 1 + size + size * size)
        pen = np.concatenate([np.zeros(one), np.full(d, alpha)])
        return total[0] + 0.5 * (pen * p * p).sum(), total[1 : 1 + size] + pen * p, total[1 + size :].reshape(size, size) + np.diag(pen)

    p, _ = newton(pass_, np.zeros(size), tolerance, iterations)
    return Logistic(tuple(features), p[one:], float(p[0]) if one else 0.0, tuple(classes), threshold)


@dataclass(frozen=True)
class MultiLogistic:
    features: tuple[str, ...]
    classes: tuple
    weights: np.ndarray
    intercepts: np.ndarray

    def scores(self) -> list[Column]:
        x = vec.columns(self.features)
        return [vec.affine(x, self.weights[:, j], self.intercepts[j]) for j in range(len(self.classes))]

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return df.withColumn(name, vec.argmax(self.scores(), self.classes))

    def predict_probabilities(self, df: DataFrame, name: str = "probabilities") -> DataFrame:
        return df.withColumn("_scores", F.array(*self.scores())).withColumn(name, vec.softmax(F.col("_scores"))).drop("_scores")


def multi_logistic(df: DataFrame, features: Sequence[str], target: str, alpha: float = 1.0, intercept: bool = True, tolerance: float = 1e-4, iterations: int = 100) -> MultiLogistic:
    """Softmax over all classes with the same penalty; intercepts are centred, as they are defined up to a shift."""
    classes = _classes(df, features, target, alpha, tolerance)
    require(len(classes) > 1, "there must be two classes at least", InvalidLabels)
    k, d, one = len(classes), len(features), int(intercept)
    code = F.lit(0)
    for i, c in enumerate(classes):
        code = F.when(F.col(f"`{target}`") == F.lit(c), i).otherwise(code)
    rows = df.withColumn("_y", code.cast("double"))
    m = d + one
    size = m * k

    def pass_(p: np.ndarray):
        w = p.reshape(m, k)

        def part(block: np.ndarray) -> np.ndarray:
            x = np.column_stack([np.ones(len(block)), block[:, :d]]) if one else block[:, :d]
            y = block[:, d].astype(int)
            e = x @ w
            e = e - e.max(axis=1, keepdims=True)
            z = np.log(np.exp(e).sum(axis=1))
            q = np.exp(e - z[:, None])
            loss = (z - e[np.arange(len(y)), y]).sum()
            r = q.copy()
            r[np.arange(len(y)), y] -= 1
            h = np.zeros((m, k, m, k))
            for a in range(k):
                for b in range(a, k):
                    v = q[:, a] * ((a == b) - q[:, b])
                    h[:, a, :, b] = h[:, b, :, a] = (x * v[:, None]).T @ x
            return np.concatenate([[loss], (x.T @ r).ravel(), h.ravel()])

        total = summed(rows, [*features, "_y"], part, 1 + size + size * size)
        pen = np.zeros((m, k))
        pen[one:] = alpha
        pen = pen.ravel()
        return total[0] + 0.5 * (pen * p * p).sum(), total[1 : 1 + size] + pen * p, total[1 + size :].reshape(size, size) + np.diag(pen)

    p, _ = newton(pass_, np.zeros(size), tolerance, iterations)
    w = p.reshape(m, k)
    b = w[0] - w[0].mean() if one else np.zeros(k)
    return MultiLogistic(tuple(features), tuple(classes), w[one:], b)


__all__ = ["ElasticNet", "InvalidParameter", "Isotonic", "Lars", "LinearModel", "Logistic", "Moments", "MultiLogistic", "MultiTaskElasticNet", "NotConverged", "Tweedie", "deviance", "elastic_net", "isotonic", "lars", "lasso", "logistic", "multi_logistic", "multi_task_elastic_net", "newton", "ols", "pooled", "ridge", "tweedie"]
