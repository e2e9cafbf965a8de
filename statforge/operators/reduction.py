"""Dimensionality reduction.

PCA, partial least squares and canonical correlation need one pass of
sufficient statistics; ICA sums over all rows once an iteration; projections
are plain column expressions.  A diffusion map multiplies a kernel table with
a few vectors a pass.  t-SNE is one sequential optimisation, whose
neighbours are found by all tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.hashing import uniform_number
from ..errors import InvalidParameter, NotConverged, NotEnoughSamples, TooLarge, require
from ..functions import vec
from ..sources.shipping import ship
from ..sources.store import written
from .moments import moments, summed, with_numbers
from .neighbours import k_nearest, kernel_sum, vectors
from .scaling import flip_signs


def projected(df: DataFrame, features: Sequence[str], mean: np.ndarray | None, components: np.ndarray, prefix: str) -> DataFrame:
    """``df`` with a column for each row of ``components``: its product with the (centred) features."""
    shift = np.zeros(len(components)) if mean is None else -components @ mean
    x = vec.columns(features)
    return df.withColumns({f"{prefix}{j}": vec.affine(x, row, shift[j]) for j, row in enumerate(components)})


@dataclass(frozen=True)
class Pca:
    features: tuple[str, ...]
    mean: np.ndarray
    components: np.ndarray
    sigma: np.ndarray

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        return projected(df, self.features, self.mean, self.components, prefix)

    def explained_variance(self) -> np.ndarray:
        """Squared singular values over (number of components - 1), as in the original; infinite for one component."""
        with np.errstate(divide="ignore"):
            return self.sigma**2 / (len(self.sigma) - 1.0)

    def explained_variance_ratio(self) -> np.ndarray:
        """Relative to the components that were kept."""
        return self.sigma**2 / (self.sigma**2).sum()

    def inverse_transform(self, df: DataFrame, prefix: str = "pc", out: str = "back_") -> DataFrame:
        x = vec.columns([f"{prefix}{j}" for j in range(len(self.components))])
        return df.withColumns({f"{out}{f}": vec.affine(x, self.components[:, i], self.mean[i]) for i, f in enumerate(self.features)})


def pca(df: DataFrame, features: Sequence[str], size: int, whiten: bool = False) -> Pca:
    """Leading directions of the centred rows; each has its largest entry positive."""
    require(0 < size <= len(features), f"{len(features)} features can't give {size} components")
    m = moments(df, features)
    values, vectors_ = np.linalg.eigh(m.scatter)
    order = np.argsort(-values)[:size]
    v = vectors_[:, order] * flip_signs(vectors_[:, order])
    sigma = np.maximum(np.sqrt(np.maximum(values[order], 0)), 1e-8)
    comp = v.T * (math.sqrt(m.n - 1) / sigma)[:, None] if whiten else v.T
    return Pca(tuple(features), m.mean, comp, sigma)


# Random projections


def least_dimensions(rows: int, eps: float) -> int:
    """The Johnson-Lindenstrauss bound for distances within 1 +- eps."""
    require(0 < eps < 1, "eps is between 0 and 1")
    return int(4 * math.log(rows) / (eps**2 / 2 - eps**3 / 3))


@dataclass(frozen=True)
class Projection:
    features: tuple[str, ...]
    matrix: np.ndarray

    def transform(self, df: DataFrame, prefix: str = "rp") -> DataFrame:
        return projected(df, self.features, None, self.matrix.T, prefix)


def random_projection(df: DataFrame, features: Sequence[str], kind: str = "gaussian", dimensions: int | None = None, eps: float | None = 0.1, seed: int = 42) -> Projection:
    """Gaussian numbers of deviation 1/sqrt(features), or +-sqrt(features) with probability 1/sqrt(features)."""
    require(kind in ("gaussian", "sparse"), f"no such projection: {kind}")
    if dimensions is None:
        dimensions = least_dimensions(df.count(), eps)
    require(dimensions > 0, "there is at least one dimension")
    d = len(features)
    require(dimensions <= d, f"{dimensions} dimensions are more than the {d} there are")
    u = np.array([[[uniform_number(seed, i, j, k) for k in range(2)] for j in range(dimensions)] for i in range(d)]).reshape(d, dimensions, 2)
    if kind == "gaussian":
        m = np.sqrt(-2 * np.log(u[..., 0])) * np.cos(2 * np.pi * u[..., 1]) / math.sqrt(d)
    else:
        m = np.where(u[..., 0] < 1 / math.sqrt(d), np.where(u[..., 1] < 0.5, 1, -1) * math.sqrt(d), 0.0)
    return Projection(tuple(features), m)


# Independent components


@dataclass(frozen=True)
class FastIca:
    features: tuple[str, ...]
    mean: np.ndarray
    components: np.ndarray
    n_iter: int

    def predict(self, df: DataFrame, prefix: str = "ic") -> DataFrame:
        return projected(df, self.features, self.mean, self.components, prefix)


def _decorrelated(w: np.ndarray) -> np.ndarray:
    values, vectors_ = np.linalg.eigh(w @ w.T)
    root = np.sqrt(np.maximum(values, 0))
    return (vectors_ / np.where(root < 1e-7, 1e-7, root)) @ vectors_.T @ w


def fast_ica(df: DataFrame, features: Sequence[str], size: int | None = None, function: str = "logcosh", alpha: float = 1.0, iterations: int = 200, tolerance: float = 1e-4, seed: int = 42) -> FastIca:
    """Symmetric fixed-point iterations, one pass over all rows each.

    The slope of logcosh is alpha (1 - x^2) of the unsquashed x, as in the
    original; ``logcosh_textbook`` has that of tanh.
    """
    require(function in ("logcosh", "logcosh_textbook", "exp", "cube"), f"no such function: {function}")
    require(1 <= alpha <= 2, "alpha is between 1 and 2")
    require(tolerance > 0, "the tolerance is positive")
    m = moments(df, features)
    d = len(features)
    size = size or min(d, int(m.n))
    require(size <= min(d, m.n), "more components than features or rows")
    values, vectors_ = np.linalg.eigh(m.scatter)
    order = np.argsort(-values)[:size]
    k = (vectors_[:, order] * flip_signs(vectors_[:, order]) / np.sqrt(np.maximum(values[order], 1e-16))).T * math.sqrt(m.n)
    w = _decorrelated(np.random.default_rng(seed).random((size, size)))
    mean = m.mean

    def shape(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if function == "cube":
            return x**3, 3 * x**2
        if function == "exp":
            e = np.exp(-(x**2) / 2)
            return x * e, (1 - x**2) * e
        g = np.tanh(alpha * x)
        return g, alpha * (1 - (g**2 if function == "logcosh_textbook" else x**2))

    steps = 0
    for steps in range(1, iterations + 1):
        now = w

        def part(x: np.ndarray, now: np.ndarray = now) -> np.ndarray:
            z = (x - mean) @ k.T
            g, slope = shape(z @ now.T)
            return np.concatenate([(g.T @ z).ravel(), slope.sum(axis=0)])

        total = summed(df, features, part, size * size + size) / m.n
        new = _decorrelated(total[: size * size].reshape(size, size) - w * total[size * size :][:, None])
        change = float(np.abs(np.abs((new * w).sum(axis=1)) - 1).max())
        w = new
        if change < tolerance:
            break
    return FastIca(tuple(features), mean, w @ k, steps)


# Partial least squares


@dataclass(frozen=True)
class Pls:
    features: tuple[str, ...]
    targets: tuple[str, ...]
    x_mean: np.ndarray
    x_std: np.ndarray
    y_mean: np.ndarray
    y_std: np.ndarray
    x_weights: np.ndarray
    y_weights: np.ndarray
    x_loadings: np.ndarray
    y_loadings: np.ndarray
    x_rotations: np.ndarray
    y_rotations: np.ndarray
    coefficients: np.ndarray

    def predict(self, df: DataFrame, prefix: str = "prediction_") -> DataFrame:
        """((x - mean) / deviation) times the coefficients, plus the targets' means."""
        w = self.coefficients / self.x_std[:, None]
        x = vec.columns(self.features)
        return df.withColumns({f"{prefix}{t}": vec.affine(x, w[:, j], self.y_mean[j] - self.x_mean @ w[:, j]) for j, t in enumerate(self.targets)})

    def transform(self, df: DataFrame, x_prefix: str = "xs", y_prefix: str = "ys") -> DataFrame:
        a, b = (self.x_rotations / self.x_std[:, None]).T, (self.y_rotations / self.y_std[:, None]).T
        return projected(projected(df, self.features, self.x_mean, a, x_prefix), self.targets, self.y_mean, b, y_prefix)

    def inverse_transform(self, df: DataFrame, x_prefix: str = "xs", y_prefix: str = "ys", out: str = "back_") -> DataFrame:
        n = self.x_loadings.shape[1]
        xs, ys = vec.columns([f"{x_prefix}{j}" for j in range(n)]), vec.columns([f"{y_prefix}{j}" for j in range(n)])
        back = {f"{out}{f}": vec.affine(xs, self.x_loadings[i] * self.x_std[i], self.x_mean[i]) for i, f in enumerate(self.features)}
        back |= {f"{out}{t}": vec.affine(ys, self.y_loadings[i] * self.y_std[i], self.y_mean[i]) for i, t in enumerate(self.targets)}
        return df.withColumns(back)


def _pinv(x: np.ndarray) -> np.ndarray:
    return np.linalg.pinv(x, rcond=max(x.shape) * np.finfo(float).eps)


def _scaled_moments(df: DataFrame, features: Sequence[str], targets: Sequence[str], scale: bool):
    m = moments(df, [*features, *targets])
    require(m.n >= 2, "there are two rows at least", NotEnoughSamples)
    p = len(features)
    std = np.sqrt(np.diag(m.scatter) / (m.n - 1)) if scale else np.ones(len(m.mean))
    std = np.where(std == 0, 1.0, std)
    return m, m.scatter / np.outer(std, std), m.mean[:p], std[:p], m.mean[p:], std[p:]


def pls(df: DataFrame, features: Sequence[str], targets: Sequence[str], components: int, scale: bool = True, deflation: str = "regression", mode: str = "A", algorithm: str = "nipals", iterations: int = 500, tolerance: float = 1e-6) -> Pls:
    """Partial least squares from the joint covariance alone.

    Scores are never formed: deflating rows by a score is a projection of the
    columns, so every product of the power iteration follows from the
    covariance.  ``canonical`` deflation with mode A is canonical PLS, with
    mode B canonical correlation.
    """
    require(deflation in ("regression", "canonical") and mode in ("A", "B") and algorithm in ("nipals", "svd"), "no such variant")
    require(tolerance >= 0, "a tolerance is not negative")
    m, s, x_mean, x_std, y_mean, y_std = _scaled_moments(df, features, targets, scale)
    p, q = len(features), len(targets)
    bound = p if deflation == "regression" else int(min(m.n, p, q))
    require(1 <= components <= bound, f"components are between 1 and {bound}")
    xx, xy, yy = s[:p, :p].copy(), s[:p, p:].copy(), s[p:, p:].copy()
    out = {n: [] for n in ("xw", "yw", "xl", "yl")}
    normed = deflation == "canonical"
    eps = np.finfo(float).eps
    for _ in range(components):
        if algorithm == "svd":
            u, sv, vt = np.linalg.svd(xy, full_matrices=False)
            a, b = u[:, 0], vt[0]
        else:
            usable = np.flatnonzero(np.diag(yy) > (10 * eps) ** 2 * m.n)
            require(bool(len(usable)), "nothing is left of the targets", NotConverged)
            score = np.zeros(q)
            score[usable[0]] = 1.0  # a score as a combination of targets
            old, done = np.full(p, 100.0), False
            inv_x, inv_y = (np.linalg.pinv(xx, rcond=1e-12), np.linalg.pinv(yy, rcond=1e-12)) if mode == "B" else (None, None)
            for _step in range(iterations - 1):
                a = xy @ score
                a = inv_x @ a if mode == "B" else a / (score @ yy @ score)
                a = a / (np.sqrt(a @ a) + eps)
                b = xy.T @ a
                b = inv_y @ b if mode == "B" else b / (a @ xx @ a)
                if normed:
                    b = b / (np.sqrt(b @ b) + eps)
                score = b / (b @ b + eps)
                if (a - old) @ (a - old) < tolerance or q == 1:
                    done = True
                    break
                old = a
            require(done, f"the power iteration didn't settle in {iterations} steps", NotConverged)
        sign = np.sign(a[np.abs(a).argmax()])
        a, b = a * sign, b * sign
        size_b = 1.0 if normed else b @ b
        tt = a @ xx @ a
        xl = xx @ a / tt
        if deflation == "canonical":
            c = b / size_b
            uu = c @ yy @ c
            yl = yy @ c / uu
            left, right = np.eye(p) - np.outer(xl, a), np.eye(q) - np.outer(yl, c)
            # x - t p' and y - u d' with t = x a, u = y c
            xx, xy, yy = left @ xx @ left.T, left @ xy @ right.T, right @ yy @ right.T
        else:
            yl = xy.T @ a / tt
            left = np.eye(p) - np.outer(xl, a)
            yy = yy - np.outer(yl, xy.T @ a) - np.outer(xy.T @ a, yl) + tt * np.outer(yl, yl)
            xy = left @ (xy - np.outer(xx @ a, yl))
            xx = left @ xx @ left.T
        for name, v in zip(out, (a, b, xl, yl)):
            out[name].append(v)
    xw, yw, xl, yl = (np.array(out[n]).T for n in ("xw", "yw", "xl", "yl"))
    xr, yr = xw @ _pinv(xl.T @ xw), yw @ _pinv(yl.T @ yw)
    return Pls(tuple(features), tuple(targets), x_mean, x_std, y_mean, y_std, xw, yw, xl, yl, xr, yr, xr @ yl.T * y_std)


def pls_regression(df: DataFrame, features: Sequence[str], targets: Sequence[str], components: int, **kw) -> Pls:
    return pls(df, features, targets, components, deflation="regression", mode="A", **kw)


def pls_canonical(df: DataFrame, features: Sequence[str], targets: Sequence[str], components: int, **kw) -> Pls:
    return pls(df, features, targets, components, deflation="canonical", mode="A", **kw)


def pls_cca(df: DataFrame, features: Sequence[str], targets: Sequence[str], components: int, **kw) -> Pls:
    return pls(df, features, targets, components, deflation="canonical", mode="B", **kw)


@dataclass(frozen=True)
class PlsSvd:
    features: tuple[str, ...]
    targets: tuple[str, ...]
    x_mean: np.ndarray
    x_std: np.ndarray
    y_mean: np.ndarray
    y_std: np.ndarray
    x_weights: np.ndarray
    y_weights: np.ndarray

    def transform(self, df: DataFrame, x_prefix: str = "xs", y_prefix: str = "ys") -> DataFrame:
        a, b = (self.x_weights / self.x_std[:, None]).T, (self.y_weights / self.y_std[:, None]).T
        return projected(projected(df, self.features, self.x_mean, a, x_prefix), self.targets, self.y_mean, b, y_prefix)


def pls_svd(df: DataFrame, features: Sequence[str], targets: Sequence[str], components: int = 2, scale: bool = True) -> PlsSvd:
    """Singular vectors of the cross covariance; each x vector has its largest entry positive."""
    m, s, x_mean, x_std, y_mean, y_std = _scaled_moments(df, features, targets, scale)
    p, q = len(features), len(targets)
    bound = int(min(m.n, p, q))
    require(1 <= components <= bound, f"components are between 1 and {bound}")
    u, _, vt = np.linalg.svd(s[:p, p:], full_matrices=False)
    u, v = u[:, :components], vt[:components].T
    signs = flip_signs(u)
    return PlsSvd(tuple(features), tuple(targets), x_mean, x_std, y_mean, y_std, u * signs, v * signs)


# Diffusion maps


@dataclass(frozen=True)
class DiffusionMap:
    """embedding: a table (i, dm0, dm1, ...)."""

    embedding: DataFrame
    eigenvalues: np.ndarray

    def estimate_clusters(self) -> int:
        return int((self.eigenvalues > self.eigenvalues.mean()).sum()) + 1


def diffusion_map(kernel: DataFrame, size: int, steps: int = 1, iterations: int = 60, tolerance: float = 1e-9, seed: int = 31) -> DiffusionMap:
    """Leading eigenvectors of the kernel scaled by its row sums on both sides, without the first.

    Block Krylov steps with restarts: the kernel stays a table, cut once by
    rows, and each of at most ``iterations`` products is one pass without a
    shuffle.  The driver holds some tens of vectors as long as the points.
    It ends when the eigenvalues move by less than ``tolerance`` and the
    residuals are below its root.
    Vectors are scaled by the root of the inverse row sums and by the
    eigenvalues to the power of ``steps``; each has its largest entry positive.
    """
    require(steps > 0, "there is at least one step")
    require(size > 0, "there is at least one component")
    spark = kernel.sparkSession
    ship(spark)
    kernel = written(kernel.select("i", "j", "value"), "kernel")
    sums = kernel_sum(kernel).orderBy("i").toArrow()
    n = len(sums)
    require(size < n, "more components than points")
    ids, total = sums.column("i"), sums.column("total").to_numpy()
    places = spark.createDataFrame(pa.table({"id": ids, "place": pa.array(np.arange(n))}))
    edges = kernel.join(places.select(F.col("id").alias("i"), F.col("place").alias("a")), "i").join(places.select(F.col("id").alias("j"), F.col("place").alias("b")), "j")
    tasks = max(spark.sparkContext.defaultParallelism, -(-kernel.count() // 2_000_000))
    edges = written(edges.select("a", "b", F.col("value").cast("double").alias("value")).repartition(tasks, "a"), "edges")
    root = np.sqrt(total)

    def times(v: np.ndarray) -> np.ndarray:
        shipped, width = spark.sparkContext.broadcast(v / root[:, None]), v.shape[1]
        names = [f"v{k}" for k in range(width)]

        def products(a: list, b: list, value: list) -> pa.RecordBatch:
            at, own = np.unique(np.concatenate(a), return_inverse=True)
            b, value, x = np.concatenate(b), np.concatenate(value), shipped.value
            return pa.RecordBatch.from_arrays([pa.array(at), *[pa.array(np.bincount(own, value * x[b, k], len(at))) for k in range(width)]], names=["a", *names])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, rows = ([], [], []), 0
            for batch in batches:
                if len(batch):
                    for part, c in zip(held, batch.columns):
                        part.append(c.to_numpy(zero_copy_only=False))
                    rows += len(batch)
                if rows >= 1_000_000:
                    yield products(*held)
                    held, rows = ([], [], []), 0
            if rows:
                yield products(*held)

        got = edges.mapInArrow(run, "a bigint, " + ", ".join(f"{c} double" for c in names)).toArrow()
        shipped.destroy()
        at = got.column("a").to_numpy()
        return np.stack([np.bincount(at, got.column(c).to_numpy(), n) for c in names], axis=1) / root[:, None]

    block, deep = min(n, size + 4), 4  # a few more settle sooner
    x = np.linalg.qr(np.random.default_rng(seed).normal(size=(n, block)))[0]
    ax, used = times(x), 1
    old = np.zeros(block)
    while True:
        basis, images = x, ax
        for _ in range(deep - 1):
            if used >= iterations or basis.shape[1] >= n:
                break
            new = images[:, -block:]
            length = np.linalg.norm(new, axis=0)
            for _ in range(2):
                new = new - basis @ (basis.T @ new)
            u, s, _ = np.linalg.svd(new, full_matrices=False)
            new = u[:, s > 1e-12 * length.max()][:, : n - basis.shape[1]]
            new = new - basis @ (basis.T @ new)
            if not new.shape[1]:
                break
            new = np.linalg.qr(new)[0]
            basis, images, used = np.column_stack([basis, new]), np.column_stack([images, times(new)]), used + 1
        values, turn = np.linalg.eigh((basis.T @ images + images.T @ basis) / 2)
        values, turn = values[::-1][:block], turn[:, ::-1][:, :block]
        x, ax = basis @ turn, images @ turn
        rest = np.linalg.norm(ax - x * values, axis=0)[: size + 1].max()
        moved = np.abs(values - old[: len(values)])[: size + 1].max()
        if used >= iterations or rest < math.sqrt(tolerance) and moved < tolerance or basis.shape[1] >= n:
            break
        old = values
    values, x = values[1 : size + 1], x[:, 1 : size + 1]
    signs = [np.sign(u[np.argmax(np.round(np.abs(u), 9))]) or 1.0 for u in x.T]
    scale = np.array([s * np.sign(lam) * abs(lam) ** steps for s, lam in zip(signs, values)])
    out = x * scale / root[:, None]
    return DiffusionMap(spark.createDataFrame(pa.table({"i": ids, **{f"dm{k}": out[:, k] for k in range(size)}})), values)


# t-SNE

#: Points of one layout: its task holds their neighbours and two grids.
MOST_EMBEDDED = 2_000_000
#: Up to so many points, or with ``theta`` 0, or in more than two dimensions, repulsion is summed over all pairs.
EXACT_REPULSION, MOST_EXACT = 1_000, 20_000


def tsne(df: DataFrame, size: int = 2, perplexity: float = 5.0, theta: float = 0.5, iterations: int = 2000, id_col: str = "vec_id", vector_col: str = "embedding", seed: int = 42) -> DataFrame:
    """(id, t0, t1, ...): one gradient descent over all points, in one task, on at most ``MOST_EMBEDDED`` rows.

    Attraction acts among 3 * perplexity neighbours, which all tasks find;
    with ``theta`` 0 among all points.  Repulsion in one or two dimensions
    goes by interpolation on a grid, in time in proportion to the points and
    to the layout's area, in cells of twice ``theta``, 1 at most; up to
    ``EXACT_REPULSION`` points, or with ``theta`` 0, it is exact.
    """
    require(perplexity > 0, "the perplexity is positive")
    require(theta >= 0, "theta is not negative")
    require(size > 0 and iterations > 0, "counts are positive")
    base = vectors(df, id_col, vector_col)
    most = MOST_EXACT if theta == 0 or size > 2 else MOST_EMBEDDED
    n = base.limit(most + 1).count()
    require(n <= most, f"more than {most} points can't be laid out in one task", TooLarge)
    require(n - 1 >= 3 * perplexity, "the perplexity is too large for the number of rows", InvalidParameter)
    kind = base.schema["id"].dataType.simpleString()
    k = n - 1 if theta == 0 else min(n - 1, int(3 * perplexity))

    def run(table):
        query, other, squared = table.column("query").to_numpy(), table.column("id").to_numpy(), table.column("distance").to_numpy() ** 2
        order = np.lexsort((table.column("rank").to_numpy(), query))
        order = order[query[order] != other[order]]
        ids, starts = np.unique(query[order], return_index=True)
        at = order[starts[:, None] + np.arange(k)]
        y = layout(np.searchsorted(ids, other[at]), squared[at], size, perplexity, theta, iterations, seed)
        return pa.table({"id": pa.array(ids, table.schema.field("query").type), **{f"t{j}": y[:, j] for j in range(size)}})

    schema = f"id {kind}, " + ", ".join(f"t{j} double" for j in range(size))
    near = k_nearest(df, df, k + 1, id_col, vector_col).withColumn("_all", F.lit(True))
    return near.groupBy("_all").applyInArrow(lambda t: run(t.drop_columns(["_all"])), schema)


def layout(near: np.ndarray, dist: np.ndarray, size: int, perplexity: float, theta: float, iterations: int, seed: int) -> np.ndarray:
    """Places of points, from each point's neighbours and their squared distances."""
    n, k = near.shape
    dist = dist - dist.min(axis=1, keepdims=True)
    low, high, beta = np.zeros(n), np.full(n, np.inf), np.ones(n)
    for _ in range(64):  # a precision for each point that gives the wanted entropy
        e = np.exp(-dist * beta[:, None])
        s = e.sum(axis=1)
        h = np.log(s) + beta * (dist * e).sum(axis=1) / s
        wide = h > math.log(perplexity)
        low, high = np.where(wide, beta, low), np.where(wide, high, beta)
        beta = np.where(np.isinf(high), beta * 2, (low + high) / 2)
    own, p = np.repeat(np.arange(n), k), (e / s[:, None]).ravel() / (2 * n)
    # each pair once, with the share of both sides
    pair, place = np.unique(np.minimum(own, near.ravel()) * n + np.maximum(own, near.ravel()), return_inverse=True)
    p, (a, b) = np.bincount(place, p), np.divmod(pair, n)
    y = np.random.default_rng(seed).normal(0, 1e-4, (n, size))
    step, gain = np.zeros_like(y), np.ones_like(y)
    exact, kept = n <= EXACT_REPULSION or theta == 0 or size > 2, {}
    for t in range(iterations):
        force, total = repulsion(y) if exact else grid_repulsion(y, min(1.0, 2 * theta), kept=kept)
        columns = [np.ascontiguousarray(c) for c in y.T]
        apart = [c[a] - c[b] for c in columns]
        w = p * (12 if t < min(250, iterations // 4) else 1) / (1 + sum(d * d for d in apart))
        pull = np.stack([np.bincount(a, w * d, n) - np.bincount(b, w * d, n) for d in apart], axis=1)
        grad = 4 * (pull - force / total)
        gain = np.maximum(np.where(np.sign(grad) != np.sign(step), gain + 0.2, gain * 0.8), 0.01)
        step = (0.5 if t < 250 else 0.8) * step - max(n / 12, 50) * gain * grad
        y = y + step
        y -= y.mean(axis=0)
    return y


def repulsion(y: np.ndarray) -> tuple[np.ndarray, float]:
    """Sums over all other points of (y_i - y_j) / (1 + d^2)^2, and of 1 / (1 + d^2) over all pairs."""
    force, total, length = np.empty_like(y), 0.0, (y * y).sum(axis=1)
    rows = max(1, 1_000_000 // len(y))
    for i in range(0, len(y), rows):
        own = y[i : i + rows]
        q = 1 / (1 + np.maximum(length[i : i + rows, None] + length - 2 * own @ y.T, 0))
        q[np.arange(len(own)), np.arange(i, i + len(own))] = 0
        total += q.sum()
        q *= q
        force[i : i + rows] = q.sum(axis=1)[:, None] * own - q @ y
    return force, total


def grid_repulsion(y: np.ndarray, widest: float = 1.0, nodes: int = 3, least: int = 50, kept: dict | None = None) -> tuple[np.ndarray, float]:
    """``repulsion`` in one or two dimensions, by polynomials in cells at most ``widest`` wide, whose nodes meet by Fourier transforms.

    ``kept``: the kernels' transforms of the last grid, which the next call mostly shares.
    """
    n, d = y.shape
    low = y.min(axis=0)
    cells = int(max(least, math.ceil((y.max(axis=0) - low).max() / widest)))
    # wider layouts get cells of one width, so that the kernels stay the same
    cell = widest if cells > least else max(float((y.max(axis=0) - low).max()) * (1 + 1e-9) / cells, 1e-12)
    m = cells * nodes
    own = np.minimum(((y - low) / cell).astype(np.int64), cells - 1)
    at = (y - low) / cell - own  # within the cell
    place = (np.arange(nodes) + 0.5) / nodes
    weight = np.ones((n, d, nodes))
    for j in range(nodes):
        for i in range(nodes):
            if i != j:
                weight[:, :, j] *= (at - place[i]) / (place[j] - place[i])
    if d == 1:
        index, weights = own[:, 0, None] * nodes + np.arange(nodes), weight[:, 0]
    else:
        x, z = own[:, 0, None] * nodes + np.arange(nodes), own[:, 1, None] * nodes + np.arange(nodes)
        index, weights = (x[:, :, None] * m + z[:, None, :]).reshape(n, -1), (weight[:, 0, :, None] * weight[:, 1, None, :]).reshape(n, -1)
    flat, shape, axes = index.ravel(), (m,) * d, tuple(range(d))
    long = next(v for v in range(2 * m, 4 * m + 1) if _smooth(v))
    kept = {} if kept is None else kept
    if kept.get("grid") != (long, cell, d):
        offset = np.minimum(np.arange(long), long - np.arange(long)) * (cell / nodes)
        near = 1 / (1 + (offset**2 if d == 1 else offset[:, None] ** 2 + offset[None, :] ** 2))
        kept.update(grid=(long, cell, d), first=np.fft.rfftn(near, axes=axes).real, second=np.fft.rfftn(near * near, axes=axes).real)  # even, so real
    charges = [np.ones(n), *(y - y.mean(axis=0)).T]
    spectra = [np.fft.rfftn(np.bincount(flat, (weights * c[:, None]).ravel(), m**d).reshape(shape), (long,) * d, axes=axes) for c in charges]

    def field(spectrum: np.ndarray) -> np.ndarray:
        if d == 2:
            spectrum = np.fft.ifft(spectrum, axis=0)[:m]
        return (np.fft.irfft(spectrum, long, axis=-1)[..., :m].ravel()[index] * weights).sum(axis=1)

    # the product of the masses with their field, summed over frequencies, of which all but the first and the middle one stand for two
    twice = np.full(long // 2 + 1, 2.0)
    twice[0] = 1
    if long % 2 == 0:
        twice[-1] = 1
    total = float((kept["first"] * (spectra[0].real ** 2 + spectra[0].imag ** 2) @ twice).sum()) / long**d - n
    mass = field(kept["second"] * spectra[0])
    return np.stack([charges[1 + j] * mass - field(kept["second"] * spectra[1 + j]) for j in range(d)], axis=1), max(total, 1e-300)


def _smooth(v: int) -> bool:
    """Whether a transform of this length is quick."""
    for f in (2, 3, 5):
        while v % f == 0:
            v //= f
    return v == 1
