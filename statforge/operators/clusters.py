"""Clustering.

Centroid methods run one distributed pass an iteration and keep only centroids
on the driver.  Density methods rest on distributed range queries and
connected components.  OPTICS orders points one after another and linkage
merges them one by one: both hold points and not pairs in one task, where the
kernel allows it, and say so beyond a bound.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..errors import InvalidParameter, NotConverged, NotEnoughSamples, TooLarge, require
from ..functions import vec
from ..sources.generate import uniform
from ..sources.store import written
from .moments import complete, moments, summed, with_numbers
from ..functions.pairwise import Screen, block_distance, differences
from .neighbours import dense_kernel, k_nearest, matrix, vectors, width, within_range

#: 50 MB of doubles for each million; a third again in single precision.
MOST_ORDERED = 50_000_000
MOST_LINKED = 5_000
MOST_TERMS = 128


# k-means


def _distances(x: np.ndarray, c: np.ndarray, metric: str) -> np.ndarray:
    """Reduced distances: squared for l2."""
    if metric == "l2":
        return np.stack([((x - row) ** 2).sum(axis=1) for row in c], axis=1)
    return block_distance(metric)(x, c)


@dataclass(frozen=True)
class KMeans:
    features: tuple[str, ...]
    centroids: np.ndarray
    counts: np.ndarray
    inertia: float
    n_iter: int
    metric: str = "l2"

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        """The nearest centroid, ties to the lowest."""
        if not self._short():
            c, metric = self.centroids, self.metric
            return with_numbers(df, list(self.features), lambda x: _distances(x, c, metric).argmin(axis=1), [name], "int")
        return df.withColumn(name, vec.argmax([-d for d in self._columns()], list(range(len(self.centroids)))))

    def transform(self, df: DataFrame, name: str = "distance") -> DataFrame:
        """The least reduced distance: squared for l2."""
        if not self._short():
            c, metric = self.centroids, self.metric
            return with_numbers(df, list(self.features), lambda x: _distances(x, c, metric).min(axis=1), [name])
        each = self._columns()
        return df.withColumn(name, F.least(*each) if len(each) > 1 else each[0])

    def _short(self) -> bool:
        """Whether distances are few enough terms for an expression; else numpy computes them in batches."""
        return self.metric == "l2" and self.centroids.size <= MOST_TERMS

    def _columns(self) -> list:
        x = vec.columns(self.features)
        return [vec.l2_squared(x, [F.lit(float(v)) for v in row]) for row in self.centroids]


def _check_kmeans(k: int, runs: int, tolerance: float, iterations: int) -> None:
    require(k > 0, "there is at least one cluster")
    require(runs > 0, "there is at least one run")
    require(tolerance > 0, "the tolerance is positive")
    require(iterations > 0, "there is at least one iteration")


def _pass(df: DataFrame, features: Sequence[str], c: np.ndarray, metric: str) -> tuple[np.ndarray, np.ndarray, float]:
    """Sums and counts of each centroid's rows, and the summed reduced distances."""
    k, d = c.shape

    def part(x: np.ndarray) -> np.ndarray:
        dist = _distances(x, c, metric)
        at = dist.argmin(axis=1)
        sums = np.stack([x[at == j].sum(axis=0) for j in range(k)])
        return np.concatenate([sums.ravel(), np.bincount(at, minlength=k), [dist[np.arange(len(x)), at].sum()]])

    total = summed(df, features, part, k * d + k + 1)
    return total[: k * d].reshape(k, d), total[k * d : -1], float(total[-1])


def _sampled(df: DataFrame, features: Sequence[str], k: int, seed: int) -> np.ndarray:
    """k rows, those of the smallest hashes."""
    cols = vec.columns(features)
    rows = complete(df, features).withColumn("_key", uniform(seed, *cols)).orderBy("_key").limit(k).select("_key", *features).collect()
    require(len(rows) == k, f"fewer than {k} rows", NotEnoughSamples)
    return np.array([r[1:] for r in rows], float)


def _weighted_plus_plus(x: np.ndarray, w: np.ndarray, k: int, metric: str, rng: np.random.Generator) -> np.ndarray:
    chosen = [int(rng.choice(len(x), p=w / w.sum()))]
    near = _distances(x, x[chosen], metric)[:, 0]
    while len(chosen) < k:
        p = near * w
        at = int(rng.choice(len(x), p=p / p.sum())) if p.sum() > 0 else int(rng.integers(len(x)))
        chosen.append(at)
        near = np.minimum(near, _distances(x, x[[at]], metric)[:, 0])
    return x[chosen]


def initial(df: DataFrame, features: Sequence[str], k: int, method: str, seed: int, metric: str = "l2", rounds: int = 8) -> np.ndarray:
    """``random``, ``plusplus`` (each centroid drawn by its distance, one pass each) or ``parallel``.

    ``parallel`` draws about k rows a round by their distances and then picks
    k of these, weighted by the rows nearest to each.  A draw takes the rows of
    the smallest exponential numbers of their weights, so it is one pass.
    """
    require(method in ("random", "plusplus", "parallel"), f"no such start: {method}")
    if method == "random":
        return _sampled(df, features, k, seed)
    c = _sampled(df, features, 1, seed)
    rng = np.random.default_rng(seed)
    wanted, each = (k, 1) if method == "plusplus" else (1 + k * rounds, k)
    turn = 0
    cols = vec.columns(features)
    while len(c) < wanted and turn < wanted + rounds:
        rows_now = complete(df, features)
        far = with_numbers(rows_now, list(features), lambda x, c=c: _distances(x, c, metric).min(axis=1), ["_far"]).filter("_far > 0")
        key = -F.log(uniform(seed + 1 + turn, *cols)) / F.col("_far")
        rows = far.withColumn("_key", key).orderBy("_key").limit(each).select(*features).collect()
        turn += 1
        if not rows:
            break
        c = np.concatenate([c, np.array(rows, float)])
    if method == "plusplus":
        if len(c) < k:  # fewer distinct rows than centroids
            c = np.concatenate([c, np.repeat(c[:1], k - len(c), axis=0)])
        return c
    _, weights, _ = _pass(df, features, c, metric)
    return _weighted_plus_plus(c, np.maximum(weights, 1e-12), k, metric, rng)


def kmeans(df: DataFrame, features: Sequence[str], k: int, runs: int = 10, tolerance: float = 1e-4, iterations: int = 300, init: str | np.ndarray = "plusplus", seed: int = 42, metric: str = "l2") -> KMeans:
    """Lloyd's iterations; a new centroid is the mean of its rows and of the old centroid.

    The best of several runs is kept.  Inertia is the mean reduced distance
    before the last update; the counts are of the kept run.
    """
    _check_kmeans(k, runs, tolerance, iterations)
    rows = complete(df, features)
    n = rows.count()
    require(n > 0, "no rows", NotEnoughSamples)
    best = None
    for run in range(1 if isinstance(init, np.ndarray) else runs):
        c = init.astype(float) if isinstance(init, np.ndarray) else initial(rows, features, k, init, seed + 1000 * run, metric)
        require(c.shape == (k, len(features)), "centroids of another shape", InvalidParameter)
        for i in range(1, iterations + 1):
            sums, counts, total = _pass(rows, features, c, metric)
            new = (sums + c) / (counts + 1)[:, None]
            moved = float(np.sqrt(((new - c) ** 2).sum()))
            c = new
            if moved < tolerance:
                break
        model = KMeans(tuple(features), c, counts, total / n, i, metric)
        if moved < tolerance and (best is None or model.inertia < best.inertia):
            best = model
        last = model
    if best is None:
        raise NotConverged("no run settled within the iterations", last)
    return best


def kmeans_update(model: KMeans | None, df: DataFrame, features: Sequence[str], k: int, tolerance: float = 1e-4, init: str | np.ndarray = "random", seed: int = 42, metric: str = "l2") -> tuple[KMeans, bool]:
    """One mini-batch: each centroid becomes the running mean of all rows it ever got; and whether it settled."""
    if model is None:
        c = init.astype(float) if isinstance(init, np.ndarray) else initial(df, features, k, init, seed, metric)
        model = KMeans(tuple(features), c, np.zeros(k), 0.0, 0, metric)
    sums, counts, total = _pass(df, features, model.centroids, metric)
    all_counts = model.counts + counts
    c = np.where(all_counts[:, None] > 0, (model.centroids * model.counts[:, None] + sums) / np.maximum(all_counts, 1)[:, None], model.centroids)
    moved = float(np.sqrt(((c - model.centroids) ** 2).sum()))
    return replace(model, centroids=c, counts=all_counts, inertia=total / max(1.0, counts.sum()), n_iter=model.n_iter + 1), moved < tolerance


# Gaussian mixtures


@dataclass(frozen=True)
class Mixture:
    features: tuple[str, ...]
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    lower_bound: float
    n_iter: int

    def precisions(self) -> np.ndarray:
        return np.linalg.inv(self.covariances)

    def log_parts(self, x: np.ndarray) -> np.ndarray:
        return _log_parts(x, self.weights, self.means, np.linalg.cholesky(self.covariances))

    def predict(self, df: DataFrame, name: str = "prediction") -> DataFrame:
        return with_numbers(df, list(self.features), lambda x: self.log_parts(x).argmax(axis=1), [name], "int")

    def predict_proba(self, df: DataFrame, prefix: str = "p") -> DataFrame:
        def run(x: np.ndarray) -> np.ndarray:
            e = self.log_parts(x)
            e = np.exp(e - e.max(axis=1, keepdims=True))
            return e / e.sum(axis=1, keepdims=True)

        return with_numbers(df, list(self.features), run, [f"{prefix}{j}" for j in range(len(self.weights))])


def _log_parts(x: np.ndarray, weights: np.ndarray, means: np.ndarray, chol: np.ndarray) -> np.ndarray:
    d = x.shape[1]
    out = np.empty((len(x), len(weights)))
    for j in range(len(weights)):
        z = np.linalg.solve(chol[j], (x - means[j]).T)
        out[:, j] = math.log(max(weights[j], 1e-300)) - 0.5 * (d * math.log(2 * math.pi) + (z * z).sum(axis=0)) - np.log(np.diag(chol[j])).sum()
    return out


def gaussian_mixture(df: DataFrame, features: Sequence[str], k: int, tolerance: float = 1e-3, reg: float = 1e-6, runs: int = 1, iterations: int = 100, init: str = "kmeans", seed: int = 42) -> Mixture:
    """Full covariances by expectation and maximisation, one pass an iteration.

    Further runs go on from the same model, as in the original.
    """
    require(k > 0 and runs > 0 and iterations > 0, "counts are positive")
    require(tolerance > 0 and reg >= 0, "tolerances are positive")
    require(init in ("kmeans", "random"), f"no such start: {init}")
    rows = complete(df, features)
    n, d = rows.count(), len(features)
    require(n > 0, "no rows", NotEnoughSamples)
    if init == "kmeans":
        try:
            start = kmeans(rows, features, k, runs=1, iterations=30, init="parallel", seed=seed).centroids
        except NotConverged as e:
            start = e.model.centroids
    else:
        start = initial(rows, features, k, "random", seed)

    size = 1 + k + k * d + k * d * d

    def look(resp):
        def part(x: np.ndarray) -> np.ndarray:
            r, log_norm = resp(x)
            s2 = np.stack([(x * r[:, [j]]).T @ x for j in range(k)])
            return np.concatenate([[log_norm.sum()], r.sum(axis=0), (r.T @ x).ravel(), s2.ravel()])

        return summed(rows, features, part, size)

    about = moments(rows, features).mean  # sums around the middle cost no precision

    def parameters(total: np.ndarray):
        nk = total[1 : 1 + k]
        require(bool((nk > 10 * np.finfo(float).eps).all()), f"cluster {int(nk.argmin()) + 1} is empty; take fewer", NotConverged)
        s1 = total[1 + k : 1 + k + k * d].reshape(k, d) / nk[:, None]
        s2 = total[1 + k + k * d :].reshape(k, d, d) / nk[:, None, None]
        cov = s2 - s1[:, :, None] * s1[:, None, :] + reg * np.eye(d)
        return nk / n, s1 + about, (cov + cov.transpose(0, 2, 1)) / 2

    def hard(x: np.ndarray):
        at = _distances(x, start, "l2").argmin(axis=1)
        return np.eye(k)[at], np.zeros(len(x))

    def soft(weights: np.ndarray, means: np.ndarray, cov: np.ndarray):
        chol = np.linalg.cholesky(cov)

        def resp(x: np.ndarray):
            e = _log_parts(x, weights, means, chol)
            top = e.max(axis=1, keepdims=True)
            norm = top[:, 0] + np.log(np.exp(e - top).sum(axis=1))
            return np.exp(e - norm[:, None]), norm

        return resp

    def centred(resp):
        def run(x: np.ndarray):
            return resp(x + about)

        return run

    shifted = rows.select(*[(F.col(f"`{f}`") - float(m)).alias(f) for f, m in zip(features, about)])
    rows = shifted
    w, means, cov = parameters(look(centred(hard)))
    bound, done = -math.inf, 0
    for _ in range(runs):
        for i in range(1, iterations + 1):
            total = look(centred(soft(w, means, cov)))
            new = total[0] / n
            w, means, cov = parameters(total)
            done, change, bound = i, abs(new - bound), new
            if change < tolerance:
                break
    model = Mixture(tuple(features), w, means, cov, bound, done)
    if change >= tolerance:
        raise NotConverged("the likelihood still rises", model)
    return model


# Density


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of edges (a, b), the root being the smallest node, by alternating stars."""
    now = written(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u > v").distinct(), "edges")
    state = None
    while True:
        both = now.union(now.select("v", "u").toDF("u", "v"))
        least = both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u > v").distinct()
        near = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(near, "u").select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e"))
        now = written(small.select("e.u", "e.v").filter("u > v").distinct(), "edges")
        check = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if check == state:
            break
        state = check
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).union(now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def dbscan(points: DataFrame, min_points: int, tolerance: float = 1e-4, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2", **how) -> DataFrame:
    """(id, cluster): null for noise.

    A core point has ``min_points`` points, itself included, nearer than the
    tolerance.  Clusters are numbered from 0 in the order of their first core
    point's id; a border point belongs to the earliest cluster that reaches it.
    """
    require(min_points > 1, "there are at least two points")
    require(tolerance > 0, "the tolerance is positive")
    near = written(within_range(points, points, tolerance, id_col, vector_col, metric, **how).select("query", "id"), "near")
    core = near.groupBy("query").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= min_points).select("query")
    mark = core.withColumnRenamed("query", "c")
    reached = near.join(mark, near["id"] == mark["c"], "left_semi")  # from any point to a core point
    between = reached.join(mark, reached["query"] == mark["c"], "left_semi")
    roots = components(between.filter("query < id").select(F.col("query").alias("a"), F.col("id").alias("b")))
    rooted = core.join(roots, core["query"] == roots["node"], "left").select(F.col("query").alias("node"), F.coalesce("root", "query").alias("root"))
    rooted = written(rooted, "rooted")
    ranks = rooted.select("root").distinct().withColumn("cluster", F.row_number().over(Window.orderBy("root")) - 1)  # one row a cluster
    named = rooted.join(ranks, "root").select("node", "cluster")
    own = reached.join(named, reached["id"] == named["node"]).groupBy("query").agg(F.min("cluster").alias("reach"))
    core_of = named.select(F.col("node").alias("query"), F.col("cluster").alias("is"))
    base = vectors(points, id_col, vector_col).select(F.col("id").alias("query"))
    out = base.join(own, "query", "left").join(core_of, "query", "left")
    return out.select(F.col("query").alias("id"), F.coalesce("is", "reach").alias("cluster"))


#: The original's approximate variant is an alias of the exact one.
appx_dbscan = dbscan


def core_distances(points: DataFrame, min_points: int, tolerance: float = math.inf, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2", **how) -> DataFrame:
    """(id, core_distance): to the min_points-th nearest point, itself included; null where there are fewer within the tolerance."""
    require(tolerance > 0, "the tolerance is positive")
    near = k_nearest(points, points, min_points, id_col, vector_col, metric, **how)
    nth = near.filter((F.col("rank") == min_points) & (F.col("distance") < tolerance)).select("query", F.col("distance").alias("core_distance"))
    base = vectors(points, id_col, vector_col).select(F.col("id").alias("query"))
    return base.join(nth, "query", "left").withColumnRenamed("query", "id")


def optics(points: DataFrame, min_points: int, tolerance: float = math.inf, id_col: str = "vec_id", vector_col: str = "embedding", metric: str = "l2") -> DataFrame:
    """(position, id, reachability, core_distance) in the order in which points are reached.

    Core distances are found by all tasks.  The ordering is one sequence, so
    it runs in one task, on at most ``MOST_ORDERED`` numbers; it holds the
    points and not their distances.  The next point is the one of the least
    reachability; ties go to the greater id.
    """
    require(min_points > 1, "there are at least two points")
    require(tolerance > 0, "the tolerance is positive")
    base = vectors(points, id_col, vector_col)
    n = base.count()
    require(n * (width(base) if n else 1) <= MOST_ORDERED, f"more than {MOST_ORDERED} numbers can't be put in one order", TooLarge)
    kind = base.schema["id"].dataType.simpleString()
    cored = base.join(core_distances(points, min_points, tolerance, id_col, vector_col, metric), "id")

    def order(table):
        import pyarrow as pa

        ids = table.column("id").to_numpy()
        at = np.argsort(ids, kind="stable")
        core = table.column("core_distance").to_numpy().astype(float)[at]
        out, reach = ordered(matrix(table.column("vector"))[at], core, tolerance, metric)
        return pa.table({"position": np.arange(len(out)), "id": pa.array(ids[at][out], table.schema.field("id").type), "reachability": pa.array(reach[out], from_pandas=True), "core_distance": pa.array(core[out], from_pandas=True)})

    schema = f"position bigint, id {kind}, reachability double, core_distance double"
    return cored.select("id", "vector", "core_distance").withColumn("_all", F.lit(True)).groupBy("_all").applyInArrow(lambda t: order(t.drop_columns(["_all"])), schema)


def ordered(x: np.ndarray, core: np.ndarray, tolerance: float, metric: str) -> tuple[np.ndarray, np.ndarray]:
    """The places of rows in the order in which they are reached, and each row's reachability; NaN where there is none.

    Single-precision products tell which rows may come nearer; only those are
    measured.  Rows that are done are dropped now and then.
    """
    n = len(x)
    screen = Screen(metric, 2.0, x[:: max(1, n // 1024)])
    f = differences(metric)
    reach, done = np.full(n, np.nan), np.zeros(n, bool)
    #: The rows that aren't done for long, their best reachability so far (inf: none), and what the screen needs of them.
    left = np.arange(n)
    best, ready = np.full(n, np.inf), screen.right(x)
    out = np.empty(n, np.int64)
    place, first = -1, 0
    for step in range(n):
        if place < 0:  # nothing is reached: the first row in order
            while done[first]:
                first += 1
            i, place = first, int(np.searchsorted(left, first))
        else:
            i = int(left[place])
        done[i], out[step] = True, i
        best[place] = np.nan  # below no limit
        if not np.isnan(core[i]):
            # a distance above all that is reached so far changes nothing
            worst = np.fmax.reduce(best)
            limit = np.array([min(float(worst), tolerance)])
            own = screen.left(x[i : i + 1])
            c = np.arange(len(left)) if not np.isfinite(limit[0]) else screen.closer(own, ready, np.minimum(best, tolerance)) if not screen.bytes else screen.under(own, ready, limit)[1]
            c = c[~done[left[c]]]
            d = f(x[i] - x[left[c]])
            new = np.maximum(core[i], d)
            better = (d < tolerance) & (new < best[c])
            best[c[better]] = reach[left[c[better]]] = new[better]
        if step + 1 < n:
            least = np.fmin.reduce(best)
            place = -1 if np.isnan(least) or np.isinf(least) else len(best) - 1 - int(np.argmax(best[::-1] == least))
            if step % 1024 == 1023:
                live = np.flatnonzero(~done[left])
                if len(live) < 0.9 * len(left):
                    if place >= 0:
                        place = int(np.searchsorted(live, place))
                    left, best = left[live], best[live]
                    ready = tuple(np.ascontiguousarray(v[..., live]) for v in ready)
    return out, reach


# Hierarchies


def linkage(d: np.ndarray, method: str) -> list[tuple[int, int, float]]:
    """Merges (cluster, cluster, dissimilarity) of a square matrix; new clusters are numbered on from n.

    Ties go to the pair of the smallest clusters.
    """
    n = len(d)
    rule = {
        "single": lambda a, b, x, y, z, i, j, k: np.minimum(a, b),
        "complete": lambda a, b, x, y, z, i, j, k: np.maximum(a, b),
        "average": lambda a, b, x, y, z, i, j, k: (x * a + y * b) / (x + y),
        "weighted": lambda a, b, x, y, z, i, j, k: (a + b) / 2,
        "ward": lambda a, b, x, y, z, i, j, k: np.sqrt(((x + z) * a**2 + (y + z) * b**2 - z * k**2) / (x + y + z)),
        "centroid": lambda a, b, x, y, z, i, j, k: np.sqrt(np.maximum((x * a**2 + y * b**2) / (x + y) - x * y * k**2 / (x + y) ** 2, 0)),
        "median": lambda a, b, x, y, z, i, j, k: np.sqrt(np.maximum(a**2 / 2 + b**2 / 2 - k**2 / 4, 0)),
    }
    require(method in rule, f"no such linkage: {method}")
    d = d.astype(float).copy()
    np.fill_diagonal(d, np.inf)
    size, name, alive = np.ones(n), np.arange(n), np.ones(n, bool)
    out = []
    for step in range(n - 1):
        i, j = np.unravel_index(int(np.argmin(d)), d.shape)
        k = d[i, j]
        out.append((min(int(name[i]), int(name[j])), max(int(name[i]), int(name[j])), float(k)))
        rest = alive.copy()
        rest[[i, j]] = False
        d[i, rest] = rule[method](d[i, rest], d[j, rest], size[i], size[j], size[rest], i, j, k)
        d[rest, i] = d[i, rest]
        d[j, :] = d[:, j] = np.inf
        alive[j] = False
        size[i] += size[j]
        name[i] = n + step
    return out


def hierarchical(kernel: DataFrame, method: str = "average", clusters: int | None = 2, distance: float | None = None, most: int = MOST_LINKED) -> DataFrame:
    """(id, cluster) from a similarity table (i, j, value), by agglomeration.

    Dissimilarity is -ln(similarity), similarities below 1e-6 and missing
    pairs counting as 1e-6.  Merging stops at a number of clusters or at a
    dissimilarity; clusters are numbered by their smallest member.
    """
    require(clusters is None or clusters > 0, "there is at least one cluster")
    require(distance is None or (distance >= 0 and math.isfinite(distance)), "a distance is finite and not negative")
    ids = [r[0] for r in kernel.select("i").distinct().orderBy("i").limit(most + 1).collect()]
    require(len(ids) <= most, f"more than {most} points can't be merged in one task", TooLarge)
    n = len(ids)
    place = {v: k for k, v in enumerate(ids)}
    d = np.full((n, n), -math.log(1e-6))
    pdf = kernel.filter("i < j").toPandas()  # at most most^2 / 2 rows
    if len(pdf):
        a, b = pdf["i"].map(place).to_numpy(), pdf["j"].map(place).to_numpy()
        d[a, b] = d[b, a] = -np.log(np.maximum(pdf["value"].to_numpy(), 1e-6))
    members = {k: [k] for k in range(n)}
    for step, (a, b, k) in enumerate(linkage(d, method)):
        if distance is not None and k >= distance or distance is None and len(members) <= clusters:
            break
        members[n + step] = members.pop(a) + members.pop(b)
    named = sorted(members.values(), key=min)
    rows = sorted((ids[m], c) for c, own in enumerate(named) for m in own)
    kind = kernel.schema["i"].dataType.simpleString()
    return kernel.sparkSession.createDataFrame(rows, f"id {kind}, cluster int")


def average_merges(x: np.ndarray) -> list[tuple[int, int, float]]:
    """Average linkage of squared distances without their matrix: (row, row, height), a row standing for its cluster.

    The mean squared distance between two clusters follows from their means
    and spreads.  Average linkage lets all mutually nearest clusters merge at
    once, and others keep their nearest one unless it was merged.
    """
    n = len(x)
    mean = x - x.mean(axis=0)
    spread, size, row = np.zeros(n), np.ones(n), np.arange(n)
    near, height, own = np.zeros(n, np.int64), np.full(n, np.inf), np.zeros(n)
    stale, out = np.arange(n), []
    while len(row) > 1:
        level = np.einsum("ij,ij->i", mean, mean) + spread
        for i in range(0, len(stale), 256):
            at = stale[i : i + 256]
            best, to = np.full(len(at), np.inf), np.zeros(len(at), np.int64)
            for j in range(0, len(row), 4096):
                d = mean[at] @ (-2 * mean[j : j + 4096].T)
                d += level[at][:, None]
                d += level[j : j + 4096]
                inside = np.flatnonzero((at >= j) & (at < j + d.shape[1]))
                d[inside, at[inside] - j] = np.inf
                k = d.argmin(axis=1)
                value = d[np.arange(len(at)), k]
                closer = value < best
                best[closer], to[closer] = value[closer], k[closer] + j
            near[at], height[at] = to, np.maximum(best, 0)
        a = np.flatnonzero((near[near] == np.arange(len(row))) & (np.arange(len(row)) < near))
        if not len(a):  # rounding may leave none
            a = np.array([int(height.argmin())])
        b = near[a]
        at = np.maximum(height[a], np.maximum(own[a], own[b]))  # not below what it merges
        out += zip(row[a].tolist(), row[b].tolist(), at.tolist())
        na, nb = size[a], size[b]
        gap = mean[a] - mean[b]
        spread[a] = (na * spread[a] + nb * spread[b]) / (na + nb) + na * nb / (na + nb) ** 2 * np.einsum("ij,ij->i", gap, gap)
        mean[a] -= gap * (nb / (na + nb))[:, None]
        size[a], own[a] = na + nb, at
        changed, dead = np.zeros(len(row), bool), np.zeros(len(row), bool)
        changed[a] = changed[b] = dead[b] = True
        again = changed | changed[near]
        place = np.cumsum(~dead) - 1
        mean, spread, size, row, height, own, near, again = (v[~dead] for v in (mean, spread, size, row, height, own, near, again))
        near = place[near]
        stale = np.flatnonzero(again)
    return out


def hierarchical_gaussian(points: DataFrame, eps: float, clusters: int | None = 2, distance: float | None = None, id_col: str = "vec_id", vector_col: str = "embedding", most: int = MOST_ORDERED) -> DataFrame:
    """(id, cluster): ``hierarchical`` of the points' dense gaussian kernel by average linkage, without its table.

    -ln(similarity) is the squared distance over ``eps``.  The points meet in
    one task, which holds no pairs.  Points so far apart that similarities
    fall below 1e-6, where ``hierarchical`` cuts them, go by the table.
    """
    require(eps > 0, "eps is positive")
    require(clusters is None or clusters > 0, "there is at least one cluster")
    require(distance is None or (distance >= 0 and math.isfinite(distance)), "a distance is finite and not negative")
    base = vectors(points, id_col, vector_col)
    d = width(base)
    n = base.count()
    require(n * d <= most, f"more than {most} numbers can't be merged in one task", TooLarge)
    span = base.agg(*[F.max(F.col("vector")[i]) - F.min(F.col("vector")[i]) for i in range(d)]).first()
    if not float(np.square(np.array(span, float)).sum()) / eps < -math.log(1e-6):  # a bound: no two points are farther apart
        centre = np.array(base.agg(*[F.avg(F.col("vector")[i]) for i in range(d)]).first(), float)
        radius = base.agg(F.max(vec.l2(vec.cells("vector", d), [F.lit(float(c)) for c in centre]))).first()[0]
        if not (2 * radius) ** 2 / eps < -math.log(1e-6):
            return hierarchical(dense_kernel(points, "gaussian", eps, id_col=id_col, vector_col=vector_col), "average", clusters, distance)
    kind = base.schema["id"].dataType.simpleString()

    def merged(table):
        import pyarrow as pa

        ids = table.column("id").to_numpy()
        order = np.argsort(ids, kind="stable")
        ids = ids[order]
        merges = sorted(((a, b, h / eps) for a, b, h in average_merges(matrix(table.column("vector"))[order])), key=lambda m: m[2])
        kept = [m for m in merges if m[2] < distance] if distance is not None else merges[: max(0, len(ids) - clusters)]
        root = np.arange(len(ids))

        def top(i: int) -> int:
            while root[i] != i:
                root[i] = root[root[i]]
                i = root[i]
            return i

        for a, b, _ in kept:
            u, v = top(a), top(b)
            root[max(u, v)] = min(u, v)
        _, named = np.unique([top(i) for i in range(len(ids))], return_inverse=True)
        return pa.table({"id": pa.array(ids, table.schema.field("id").type), "cluster": pa.array(named, pa.int32())})

    return base.withColumn("_all", F.lit(True)).groupBy("_all").applyInArrow(lambda t: merged(t.drop_columns(["_all"])), f"id {kind}, cluster int")


__all__ = ["KMeans", "Mixture", "appx_dbscan", "components", "core_distances", "dbscan", "gaussian_mixture", "hierarchical", "hierarchical_gaussian", "initial", "kmeans", "kmeans_update", "linkage", "optics", "width"]
