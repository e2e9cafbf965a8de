import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from statforge.functions.pairwise import Nearest, Screen, block_distance, l2_squared
from statforge.operators import clusters, neighbours

RNG = np.random.default_rng(11)
METRICS = ["l2", "l1", "linf", "lp", "wasserstein"]


def vectors(spark, points):
    return spark.createDataFrame([(i, list(map(float, p))) for i, p in enumerate(points)], "vec_id bigint, embedding array<double>")


def brute(x, metric):
    d = x[:, None, :] - x[None, :, :]
    return {"l2": np.sqrt((d**2).sum(axis=2)), "l1": np.abs(d).sum(axis=2), "linf": np.abs(d).max(axis=2), "lp": (np.abs(d) ** 3).sum(axis=2) ** (1 / 3), "wasserstein": np.abs(d.cumsum(axis=2)).sum(axis=2)}[metric]


@pytest.mark.parametrize("metric", METRICS)
def test_screens_lose_no_pair_and_spare_most(metric):
    x = RNG.normal(size=(3000, 64)) * 0.125
    x[1500:1600] = x[100:200] + RNG.normal(size=(100, 64)) * 1e-4
    near = Nearest(x[:300], 5, metric, 3.0, Screen(metric, 3.0, x[:500]))
    for i in range(0, 3000, 700):
        near.meet(x[i : i + 700], np.arange(i, min(3000, i + 700)))
    d = block_distance(metric, 3.0)(x[:300], x)
    want = np.argsort(d, axis=1, kind="stable")[:, :5]
    assert (near.id == want).all() and np.allclose(near.distance, np.take_along_axis(d, want, axis=1))
    assert near.measured < 0.5 * d.size


@pytest.mark.parametrize("metric", METRICS)
@pytest.mark.parametrize("scale,shift", [(1, 0), (1e-25, 0), (1e25, 0), (1, 1e6), (0, 3), (1e200, 0)])
def test_screens_at_odd_sizes(metric, scale, shift):
    with np.errstate(over="ignore", invalid="ignore"):
        x = RNG.normal(size=(90, 3)) * scale + shift
        x[80:] = x[:10]
        x[0, 0] *= 1e4  # far from all others
        near = Nearest(x, 3, metric, 3.0, Screen(metric, 3.0, x[20:40]))
        for i in range(0, 90, 40):
            near.meet(x[i : i + 40], np.arange(i, min(90, i + 40)))
        d = brute(x, metric)
    order = np.argsort(d, axis=1, kind="stable")[:, :3]
    assert np.allclose(near.distance, np.take_along_axis(d, order, axis=1), rtol=1e-12, atol=0)


def test_products_keep_small_distances():
    x = RNG.normal(size=(40, 8)) + 1e4
    x[20:] = x[:20] + 1e-7
    assert np.allclose(np.sqrt(l2_squared(x, x)), brute(x, "l2"), rtol=1e-6, atol=1e-12)


def test_a_dense_kernel_needs_no_table(spark):
    df = vectors(spark, RNG.normal(size=(60, 3)))
    right = df.select(F.col("vec_id").alias("j"), F.col("embedding")[0].alias("u"), (F.col("vec_id") * 1.0).alias("w")).filter("j < 50")
    for kind, a, b in (("gaussian", 2.0, 1.0), ("linear", 1.0, 1.0), ("polynomial", 2.0, 3.0)):
        table = neighbours.dense_kernel(df, kind, a, b).cache()
        pairs = [
            (neighbours.kernel_sum(table), neighbours.dense_kernel_sum(df, kind, a, b, cells=1, block=7), ["i"]),
            (neighbours.kernel_dot(table, right, ["u", "w"]), neighbours.dense_kernel_dot(df, right, ["u", "w"], kind, a, b), ["i"]),
            (neighbours.kernel_diagonal(table), neighbours.dense_kernel_diagonal(df, kind, a, b), ["i"]),
            (neighbours.kernel_upper_triangle(table), neighbours.dense_kernel_upper_triangle(df, kind, a, b, cells=1, block=7), ["i", "j"]),
        ]
        for want, got, keys in pairs:
            want, got = (t.orderBy(*keys).toPandas() for t in (want, got))
            assert want.columns.tolist() == got.columns.tolist() and np.allclose(want, got)


def test_pairs_are_handed_over_in_bounded_parts(spark, monkeypatch):
    kept = []
    monkeypatch.setattr(neighbours, "each_against_all", lambda left, right, f, *_: kept.append(f) or left)
    neighbours.dense_kernel(vectors(spark, [[1.0]]), "linear")
    table = pa.table({"id": np.arange(3000), "vector": pa.array(RNG.normal(size=(3000, 2)).tolist())})
    sizes = [len(t) for t in kept[0](table, lambda: iter([table]))]
    assert sum(sizes) == 3000**2 and max(sizes) <= neighbours.PAIRS


@pytest.mark.parametrize("metric", ["l2", "wasserstein"])
def test_core_distances_are_those_of_the_nearest(spark, monkeypatch, metric):
    monkeypatch.setattr(clusters, "within_range", None)  # all pairs of an infinite range
    x = RNG.normal(size=(50, 3))
    d = np.sort(brute(x, metric), axis=1)[:, 3]
    for tolerance in (np.inf, float(np.median(d))):
        got = {r.id: r.core_distance for r in clusters.core_distances(vectors(spark, x), 4, tolerance, metric=metric).collect()}
        assert got == {i: pytest.approx(v) if v < tolerance else None for i, v in enumerate(d)}
