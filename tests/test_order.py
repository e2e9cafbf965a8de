import numpy as np
import pytest

from statforge.functions.pairwise import differences
from statforge.operators import clusters, neighbours

RNG = np.random.default_rng(8)


def plainly(x, min_points, tolerance, metric):
    """One point after another, all distances measured."""
    d = np.array([differences(metric)(p - x) for p in x])
    n = len(x)
    core = np.array([np.partition(r[r < tolerance], min_points - 1)[min_points - 1] if (r < tolerance).sum() >= min_points else np.nan for r in d])
    reach, done, out = np.full(n, np.nan), np.zeros(n, bool), []
    while len(out) < n:
        open_ = np.flatnonzero(~done & ~np.isnan(reach))
        i = int(open_[reach[open_] == reach[open_].min()][-1]) if len(open_) else int(np.flatnonzero(~done)[0])
        done[i] = True
        out.append(i)
        if not np.isnan(core[i]):
            for j in np.flatnonzero((d[i] < tolerance) & ~done):
                reach[j] = np.fmin(reach[j], max(core[i], d[i, j]))
    return out, reach, core


@pytest.mark.parametrize("metric", ["l2", "l1"])
@pytest.mark.parametrize("tolerance", [np.inf, 1.4, 0.2])
def test_order_equals_plain_steps(metric, tolerance):
    x = RNG.normal(size=(2600 if metric == "l2" and tolerance == np.inf else 300, 3))
    want, reach, core = plainly(x, 4, tolerance, metric)
    got, near = clusters.ordered(x, core, tolerance, metric)
    assert got.tolist() == want and np.allclose(near, reach, equal_nan=True)


def test_order_of_more_points_than_one_may_wait_for(spark):
    x = RNG.normal(size=(20_100, 2)).round(4)
    df = spark.createDataFrame([(i, p) for i, p in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    rows = clusters.optics(df, 5).toPandas()
    assert sorted(rows.id) == list(range(20_100)) and sorted(rows.position) == list(range(20_100)) and rows.reachability.isna().sum() == 1 and rows.core_distance.notna().all()


@pytest.mark.parametrize("how", [{"clusters": 7}, {"clusters": 1}, {"clusters": None, "distance": 0.8}, {"clusters": 500}])
@pytest.mark.parametrize("spread", [1.0, 9.0])  # the larger one is cut at 1e-6
def test_merging_points_equals_merging_their_kernel(spark, how, spread):
    x = RNG.normal(size=(80, 3)) * spread / 2
    df = spark.createDataFrame([(i, p) for i, p in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    want = clusters.hierarchical(neighbours.dense_kernel(df, "gaussian", 4.0), "average", **how).orderBy("id").collect()
    assert clusters.hierarchical_gaussian(df, 4.0, **how).orderBy("id").collect() == want


def test_merges_of_more_points_than_a_kernel_may_have(spark):
    x = np.concatenate([RNG.normal(size=(2600, 2)) * 0.1, RNG.normal(size=(2500, 2)) * 0.1 + 1.5])
    df = spark.createDataFrame([(i, p) for i, p in enumerate(x.tolist())], "vec_id bigint, embedding array<double>")
    got = clusters.hierarchical_gaussian(df, 2.0).orderBy("id").toPandas()
    assert got.cluster.tolist() == [0] * 2600 + [1] * 2500
